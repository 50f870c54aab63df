"""Values of string expressions: literals, concatenations, variables that are never assigned again, fields of a caller's literal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks.tables import written

#: kind: literal (value), concat (left, right), variable (name), field (name of a parameter, field), other.
NODES = "id string, kind string, value string, `left` string, `right` string, name string, field string"
#: Tables that are read as one; after so many levels those so far are written as one, so plans don't grow with depth.
LEVELS = 64
#: With so many concatenations at most, a level is joined with the nodes that it meets, which are found without a shuffle,
#: where there are more than ten times as many nodes.
FEW = 20000


def steady(variables: DataFrame, writes: DataFrame) -> DataFrame:
    """name, value of `variables` (name, value; null: not initialised by one literal) that `writes` (name) has no row for.

    A variable that is declared twice, assigned, counted up or whose address is taken anywhere is not steady.
    """
    once = variables.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("value")).where("n = 1 and value is not null")
    return once.join(writes.select("name").distinct(), "name", "left_anti").select("name", "value")


def folded(wanted: DataFrame, nodes: DataFrame, variables: DataFrame, writes: DataFrame, fields: DataFrame) -> DataFrame:
    """context, id, value of `wanted` (context, id): the string that an expression stands for in a context, null if it isn't one.

    `fields` (context, name, field, value): what the literal passed for a parameter holds, by call. One part without a
    value makes the whole unknown, as do unknown nodes and cycles; nothing is guessed. Depth has no limit.

    Concatenations are opened level by level, once for each expression and not for each context; a part carries its
    place as a text of l and r, which sorts in order. Only fields differ by context: a context joins the different
    fields that an expression asks for, and a whole is put together from its parts once.
    """
    nodes = written(nodes.select("id", "kind", "value", "left", "right", "name", "field").repartition("id"), "nodes")
    few = FEW if nodes.count() > 10 * FEW else 0
    wanted = wanted.select("context", "id").distinct()
    level = wanted.select(F.col("id").alias("root"), "id", F.lit("").alias("at"), F.array("id").alias("above")).distinct()
    again = F.coalesce(F.col("kind") == "concat", F.lit(False)) & ~F.col("round")
    both = F.explode(F.array(F.struct(F.col("left").alias("id"), F.lit("l").alias("side")), F.struct(F.col("right").alias("id"), F.lit("r").alias("side"))))
    union, parts, more = (lambda frames: reduce(DataFrame.unionByName, frames)), [], None
    while more != 0:  # ends, as an expression inside itself is not opened again
        met = nodes if more is None or more > few else nodes.join(F.broadcast(level.select("id")), "id", "left_semi")
        here = written(level.withColumn("round", F.array_contains(F.slice("above", 1, F.size("above") - 1), F.col("id"))).join(met, "id", "left"), "open")
        if len(parts) == LEVELS:
            parts = [written(union(parts), "levels")]
        parts.append(here.where(~again).select("root", "at", "kind", "value", "name", "field"))
        level = here.where(again).select("root", "at", "above", both.alias("part"))
        level = level.select("root", "part.id", F.concat("at", "part.side").alias("at"), F.array_append("above", F.col("part.id")).alias("above"))
        more = here.where(again).count()
    every = written(union(parts), "parts")
    every = every.join(steady(variables, writes).withColumnRenamed("value", "held"), "name", "left")
    value, asks = F.when(F.col("kind") == "literal", F.col("value")).when(F.col("kind") == "variable", F.col("held")), F.coalesce(F.col("kind") == "field", F.lit(False))
    whole = every.groupBy("root").agg(F.bool_or(~asks & value.isNull()).alias("open"), F.bool_or(asks).alias("asks"), F.array_sort(F.collect_list(F.struct("at", asks.alias("asks"), value.alias("value"), "name", "field"))).alias("parts"))
    whole = whole.where("not open").select(F.col("root").alias("id"), "asks", F.when(~F.col("asks"), F.array_join("parts.value", "")).alias("fixed"), F.when(F.col("asks"), F.col("parts")).alias("parts"))
    whole = written(whole, "wholes")  # an expression that is unknown in every context has no row
    bound = fields.groupBy("context", "name", "field").agg(F.min("value").alias("bound"), F.count_distinct("value").alias("values")).where("values = 1").drop("values")
    needs = whole.where("asks").select("id", F.explode(F.array_distinct(F.transform(F.filter("parts", lambda p: p["asks"]), lambda p: F.struct(p["name"].alias("name"), p["field"].alias("field"))))).alias("n")).select("id", "n.*")
    given = wanted.join(needs, "id").join(bound, ["context", "name", "field"], "left").groupBy("context", "id").agg(F.bool_and(F.col("bound").isNotNull()).alias("all"), F.collect_list(F.struct("name", "field", "bound")).alias("given")).where("all")
    rows = wanted.join(whole, "id", "left").join(given.drop("all"), ["context", "id"], "left")
    held = lambda p: F.try_element_at(F.filter("given", lambda g: (g["name"] == p["name"]) & (g["field"] == p["field"])), F.lit(1))["bound"]
    filled = F.array_join(F.transform("parts", lambda p: F.when(p["asks"], held(p)).otherwise(p["value"])), "")
    return rows.select("context", "id", F.when(F.col("asks"), F.when(F.col("given").isNotNull(), filled)).otherwise(F.col("fixed")).alias("value"))
