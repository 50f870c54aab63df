"""What a middleware's own control flow says about it: whether it can end the chain, never does, or can't be told.

Input are rows of code: functions, the returns of factories, statements by block, all calls by body. A guard is
confirmed where a top-level branch of its body aborts and returns at once, itself or by a helper of its package;
contradicted where every call in it is on its own context and none aborts; else unresolved. Bodies are found through
at most two factories of one package. All steps are joins and windows within a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.tables import written
from .config import Config

#: body: the block of a declaration, null without source.
FUNCTIONS = "func string, package string, body string, takes_context boolean, returns_handler boolean"
#: Returns of a body itself, not of functions inside it: kind literal (with its block), call (of callee), other.
RETURNS = "body string, kind string, callee string, literal string, literal_takes_context boolean"
#: kind: call, if (then: the branch's block; receives: its condition waits for a channel; asks: the function that the
#: condition calls, plain or negated, with the context first), return, other.
STATEMENTS = "block string, ord int, kind string, on_context boolean, method string, `then` string, receives boolean, asks string"
CALLS = "body string, on_context boolean, method string"
#: Methods that end a chain (fixed values).
ABORTS = ("Abort", "AbortWithStatus", "AbortWithStatusJSON", "AbortWithError")
HOPS = 2  # factories between a symbol and the body that runs


def bodies(functions: DataFrame, returns: DataFrame, hops: int = HOPS) -> DataFrame:
    """func, body, package: what runs for each request; functions whose body isn't found have no row."""
    one = returns.groupBy("body").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("kind", "callee", "literal", "literal_takes_context"))).where("n = 1")
    known = written(functions.where("body is not null").join(one.drop("n"), "body", "left"), "functions")
    level, out = None, None
    for n in range(hops + 1):
        # a function itself is the first level; only what a factory calls is looked up
        here = known.withColumn("home", F.col("package")) if level is None else level.join(known.withColumnRenamed("func", "of"), "of").where("package = home")
        found = here.where("takes_context").select("func", "body", "package")
        if n < hops:
            made = here.where("not takes_context and returns_handler")
            found = found.union(made.where("kind = 'literal' and literal_takes_context").select("func", F.col("literal").alias("body"), "package"))
            level = made.where("kind = 'call' and callee is not null").select("func", F.col("callee").alias("of"), "home")
        out = found if out is None else out.union(found)
    return written(out, "bodies")


def shapes(functions: DataFrame, returns: DataFrame, statements: DataFrame, calls: DataFrame) -> DataFrame:
    """symbol, shape (confirmed-shape, contradicted, unresolved) of every function.

    A branch counts if its last two statements are an abort on the function's own context and a return; one that waits
    for a channel doesn't. A helper counts if it is asked in a top-level condition whose branch only returns, takes a
    context, lies in the same package and has such a branch itself. Functions named twice get a row each of any of
    their bodies; no functions give no rows.
    """
    found = bodies(functions, returns)
    order = Window.partitionBy("block").orderBy("ord")
    before = lambda c: F.lag(c).over(order)
    aborts = F.coalesce((before("kind") == "call") & before("on_context") & before("method").isin(*ABORTS), F.lit(False))
    ends = statements.select("block", "kind", aborts.alias("aborts"), before("ord").isNull().alias("alone"), F.lead("ord").over(order).isNull().alias("last")).where("last and kind = 'return'")
    ends = ends.select(F.col("block").alias("then"), "aborts", "alone")
    branches = written(statements.where("kind = 'if' and then is not null").select("block", "then", F.coalesce("receives", F.lit(False)).alias("receives"), "asks").join(ends, "then"), "branches")
    direct = branches.where("aborts and not receives").select(F.col("block").alias("body")).distinct()
    helpers = functions.where("takes_context and body is not null").join(direct, "body", "left_semi").select(F.col("func").alias("asks"), "package")
    asked = branches.where("alone and asks is not null").select(F.col("block").alias("body"), "asks")
    delegated = found.join(asked, "body").join(helpers.distinct(), ["asks", "package"], "left_semi").select("func")
    confirmed = found.join(direct, "body", "left_semi").select("func").union(delegated).distinct()
    seen = calls.groupBy("body").agg(F.bool_or(~F.coalesce(F.col("on_context"), F.lit(False)) | F.coalesce(F.col("method").isin(*ABORTS), F.lit(False))).alias("open"))
    free = found.join(seen.where("open"), "body", "left_anti").select("func").distinct()
    marks = confirmed.select("func", F.lit(2).alias("mark")).union(free.select("func", F.lit(1))).groupBy("func").agg(F.max("mark").alias("mark"))
    rows = functions.select("func").distinct().join(marks, "func", "left")
    return rows.select(F.col("func").alias("symbol"), F.when(F.col("mark") == 2, "confirmed-shape").when(F.col("mark") == 1, "contradicted").otherwise("unresolved").alias("shape"))


def guard_shapes(config: Config, found: DataFrame) -> dict[str, str]:
    """Shapes of the configured guards, for classify(): a row for each of them at most."""
    names = sorted(config.guards)
    return {r["symbol"]: r["shape"] for r in found.where(F.col("symbol").isin(*names)).collect()} if names else {}


def wrapped(expressions: DataFrame, hops: int = 3) -> DataFrame:
    """id, wrappedSymbols of `expressions` (id, symbol, first): the symbols inside a call's first argument, outermost first.

    `first` is the expression that is a call's first argument, null for other expressions. A level without a symbol
    ends the list, as `hops` levels do. An expression joins its argument once a level; nothing recurs.
    """
    inner = expressions.select(F.col("id").alias("at"), F.col("symbol").alias("s"), F.col("first").alias("next"))
    rows = expressions.select("id", F.col("first").alias("at"), F.array().cast("array<string>").alias("found"))
    for _ in range(hops):
        rows = rows.join(inner, "at", "left").select("id", F.when(F.col("s").isNotNull(), F.col("next")).alias("at"), F.when(F.col("s").isNotNull(), F.array_append("found", F.col("s"))).otherwise(F.col("found")).alias("found"))
    return rows.select("id", F.col("found").alias("wrappedSymbols"))
