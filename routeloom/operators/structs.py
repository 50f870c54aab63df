"""Schemas of program types: structs with their fields become components, wherever they refer to each other.

Input are fields (struct, ord, name, type, tag, embedded) and the types that are wanted. A type's text is folded from
its base outwards by column functions; references form a graph whose closure is walked level by level, each type once,
so structs that contain each other give a component each. Fields of embedded structs are promoted along embedding
edges, level by level too, and the winner of a name is one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.tables import written

FIELDS = "struct string, ord int, name string, type string, tag string, embedded boolean"
DEPTH = 64
WRAP = r"\*|\[\d*\]|map\[[^\]]*\]"
#: Basic types: JSON type and format (fixed values).
BASIC = {
    "bool": ("boolean", None), "string": ("string", None), "float32": ("number", "float"), "float64": ("number", "double"), "int64": ("integer", "int64"), "uint64": ("integer", "int64"),
    **dict.fromkeys(("int", "int8", "int16", "int32", "uint", "uint8", "uint16", "uint32", "uintptr", "byte", "rune"), ("integer", "int32")), **dict.fromkeys(("any", "interface{}"), ("object", None)),
}
#: Words for truth values in tags (fixed values).
TRUE, FALSE = ("1", "t", "T", "TRUE", "true", "True"), ("0", "f", "F", "FALSE", "false", "False")
OVERRIDES = ("integer", "number", "boolean", "object")
SHOWN = ("example", "default", "enums")  # tags that a schema shows


def component_id(name: Column) -> Column:
    """Letters and digits of the name after the package, and the beginning of a hash of the whole."""
    own = F.regexp_replace(F.element_at(F.split(name, r"\."), -1), r"[^\p{L}\p{Nd}_]", "")
    return F.concat(F.when(own == "", "Schema").otherwise(own), F.lit("_"), F.substring(F.sha2(name, 256), 1, 10))


def json_text(value: Column) -> Column:
    return F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1)


def tag_of(tag: Column, key: str) -> Column:
    """The value of a key in a struct tag; null without it."""
    return F.when(tag.contains(f'{key}:"') & tag.rlike(f'(^|\\s){key}:"'), F.regexp_extract(tag, f'(?:^|\\s){key}:"((?:[^"\\\\]|\\\\.)*)"', 1))


def literal(text: Column) -> Column:
    """A tag's value as JSON: truth values, then numbers, else text; null stays null."""
    number = text.try_cast("double")
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    plain = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(text.isNull(), None).when(text.isin(*TRUE), "true").when(text.isin(*FALSE), "false").when(plain & number.isNotNull(), F.when(whole, number.cast("long").cast("string")).otherwise(number.cast("string"))).otherwise(json_text(text))


def members(**values: Column | None) -> Column:
    """A JSON object of those values (JSON texts) that aren't null, by key."""
    each = [F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(values.items()) if v is not None]
    return F.concat(F.lit("{"), F.concat_ws(",", *each), F.lit("}"))


def base_of(kind: Column) -> Column:
    """The innermost type, without pointers, lists and maps around it."""
    return F.regexp_replace(kind, f"^({WRAP})+", "")


def shape(kind: Column, base: Column | None = None) -> Column:
    """struct ref, type, format, items, values, nullable of a type's text; ref and type are null where nothing can be said.

    `base` is base_of(kind), where a column holds it already.
    """
    base = base_of(kind) if base is None else base
    named = base.rlike(r"^[\w./~-]+$") & (base.contains(".") | base.rlike(r"^\p{Lu}")) & ~base.isin(*BASIC)
    text = lambda c: c.cast("string")
    table = F.create_map(*(x for k, (t, f) in BASIC.items() for x in (F.lit(k), F.struct(F.lit(t).alias("type"), text(F.lit(f)).alias("format")))))
    known = F.try_element_at(table, base)
    fields = lambda ref, type_, format_, items, values, nullable: F.struct(text(ref).alias("ref"), text(type_).alias("type"), text(format_).alias("format"), text(items).alias("items"), text(values).alias("values"), nullable.alias("nullable"))
    none, no = F.lit(None), F.lit(False)
    start = fields(F.when(named, component_id(base)), known["type"], known["format"], none, none, no)
    around = F.reverse(F.regexp_extract_all(F.regexp_extract(kind, f"^((?:{WRAP})*)", 1), F.lit(f"({WRAP})"), F.lit(1)))

    def wrap(inner: Column, sign: Column) -> Column:
        pointer = fields(inner["ref"], inner["type"], inner["format"], inner["items"], inner["values"], F.lit(True))
        many = fields(none, F.lit("array"), none, rendered(inner), none, no)
        table_ = fields(none, F.lit("object"), none, none, rendered(inner), no)
        return F.when(sign == "*", pointer).when(sign.startswith("["), many).otherwise(table_)

    return F.aggregate(around, start, wrap)


def rendered(s: Column, **more: Column) -> Column:
    """The JSON schema of a shape; null where nothing can be said."""
    kind = F.when(s["ref"].isNull(), F.when(s["nullable"], F.concat(F.lit('["'), s["type"], F.lit('","null"]'))).otherwise(F.concat(F.lit('"'), s["type"], F.lit('"'))))
    parts = {"$ref": F.concat(F.lit('"#/components/schemas/'), s["ref"], F.lit('"')), "type": kind, "format": F.concat(F.lit('"'), s["format"], F.lit('"')), "items": s["items"], "additionalProperties": s["values"]}
    return F.when(s["ref"].isNotNull() | s["type"].isNotNull(), members(**parts, **more))


def properties(fields: DataFrame) -> DataFrame:
    """struct, ord, property, schema, required, embeds (the struct whose fields are promoted in its place) of fields that count."""
    tag, value = F.coalesce("tag", F.lit("")), F.col
    # each step has its own projection, so that a tag's values and a type's base are read once a row and not once a use
    rows = fields.where(F.col("name").rlike(r"^\p{Lu}")).withColumns({"said": tag_of(tag, "json"), "ignored": tag_of(tag, "swaggerignore"), "base": base_of(F.col("type"))} | {key: F.nullif(tag_of(tag, key), F.lit("")) for key in ("swaggertype", *SHOWN, "binding", "validate")})
    rows = rows.where(~F.coalesce(value("said") == "-", F.lit(False)) & ~F.coalesce(value("ignored") == "true", F.lit(False)))
    stated = F.element_at(F.split(F.coalesce("said", F.lit("")), ","), 1)
    override = value("swaggertype")
    word = F.trim(F.element_at(F.split(override, ","), 1))
    second = F.trim(F.try_element_at(F.split(override, ","), F.lit(2)))
    simple = F.when(second.isin(*OVERRIDES), second).otherwise("string")
    plain = F.concat(F.lit('"'), simple, F.lit('"'))
    of = shape(F.col("type"), value("base"))
    chosen = F.when(override.isNotNull(), F.struct(F.lit(None).cast("string").alias("ref"), F.when(word == "array", "array").otherwise(simple).alias("type"), F.lit(None).cast("string").alias("format"), F.when(word == "array", F.concat(F.lit('{"type":'), plain, F.lit("}"))).alias("items"), F.lit(None).cast("string").alias("values"), F.lit(False).alias("nullable"))).otherwise(of)
    rows = rows.withColumns({"property": F.when(stated == "", F.col("name")).otherwise(stated), "shape": chosen})
    enums = F.concat(F.lit("["), F.array_join(F.transform(F.split(value("enums"), ","), lambda v: literal(F.trim(v))), ","), F.lit("]"))
    schema = rendered(F.col("shape"), example=literal(value("example")), default=literal(value("default")), enum=enums)
    must = lambda key: F.coalesce(F.exists(F.split(value(key), ","), lambda x: F.trim(x) == "required"), F.lit(False))
    embeds = F.when(F.coalesce("embedded", F.lit(False)) & (F.col("property") == F.col("name")) & F.col("shape.ref").isNotNull(), value("base"))
    return rows.select("struct", "ord", "property", schema.alias("schema"), (must("binding") | must("validate")).alias("required"), embeds.alias("embeds"))


def promoted(own: DataFrame, structs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """struct, property, schema, required, place of all fields that a struct has, its own and those of embedded ones.

    `place` sorts the fields of a name: own ones first, the last of them; then embedded structs in order, in each the
    same. An embedded type that isn't one of `structs` is a property itself; one inside itself is not opened again.
    """
    there = structs.select(F.col("struct").alias("embeds")).distinct()
    inner = own.where("embeds is not null").join(there, "embeds", "left_semi")
    plain = own.where("embeds is null").unionByName(own.where("embeds is not null").join(there, "embeds", "left_anti"))
    plain = written(plain.select("struct", "property", "schema", "required", F.concat(F.lit("0"), F.lpad((F.lit(999_999_999) - F.col("ord")).cast("string"), 9, "0")).alias("place")), "fields")
    edges = written(inner.select(F.col("struct").alias("at"), "embeds", F.concat(F.lit("1"), F.lpad(F.col("ord").cast("string"), 9, "0")).alias("step")), "embeds")
    level, walks = written(edges.select(F.col("at").alias("struct"), F.col("embeds").alias("inside"), F.col("step").alias("place"), F.array("at", "embeds").alias("above")), "level"), None
    for _ in range(depth):
        if level.isEmpty():
            break
        walk = level.select("struct", "inside", F.col("place").alias("first"))
        walks = walk if walks is None else walks.unionByName(walk)
        deeper = level.join(edges, F.col("inside") == F.col("at")).where(~F.array_contains("above", F.col("embeds")))
        level = written(deeper.select("struct", F.col("embeds").alias("inside"), F.concat("place", "step").alias("place"), F.array_append("above", F.col("embeds")).alias("above")), "level")
    if walks is None:
        return plain
    # one join for all levels: the fields are read once more, not once a level
    below = walks.join(plain.withColumnRenamed("struct", "inside"), "inside")
    return plain.unionByName(below.select("struct", "property", "schema", "required", F.concat("first", "place").alias("place")))


def reached(wanted: DataFrame, fields: DataFrame, depth: int = DEPTH) -> DataFrame:
    """struct: the structs that `wanted` (type) names or that lie inside them, each once, however they refer to each other."""
    edges = written(fields.select("struct", base_of(F.col("type")).alias("to")).distinct(), "edges")
    known = written(edges.select("struct").distinct(), "known")
    edges = written(edges.join(known.select(F.col("struct").alias("to")), "to", "left_semi"), "edges")
    frontier = written(wanted.select(base_of(F.col("type")).alias("struct")).distinct().join(known, "struct", "left_semi"), "structs")
    seen = frontier
    for _ in range(depth):
        onward = edges.join(frontier, "struct", "left_semi").select(F.col("to").alias("struct")).distinct()
        frontier = written(onward.join(seen, "struct", "left_anti"), "structs")
        if frontier.isEmpty():
            break
        seen = written(seen.unionByName(frontier), "structs")
    return seen


def components(wanted: DataFrame, fields: DataFrame, depth: int = DEPTH) -> DataFrame:
    """id, struct, schema (JSON) of each struct that `wanted` (type) reaches through `fields`.

    Properties are those that are exported and not ignored, by their JSON names; ones about whose type nothing can be
    said are left out. Required names are listed in order, also those of embedded structs that are overridden. Types
    that aren't in `fields` have no component: unknown_references() finds what refers to them. More levels than `depth`
    are not followed; no wanted types give no rows.
    """
    structs = reached(wanted, fields, depth)
    own = written(properties(fields.join(structs, "struct", "left_semi")), "properties")
    every = promoted(own, structs, depth)
    named = every.groupBy("struct", "property").agg(F.min_by("schema", "place").alias("schema"), F.count_if("required").cast("int").alias("musts"))
    said = F.when(F.col("schema").isNotNull(), F.struct("property", F.concat(json_text(F.col("property")), F.lit(":"), "schema").alias("said")))
    lists = named.groupBy("struct").agg(F.array_sort(F.collect_list(said)).alias("said"), F.array_sort(F.flatten(F.collect_list(F.when(F.col("musts") > 0, F.array_repeat("property", F.col("musts")))))).alias("musts"))
    some = lambda c, text: F.when(F.size(c) > 0, F.array_join(F.transform(c, text), ","))
    bodies = lists.select("struct", some("said", lambda x: x["said"]).alias("properties"), some("musts", json_text).alias("required"))
    rows = structs.join(bodies, "struct", "left")
    braces = lambda a, c, b: F.concat(F.lit(a), F.col(c), F.lit(b))
    return rows.select(component_id(F.col("struct")).alias("id"), "struct", members(properties=braces("{", "properties", "}"), required=braces("[", "required", "]"), type=F.lit('"object"')).alias("schema"))
