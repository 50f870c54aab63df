"""Struct schemas: types, tags, embedding, structs that contain each other."""

import json

from pyspark.sql import functions as F

from routeloom.operators import openapi, structs


def of(spark, fields, *wanted):
    rows = structs.components(spark.createDataFrame([(w,) for w in wanted], "type string"), spark.createDataFrame(fields, structs.FIELDS)).collect()
    return {r["struct"]: json.loads(r["schema"]) for r in rows}, {r["struct"]: r["id"] for r in rows}


def test_types(spark):
    cases = {
        "string": {"type": "string"}, "bool": {"type": "boolean"}, "int": {"type": "integer", "format": "int32"}, "uint64": {"type": "integer", "format": "int64"}, "float32": {"type": "number", "format": "float"}, "*string": {"type": ["string", "null"]}, "**int64": {"type": ["integer", "null"], "format": "int64"},
        "[]byte": {"type": "array", "items": {"type": "integer", "format": "int32"}}, "[3]*bool": {"type": "array", "items": {"type": ["boolean", "null"]}}, "map[string][]float64": {"type": "object", "additionalProperties": {"type": "array", "items": {"type": "number", "format": "double"}}},
        "any": {"type": "object"}, "*[]any": {"type": ["array", "null"], "items": {"type": "object"}}, "func()": None, "[]chan int": {"type": "array"}, "": None, None: None,
    }
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(cases)], "t string, i int").select("i", structs.rendered(structs.shape(F.col("t"))).alias("s")).orderBy("i").collect()
    assert [json.loads(r["s"]) if r["s"] else None for r in rows] == list(cases.values())
    ref = spark.range(1).select(structs.rendered(structs.shape(F.lit("[]*acme/x.User"))).alias("s")).first()["s"]
    assert json.loads(ref)["items"]["$ref"].startswith("#/components/schemas/User_") and len(ref.split("User_")[1].split('"')[0]) == 10


def test_tags(spark):
    fields = [("m.A", i, n, t, g, False) for i, (n, t, g) in enumerate([
        ("ID", "int64", 'json:"id,omitempty" binding:"required"'), ("Name", "string", 'validate:"min=1, required" example:"a \\"b\\"" default:"x"'), ("hidden", "string", None), ("Skip", "string", 'json:"-"'), ("Dash", "string", 'json:",omitempty"'), ("Ignored", "int", 'swaggerignore:"true"'),
        ("State", "string", 'json:"state" enums:"on, off,1,2.5"'), ("When", "time.Time", 'swaggertype:"string"'), ("Ids", "m.Set", 'swaggertype:"array,integer"'), ("Odd", "func()", None), ("Ref", "*m.B", 'example:"7"'),
    ])]
    got, ids = of(spark, fields, "*m.A")
    assert set(got) == {"m.A"} and got["m.A"]["required"] == ["Name", "id"]
    assert got["m.A"]["properties"] == {
        "id": {"type": "integer", "format": "int64"}, "Name": {"type": "string", "example": 'a \\"b\\"', "default": "x"}, "Dash": {"type": "string"}, "state": {"type": "string", "enum": ["on", "off", True, 2.5]}, "When": {"type": "string"}, "Ids": {"type": "array", "items": {"type": "integer"}},
        "Ref": {"$ref": "#/components/schemas/B_" + __import__("hashlib").sha256(b"m.B").hexdigest()[:10], "example": 7},
    }
    assert ids["m.A"].startswith("A_")


def test_structs_that_contain_each_other(spark):
    field = lambda s, o, n, t, e=False, g=None: (s, o, n, t, g, e)
    fields = [field("m.A", 0, "B", "[]m.B"), field("m.B", 0, "A", "*m.A"), field("m.B", 1, "C", "map[string]m.C"), field("m.C", 0, "Me", "m.C"), field("m.Far", 0, "X", "int"), field("m.D", 0, "Lost", "m.Gone")]
    got, ids = of(spark, fields, "m.A", "[]*m.A", "m.D", "string")
    assert set(got) == {"m.A", "m.B", "m.C", "m.D"} and len(set(ids.values())) == 4
    assert got["m.B"]["properties"]["A"]["$ref"].endswith(ids["m.A"]) and got["m.C"]["properties"]["Me"]["$ref"].endswith(ids["m.C"])
    rows = spark.createDataFrame([(ids[k], json.dumps(v)) for k, v in got.items()], "id string, schema string")
    assert [r["ref"].split("_")[0] for r in openapi.unknown_references(rows).collect()] == ["Gone"]
    assert of(spark, fields, "int") == ({}, {})


def test_embedded_structs(spark):
    field = lambda s, o, n, t, e=False, g=None: (s, o, n, t, g, e)
    fields = [
        field("m.Top", 0, "Mid", "m.Mid", True), field("m.Top", 1, "Other", "*m.Other", True), field("m.Top", 2, "Own", "string"), field("m.Top", 3, "Named", "m.Other", True, 'json:"named"'), field("m.Top", 4, "Alien", "lib.Alien", True),
        field("m.Mid", 0, "Base", "m.Base", True), field("m.Mid", 1, "Own", "int", False, 'binding:"required"'), field("m.Mid", 2, "Low", "bool"),
        field("m.Base", 0, "Low", "string", False, 'binding:"required"'), field("m.Base", 1, "Deep", "float64"), field("m.Base", 2, "Top", "*m.Top", True), field("m.Other", 0, "Deep", "string"), field("m.Other", 1, "More", "string"),
    ]
    got, _ = of(spark, fields, "m.Top")
    p = got["m.Top"]["properties"]
    assert set(p) == {"Own", "Low", "Deep", "More", "named", "Alien"}
    assert p["Own"] == {"type": "string"} and p["Low"] == {"type": "boolean"} and p["Deep"] == {"type": "number", "format": "double"} and "$ref" in p["named"] and "$ref" in p["Alien"]
    assert got["m.Top"]["required"] == ["Low", "Own"]
