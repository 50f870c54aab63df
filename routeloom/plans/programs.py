"""Registered queries over programs: a call graph with router steps made of `orders` and `customer`, and the same in DuckDB SQL.

Every order is a step of its customer's function, in order of its key. Every 50th customer's function builds an engine
and calls a factory for another one. Calls go to three functions by number, so they reach seven levels and more; some
go to the function itself, some to functions that aren't there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import constants, enforcement, registrars, structs
from ..sinks.tables import written

KINDS = ("group", "use", "route", "route", "route", "route", "call", "call")


def steps(spark: SparkSession, d: str) -> DataFrame:
    """STEPS of the registrars module."""
    orders, customers = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "customer"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name, kind = (lambda n: F.concat(F.lit("acme/app.F"), n.cast("string"))), F.element_at(F.array(*map(F.lit, KINDS)), (k % 8 + 1).cast("int"))
    group = F.last(F.when(k % 8 == 0, k), ignorenulls=True).over(Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1))
    late = F.when(group.isNotNull() & (k % 3 == 0), F.concat(F.lit("g"), group.cast("string"))).otherwise("r")
    var = F.when((k % 8 == 4) & (c % 50 == 0), "h").when(k % 8 == 5, "lost").otherwise(late)
    callee = F.when(k % 8 == 6, name(c * 3 + k % 3 + 1)).when(k % 8 == 7, name(c))
    symbol = F.concat(F.lit("acme/mw.M"), (k % 11).cast("string"))
    own = orders.select(
        name(c).alias("func"), (k + 2).cast("int").alias("ord"), kind.alias("kind"), var.alias("var"), F.when(k % 8 == 0, F.concat(F.lit("g"), k.cast("string"))).alias("out"),
        F.when((k % 8 < 6) & (k % 8 != 1) & (k % 56 != 2), F.concat(F.lit("/p"), (k % 97).cast("string"), F.when(k % 5 == 0, "/").otherwise(""))).alias("path"), F.when((k % 8 >= 2) & (k % 8 < 6), "GET").alias("method"),
        F.when(k % 8 == 0, F.array(symbol)).when(k % 8 == 1, F.array(symbol, F.lit("acme/mw.Last"))).when(k % 8 < 6, F.array(symbol, F.concat(F.lit("acme/api.H"), (k % 7).cast("string")))).alias("symbols"), callee.alias("callee"), F.when(k % 8 > 5, "r").alias("param"),
    )
    main = customers.where("c_custkey % 50 = 0")
    step = lambda frame, func, ord_, kind, **more: frame.select(func.alias("func"), F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), *(more.get(x, F.lit(None)).cast("array<string>" if x == "symbols" else "string").alias(x) for x in ("var", "out", "path", "method", "symbols", "callee", "param")))
    factories = main.select((F.col("c_custkey") % 3).alias("i")).distinct()
    factory = lambda i: F.concat(F.lit("acme/app.New"), i.cast("string"))
    more = [
        step(main, name(F.col("c_custkey")), 0, "engine", out=F.lit("r")),
        step(main, name(F.col("c_custkey")), 1, "call", out=F.lit("h"), callee=factory(F.col("c_custkey") % 3)),
        step(factories, factory(F.col("i")), 0, "engine", out=F.lit("e")),
        step(factories, factory(F.col("i")), 1, "use", var=F.lit("e"), symbols=F.array(F.lit("acme/mw.Built"))),
        step(factories, factory(F.col("i")), 2, "return", var=F.lit("e")),
    ]
    for frame in more:
        own = own.unionByName(frame)
    return own


def registrar_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes of the program with their paths and chains, through all calls."""
    rows = registrars.discover(steps(spark, d)).routes
    return rows.select("entry", "at", "func", "method", "path", "normalizedPath", F.array_join("chain", ",").alias("chain"), "handler")


def registrar_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return registrars.discover(steps(spark, d)).diagnostics


def library_entries(spark: SparkSession, d: str) -> DataFrame:
    """Functions with a router parameter that nothing calls; parts stand for functions of a library, orders of their numbers for calls."""
    own = steps(spark, d)
    parameters = own.select("func").distinct().select("func", F.lit("r").alias("param"))
    return registrars.library_entries(own, parameters)


def code(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Functions, returns, statements and calls: an order is a function, its items are statements, a fourth are factories.

    Orders and items are joined and written once: all four are projections of the two.
    """
    orders, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "lineitem"))
    k, m = F.col("k"), F.floor(F.col("k") / 4)
    name = lambda n: F.concat(F.lit("acme/auth.G"), n.cast("string"))
    own = orders.select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 40).cast("string").alias("package"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("next"))
    own = written(own, "functions")
    body = F.concat(F.lit("b"), k.cast("string"))
    functions = own.select(name(k).alias("func"), "package", F.when(k % 23 != 0, body).alias("body"), (k % 4 != 0).alias("takes_context"), (k % 4 == 0).alias("returns_handler"))
    n = F.explode(F.sequence(F.lit(1), F.when(m % 4 == 3, 2).otherwise(1)))
    returns = own.where(k % 4 == 0).select("k", "next", n.alias("n"))
    returns = returns.select(body.alias("body"), F.when(m % 4 == 0, "literal").when(m % 4 == 3, "literal").otherwise("call").alias("kind"), F.when(m % 4 == 1, name(F.col("next"))).when(m % 4 == 2, name(k + 1)).alias("callee"), F.concat(F.lit("l"), k.cast("string")).alias("literal"), (m % 8 != 4).alias("literal_takes_context"))
    rows = items.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).distinct().join(own.select("k", "next"), "k")
    rows = written(rows, "statements")
    block = F.concat(F.when(k % 4 == 0, "l").otherwise("b"), k.cast("string"))
    rows = rows.withColumns({"block": block, "step": (F.col("p") + F.col("n")) % 3, "then": F.concat_ws("-", F.lit("t"), "k", "n", "p", "s"), "way": F.col("s") % 6})
    call = lambda on, method: F.struct(F.lit("call").alias("kind"), F.lit(on).alias("on_context"), F.lit(method).alias("method"))
    back = F.struct(F.lit("return").alias("kind"), F.lit(None).cast("boolean").alias("on_context"), F.lit(None).cast("string").alias("method"))
    ways = [[call(True, "AbortWithStatus"), back], [call(True, "Next"), back], [back], [call(True, "Abort"), call(True, "JSON")], [call(False, "Printf"), call(True, "AbortWithError"), back], [call(False, "Abort"), back]]
    inside = F.array(*(F.array(*w) for w in ways))[F.col("way").cast("int")]
    asks = F.when((F.col("way") == 2) & F.col("next").isNotNull(), name(F.col("next")))
    none = lambda kind: F.lit(None).cast(kind)
    top = rows.select("block", F.col("n").cast("int").alias("ord"), F.element_at(F.array(F.lit("if"), F.lit("call"), F.lit("other")), (F.col("step") + 1).cast("int")).alias("kind"), (F.col("p") % 7 != 0).alias("on_context"), F.lit("Set").alias("method"), F.when(F.col("step") == 0, F.col("then")).alias("then"), (F.col("p") % 9 == 0).alias("receives"), F.when(F.col("step") == 0, asks).alias("asks"))
    under = rows.where("step = 0").select(F.col("block").alias("body"), F.col("then").alias("block"), F.posexplode(inside).alias("ord", "e")).select("body", "block", "ord", "e.*")
    statements = top.unionByName(under.select("block", "ord", "kind", "on_context", "method", none("string").alias("then"), none("boolean").alias("receives"), none("string").alias("asks")))
    calls = top.where("kind = 'call'").select(F.col("block").alias("body"), "on_context", "method").union(top.where("asks is not null").select("block", F.lit(False), none("string"))).union(under.where("kind = 'call'").select("body", "on_context", "method"))
    return functions, returns, statements, calls


def enforcement_shapes(spark: SparkSession, d: str) -> DataFrame:
    return enforcement.shapes(*code(spark, d))


def wrapped_chains(spark: SparkSession, d: str) -> DataFrame:
    """Orders as expressions: two thirds are calls whose first argument is the order of half the number."""
    k = F.col("o_orderkey")
    rows = spark.read.parquet(f"{d}/orders.parquet").select(k.alias("id"), F.when(k % 7 != 0, F.concat(F.lit("acme/mw.W"), (k % 13).cast("string"))).alias("symbol"), F.when(k % 3 != 0, F.floor(k / 2)).alias("first"))
    return enforcement.wrapped(rows).select("id", F.array_join("wrappedSymbols", ",").alias("wrapped"))


def folded_paths(spark: SparkSession, d: str) -> DataFrame:
    """Expressions over the numbers of parts: part n joins parts 2n and 2n+1 where both are there; leaves are of all kinds, variables are the suppliers. Contexts are customers; each wants the parts of its orders' numbers, which go round all parts."""
    parts, orders, suppliers, customers = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("part", "orders", "supplier", "customer"))
    k, most, last = F.col("p_partkey"), parts.agg(F.max("p_partkey").alias("most")), suppliers.agg(F.max("s_suppkey").alias("last"))
    text = lambda c: c.cast("string")
    joins = (k > 0) & (2 * k + 1 <= F.col("most")) & (k % 3 != 1)
    leaf = F.when(k % 7 == 1, "variable").when(k % 7 == 2, "field").when(k % 61 == 5, "other").otherwise("literal")
    nodes = parts.join(F.broadcast(most)).join(F.broadcast(last)).select(text(k).alias("id"), F.when(joins, "concat").otherwise(leaf).alias("kind"), F.concat(F.lit("/"), text(k % 17)).alias("value"), text(2 * k).alias("left"), text(2 * k + 1).alias("right"), F.when(k % 7 == 1, F.concat(F.lit("v"), text(k % (F.col("last") + 1)))).when(k % 7 == 2, F.lit("route")).alias("name"), F.element_at(F.array(F.lit("Path"), F.lit("Type")), (k % 2 + 1).cast("int")).alias("field"))
    variables = suppliers.select(F.concat(F.lit("v"), text(F.col("s_suppkey"))).alias("name"), F.when(F.col("s_suppkey") % 9 != 4, F.concat(F.lit("/s"), text(F.col("s_suppkey")))).alias("value"))
    writes = suppliers.where("s_suppkey % 11 = 3").select(F.concat(F.lit("v"), text(F.col("s_suppkey"))).alias("name"))
    fields = customers.where("c_custkey % 4 <> 1").select(text(F.col("c_custkey")).alias("context"), F.lit("route").alias("name"), F.lit("Path").alias("field"), F.concat(F.lit("/c"), text(F.col("c_custkey") % 8)).alias("value"))
    wanted = orders.join(F.broadcast(most)).select(text(F.col("o_custkey")).alias("context"), text(F.col("o_orderkey") % (F.col("most") + 1)).alias("id")).distinct()
    return constants.folded(wanted, nodes, variables, writes, fields)


def struct_components(spark: SparkSession, d: str) -> DataFrame:
    """Parts are structs, the orders of their items fields; some embed other parts. Suppliers say which are wanted."""
    items, suppliers, parts = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("lineitem", "supplier", "part"))
    o, s, n = F.col("o"), F.col("s"), F.col("n")
    rows = items.groupBy(F.col("l_partkey").alias("p"), F.col("l_orderkey").alias("o")).agg(F.min("l_suppkey").alias("s")).join(F.broadcast(parts.agg(F.max("p_partkey").alias("n"))))
    name, pick = (lambda k: F.concat(F.lit("acme/m.T"), k.cast("string"))), (lambda i, *c: F.element_at(F.array(*map(F.lit, c)), (i + 1).cast("int")))
    embedded = o % 101 == 0
    base = F.when(embedded | (o % 6 == 2), name((o * 7) % n)).otherwise(pick(o % 6, "string", "int64", "", "float32", "time.Time", "func()"))
    kind = F.when(embedded, F.concat(pick(o % 2, "", "*"), base)).otherwise(F.concat(pick(o % 4, "", "*", "[]", "map[string]"), pick(s % 3, "", "[]", "*"), base))
    tag = F.when(embedded, "").when(o % 7 == 0, F.concat(F.lit('json:"j'), (o % 11).cast("string"), F.lit(',omitempty"'))).when(o % 7 == 1, 'json:"-"').when(o % 7 == 2, 'binding:"required"').when(o % 7 == 3, 'json:"k" validate:"min=1, required" example:"5"')
    field = F.when(embedded, F.concat(F.lit("T"), ((o * 7) % n).cast("string"))).when(o % 13 == 0, "lower").otherwise(F.concat(F.lit("F"), (o % 50).cast("string")))
    fields = rows.select(name(F.col("p")).alias("struct"), o.cast("int").alias("ord"), field.alias("name"), kind.alias("type"), tag.alias("tag"), embedded.alias("embedded"))
    return structs.components(suppliers.select(F.concat(F.lit("[]"), name(F.col("s_suppkey") * 3)).alias("type")), fields).select("id", "struct", "schema")


PROGRAM = """
RECURSIVE o AS (
  SELECT *, o_orderkey AS k, o_custkey AS c, last_value(CASE WHEN o_orderkey % 8 = 0 THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM orders
), own AS (
  SELECT 'acme/app.F' || c AS func, lpad(CAST(k + 2 AS VARCHAR), 9, '0') || '.' AS s, k % 8 AS m, CASE WHEN k % 8 = 4 AND c % 50 = 0 THEN 'h' WHEN k % 8 = 5 THEN 'lost' WHEN g IS NOT NULL AND k % 3 = 0 THEN 'g' || g ELSE 'r' END AS var, 'g' || k AS out,
    CASE WHEN k % 8 < 6 AND k % 8 <> 1 AND k % 56 <> 2 THEN '/p' || (k % 97) || CASE WHEN k % 5 = 0 THEN '/' ELSE '' END END AS path, 'acme/mw.M' || (k % 11) AS mw, 'acme/api.H' || (k % 7) AS h,
    CASE k % 8 WHEN 6 THEN 'acme/app.F' || (c * 3 + k % 3 + 1) WHEN 7 THEN 'acme/app.F' || c END AS callee FROM o
), fn AS (
  SELECT DISTINCT func FROM own UNION SELECT 'acme/app.F' || c_custkey FROM customer WHERE c_custkey % 50 = 0
), main AS (
  SELECT 'acme/app.F' || c_custkey AS func FROM customer WHERE c_custkey % 50 = 0
), inst AS (
  SELECT func AS entry, '' AS at, func, [func] AS callers, '' AS r_at, 'r' AS r_var, true AS builds, 0 AS depth FROM main
  UNION ALL
  SELECT i.entry, i.at || own.s, own.callee, list_append(i.callers, own.callee), CASE WHEN main.func IS NOT NULL THEN i.at || own.s WHEN own.var = 'r' THEN i.r_at WHEN own.var = 'h' THEN i.at || '000000001.' ELSE i.at END,
    CASE WHEN main.func IS NOT NULL THEN 'r' WHEN own.var = 'r' THEN i.r_var WHEN own.var = 'h' THEN 'e' ELSE own.var END, main.func IS NOT NULL, i.depth + 1
  FROM inst i JOIN own ON own.func = i.func AND own.m >= 6 JOIN fn ON fn.func = own.callee LEFT JOIN main ON main.func = own.callee WHERE NOT list_contains(i.callers, own.callee) AND i.depth < 32
), ev AS (
  SELECT i.entry, i.at, i.depth, own.*, i.at || own.s AS t, CASE WHEN own.var = 'r' THEN i.r_at WHEN own.var = 'h' THEN i.at || '000000001.' ELSE i.at END AS v_at,
    CASE WHEN own.var = 'r' THEN i.r_var WHEN own.var = 'h' THEN 'e' WHEN own.var = 'lost' THEN NULL ELSE own.var END AS v_var
  FROM inst i JOIN own USING (func)
), uses AS (
  SELECT entry, v_at, v_var, t, [mw, 'acme/mw.Last'] AS mws FROM ev WHERE m = 1
  UNION ALL SELECT entry, inst.at || '000000001.', 'e', inst.at || '000000001.000000001.', ['acme/mw.Built'] FROM inst WHERE builds
), val AS (
  SELECT entry, inst.at AS v_at, var AS v_var, CASE var WHEN 'e' THEN inst.at || '000000001.' ELSE inst.at END AS x_at, '/' AS base, CAST([] AS VARCHAR[]) AS inherited FROM inst, (VALUES ('r'), ('e')) n(var) WHERE builds
  UNION ALL
  SELECT ev.entry, ev.at, ev.out, ev.at, CASE WHEN base = '/' THEN ev.path ELSE rtrim(base, '/') || ev.path END,
    list_concat(list_concat(inherited, coalesce((SELECT flatten(list(mws ORDER BY u.t)) FROM uses u WHERE u.entry = ev.entry AND u.v_at = ev.v_at AND u.v_var = ev.v_var AND u.t < ev.t), [])), [mw])
  FROM val JOIN ev ON ev.m = 0 AND ev.path IS NOT NULL AND ev.entry = val.entry AND ev.v_at = val.x_at AND ev.v_var = val.v_var
), rt AS (
  SELECT ev.*, val.base, list_concat(inherited, coalesce((SELECT flatten(list(mws ORDER BY u.t)) FROM uses u WHERE u.entry = ev.entry AND u.v_at = ev.v_at AND u.v_var = ev.v_var AND u.t < ev.t), [])) AS chain, CASE WHEN base = '/' THEN path ELSE rtrim(base, '/') || path END AS full_path
  FROM ev LEFT JOIN val ON val.entry = ev.entry AND val.x_at = ev.v_at AND val.v_var = ev.v_var WHERE ev.m BETWEEN 2 AND 5
)"""

CODE = """
RECURSIVE f AS (
  SELECT o_orderkey AS k, o_custkey % 40 AS package, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt, o_orderkey % 23 <> 0 AS src, o_orderkey // 4 AS m FROM orders
), li AS (
  SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s FROM lineitem SEMI JOIN orders ON o_orderkey = l_orderkey
), b AS (
  SELECT f.k, coalesce(bool_or((p + n) % 3 = 0 AND s % 6 IN (0, 4) AND p % 9 <> 0), false) AS direct, coalesce(bool_or((p + n) % 3 = 0 AND s % 6 = 2), false) AND any_value(nxt) IS NOT NULL AS asks,
    coalesce(bool_or((p + n) % 3 = 1 AND p % 7 = 0 OR (p + n) % 3 = 0 AND (s % 6 IN (0, 3, 4, 5) OR s % 6 = 2 AND nxt IS NOT NULL)), false) AS open FROM f LEFT JOIN li USING (k) GROUP BY f.k
), r AS (
  SELECT k, k AS at, package, 0 AS hops FROM f
  UNION ALL SELECT r.k, g.k, r.package, hops + 1 FROM r JOIN f ON f.k = r.at AND f.src AND f.k % 4 = 0 AND f.m % 4 IN (1, 2) JOIN f g ON g.k = CASE f.m % 4 WHEN 1 THEN f.nxt ELSE f.k + 1 END AND g.package = r.package WHERE hops < 2
), found AS (
  SELECT r.k, f.k AS at, f.package, f.nxt FROM r JOIN f ON f.k = r.at AND f.src WHERE f.k % 4 <> 0 OR hops < 2 AND f.m % 4 = 0 AND f.m % 8 <> 4
), marks AS (
  SELECT found.k, bool_or(b.direct) AS direct, bool_or(b.asks AND h.k IS NOT NULL AND hb.direct) AS asked, bool_or(NOT b.open) AS free
  FROM found JOIN b ON b.k = found.at LEFT JOIN f h ON h.k = found.nxt AND h.k % 4 <> 0 AND h.src AND h.package = found.package LEFT JOIN b hb ON hb.k = h.k GROUP BY found.k
)
SELECT 'acme/auth.G' || k AS symbol, CASE WHEN direct OR asked THEN 'confirmed-shape' WHEN free THEN 'contradicted' ELSE 'unresolved' END AS shape FROM f LEFT JOIN marks USING (k)"""
FOLDED = """
RECURSIVE top AS (SELECT max(p_partkey) AS most, (SELECT max(s_suppkey) FROM supplier) AS last FROM part), w AS (
  SELECT DISTINCT o_custkey AS context, o_orderkey % (most + 1) AS id FROM orders, top
), e AS (
  SELECT context, id AS root, id, '' AS pos FROM w
  UNION ALL SELECT context, root, 2 * id + side, pos || CASE side WHEN 0 THEN 'l' ELSE 'r' END FROM e JOIN part ON p_partkey = id, top, (VALUES (0), (1)) s(side) WHERE id > 0 AND 2 * id + 1 <= most AND id % 3 <> 1
), v AS (
  SELECT context, root, pos, CASE WHEN p_partkey IS NULL THEN NULL WHEN id % 7 = 1 THEN CASE WHEN s_suppkey IS NOT NULL THEN '/s' || s_suppkey END
      WHEN id % 7 = 2 THEN CASE WHEN id % 2 = 0 AND c_custkey IS NOT NULL THEN '/c' || (c_custkey % 8) END WHEN id % 61 = 5 THEN NULL ELSE '/' || (id % 17) END AS value
  FROM e CROSS JOIN top LEFT JOIN part ON p_partkey = id LEFT JOIN supplier ON s_suppkey = id % (last + 1) AND s_suppkey % 9 <> 4 AND s_suppkey % 11 <> 3 LEFT JOIN customer ON c_custkey = context AND c_custkey % 4 <> 1
  WHERE NOT (p_partkey IS NOT NULL AND id > 0 AND 2 * id + 1 <= most AND id % 3 <> 1)
)
SELECT CAST(context AS VARCHAR) AS context, CAST(root AS VARCHAR) AS id, CASE WHEN count(value) = count(*) THEN string_agg(value, '' ORDER BY pos) END AS value FROM v GROUP BY context, root"""

STRUCTS = r"""
RECURSIVE top AS (SELECT max(p_partkey) AS n FROM part), li AS (
  SELECT l_partkey AS p, l_orderkey AS o, min(l_suppkey) AS s, n FROM lineitem, top GROUP BY ALL
), f AS (
  SELECT p, o, o % 101 = 0 AS emb, CASE WHEN o % 101 = 0 OR o % 6 = 2 THEN (o * 7) % n END AS r, CASE o % 6 WHEN 2 THEN NULL WHEN 4 THEN 'time.Time' END AS other, CASE o % 6 WHEN 0 THEN 'string' WHEN 1 THEN 'integer' WHEN 3 THEN 'number' END AS t, CASE o % 6 WHEN 1 THEN '"format":"int64",' WHEN 3 THEN '"format":"float",' ELSE '' END AS fmt,
    CASE WHEN o % 101 = 0 THEN o % 2 ELSE o % 4 END AS w2, CASE WHEN o % 101 = 0 THEN 0 ELSE s % 3 END AS w1, CASE WHEN o % 101 = 0 THEN -1 ELSE o % 7 END AS tag FROM li
), b AS (
  SELECT *, coalesce('acme/m.T' || r, other) AS target, CASE WHEN coalesce('acme/m.T' || r, other) IS NOT NULL THEN '{"$ref":"#/components/schemas/' || list_last(string_split(coalesce('acme/m.T' || r, other), '.')) || '_' || substr(sha256(coalesce('acme/m.T' || r, other)), 1, 10) || '"}' WHEN t IS NOT NULL THEN '{' || fmt || '"type":"' || t || '"}' END AS b,
    CASE WHEN coalesce('acme/m.T' || r, other) IS NULL AND t IS NOT NULL THEN '{' || fmt || '"type":["' || t || '","null"]}' END AS bn FROM f
), w AS (
  SELECT *, CASE w1 WHEN 0 THEN b WHEN 1 THEN '{' || coalesce('"items":' || b || ',', '') || '"type":"array"}' ELSE coalesce(bn, b) END AS s1, CASE w1 WHEN 1 THEN '{' || coalesce('"items":' || b || ',', '') || '"type":["array","null"]}' ELSE coalesce(bn, b) END AS s1n FROM b
), v AS (
  SELECT *, CASE w2 WHEN 0 THEN s1 WHEN 1 THEN s1n WHEN 2 THEN '{' || coalesce('"items":' || s1 || ',', '') || '"type":"array"}' ELSE '{' || coalesce('"additionalProperties":' || s1 || ',', '') || '"type":"object"}' END AS sch FROM w
), own AS (
  SELECT p, o, emb, r, CASE tag WHEN 0 THEN 'j' || (o % 11) WHEN 3 THEN 'k' ELSE CASE WHEN emb THEN 'T' || r ELSE 'F' || (o % 50) END END AS prop, tag IN (2, 3) AS req,
    CASE WHEN tag <> 3 OR sch IS NULL THEN sch WHEN sch LIKE '{"$ref"%' THEN sch[:-2] || ',"example":5}' WHEN w2 = 3 THEN regexp_replace(sch, '"type":"object"\}$', '"example":5,"type":"object"}') ELSE '{"example":5,' || sch[2:] END AS sch
  FROM v WHERE tag <> 1 AND (emb OR o % 13 <> 0)
), st AS (
  SELECT DISTINCT p FROM f
), edge AS (
  SELECT DISTINCT p, r FROM f WHERE r IS NOT NULL
), reach AS (
  SELECT s_suppkey * 3 AS p FROM supplier SEMI JOIN st ON st.p = s_suppkey * 3
  UNION SELECT edge.r FROM reach JOIN edge ON edge.p = reach.p JOIN st ON st.p = edge.r
), plain AS (
  SELECT own.p, prop, sch, req, '0' || lpad(CAST(999999999 - o AS VARCHAR), 9, '0') AS place FROM own LEFT JOIN st ON st.p = own.r WHERE NOT emb OR st.p IS NULL
), walk AS (
  SELECT own.p, own.r AS inside, '1' || lpad(CAST(o AS VARCHAR), 9, '0') AS place, [own.p, own.r] AS above FROM own JOIN st ON st.p = own.r WHERE emb
  UNION ALL SELECT walk.p, own.r, place || '1' || lpad(CAST(own.o AS VARCHAR), 9, '0'), list_append(above, own.r) FROM walk JOIN own ON own.p = walk.inside AND own.emb JOIN st ON st.p = own.r WHERE NOT list_contains(above, own.r)
), every AS (
  SELECT * FROM plain UNION ALL SELECT walk.p, prop, sch, req, walk.place || plain.place FROM walk JOIN plain ON plain.p = walk.inside
), won AS (
  SELECT p, prop, arg_min(sch, place) FILTER (sch IS NOT NULL OR true) AS sch FROM (SELECT p, prop, sch, place FROM every QUALIFY row_number() OVER (PARTITION BY p, prop ORDER BY place) = 1) GROUP BY 1, 2
), body AS (
  SELECT p, string_agg('"' || prop || '":' || sch, ',' ORDER BY prop) AS props FROM won WHERE sch IS NOT NULL GROUP BY 1
), must AS (
  SELECT p, string_agg('"' || prop || '"', ',' ORDER BY prop) AS must FROM every WHERE req GROUP BY 1
)
SELECT 'T' || p || '_' || substr(sha256('acme/m.T' || p), 1, 10) AS id, 'acme/m.T' || p AS struct, '{' || coalesce('"properties":{' || props || '},', '') || coalesce('"required":[' || must || '],', '') || '"type":"object"}' AS schema FROM (SELECT DISTINCT p FROM reach) LEFT JOIN body USING (p) LEFT JOIN must USING (p)"""

ALL = (registrar_routes, registrar_diagnostics, library_entries, enforcement_shapes, wrapped_chains, folded_paths, struct_components)


def queries() -> dict:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "enforcement_shapes": f"WITH {CODE}",
        "folded_paths": f"WITH {FOLDED}",
        "struct_components": f"WITH {STRUCTS}",
        "wrapped_chains": """WITH e AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN 'acme/mw.W' || (o_orderkey % 13) END AS symbol, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey // 2 END AS nxt FROM orders)
          SELECT e.id, concat_ws(',', a.symbol, b.symbol, c.symbol) AS wrapped FROM e LEFT JOIN e a ON a.id = e.nxt LEFT JOIN e b ON b.id = a.nxt AND a.symbol IS NOT NULL LEFT JOIN e c ON c.id = b.nxt AND b.symbol IS NOT NULL""",
        "registrar_routes": f"""WITH {PROGRAM} SELECT entry, t AS at, func, 'GET' AS method, full_path AS path, full_path AS "normalizedPath", array_to_string(list_append(chain, mw), ',') AS chain, h AS handler FROM rt WHERE base IS NOT NULL AND path IS NOT NULL""",
        "registrar_diagnostics": f"""WITH {PROGRAM} SELECT entry, t AS at, func, 'gin-untracked-router-value' AS code FROM rt WHERE base IS NULL UNION ALL SELECT entry, t, func, 'gin-unresolved-path' FROM rt WHERE base IS NOT NULL AND path IS NULL
          UNION ALL SELECT ev.entry, t, ev.func, CASE WHEN ev.depth >= 32 THEN 'gin-registrar-depth-exceeded' WHEN m = 7 THEN 'gin-recursive-registrar' ELSE 'gin-unresolved-registrar' END FROM ev JOIN val ON val.entry = ev.entry AND val.x_at = ev.v_at AND val.v_var = ev.v_var WHERE m >= 6 AND (m = 7 OR callee NOT IN (SELECT func FROM fn) OR ev.depth >= 32)""",
        "library_entries": f"""WITH {PROGRAM} SELECT DISTINCT func, 'r' AS param, 'gin-library-entry-point' AS code FROM own WHERE m < 6 AND var = 'r' AND func NOT IN (SELECT callee FROM own WHERE callee IS NOT NULL) AND func NOT IN (SELECT 'acme/app.F' || c_custkey FROM customer WHERE c_custkey % 50 = 0)""",
    }
