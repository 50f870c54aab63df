"""Programs as rows against small interpreters: registrars, enforcement, constants, wrapped chains."""

import random
from collections import Counter

import pytest

from routeloom.operators import classify, constants, enforcement, registrars
from routeloom.operators.config import Config, Guard
from routeloom.plans import programs

# --- registrars


def step(func, ord_, kind, var=None, out=None, path=None, symbols=None, callee=None, param=None, method=None):
    return (func, ord_, kind, var, out, path, method or ("GET" if kind == "route" else None), symbols, callee, param)


def interpret(steps, known=None, depth=registrars.DEPTH):
    """Walk every function that builds an engine, with router values that change in place."""
    own = {}
    for s in sorted(steps, key=lambda s: s[1]):
        own.setdefault(s[0], []).append(s)
    known = set(own) if known is None else set(known)
    routes, diagnostics = Counter(), Counter()

    def join(base, rel):
        out = ("/" if base == "/" else base.rstrip("/") + "/") + rel.lstrip("/")
        return base if rel == "" else out

    def walk(entry, func, states, callers, level):
        returned = set()
        for _, ord_, kind, var, out, path, _, symbols, callee, param in own.get(func, []):
            value = states.get(var)
            if kind == "engine":
                states[out] = {"base": "/", "mw": []}
            elif kind == "return":
                returned.add(var)
            elif kind == "call":
                builds = any(s[2] == "engine" for s in own.get(callee, []))
                if var is None and not builds or var is not None and value is None:
                    continue
                if level >= depth:
                    diagnostics[entry, "gin-registrar-depth-exceeded"] += 1
                elif callee in callers:
                    diagnostics[entry, "gin-recursive-registrar"] += 1
                elif callee not in known:
                    if var is not None:
                        diagnostics[entry, "gin-unresolved-registrar"] += 1
                else:
                    inner = {param: value} if var is not None else {}
                    back = walk(entry, callee, inner, [*callers, callee], level + 1)
                    if var is None and out and len(back) == 1 and inner.get(next(iter(back))) is not None:
                        states[out] = inner[next(iter(back))]
            elif kind == "group":
                if path is None:
                    diagnostics[entry, "gin-unresolved-path"] += value is not None
                else:
                    states.pop(out, None)
                if path is not None and value is not None:
                    states[out] = {"base": join(value["base"], path), "mw": [*value["mw"], *(symbols or [])]}
            elif kind == "use":
                if value is not None:
                    value["mw"] += symbols or []
            elif value is None:
                diagnostics[entry, "gin-untracked-router-value"] += 1
            elif path is None:
                diagnostics[entry, "gin-unresolved-path"] += 1
            elif not symbols:
                diagnostics[entry, "gin-no-handlers"] += 1
            else:
                routes[entry, func, join(value["base"], path), (*value["mw"], *symbols[:-1]), symbols[-1]] += 1
        return returned

    for f in own:
        if any(s[2] == "engine" for s in own[f]):
            walk(f, f, {}, [f], 0)
    return routes, +diagnostics


def found(spark, steps, known=None, **more):
    frame = spark.createDataFrame(steps, registrars.STEPS)
    functions = None if known is None else spark.createDataFrame([(k,) for k in known], "func string")
    got = registrars.discover(frame, functions, **more)
    routes = Counter((r["entry"], r["func"], r["path"], tuple(r["chain"]), r["handler"]) for r in got.routes.collect())
    return routes, Counter((r["entry"], r["code"]) for r in got.diagnostics.collect())


def test_a_registrar_changes_its_caller_s_router(spark):
    steps = [
        step("main", 0, "engine", out="r"), step("main", 1, "use", "r", symbols=["A"]), step("main", 2, "group", "r", out="g", path="/api", symbols=["G"]), step("main", 3, "call", "r", callee="setup", param="e"), step("main", 4, "call", "g", callee="users", param="rg"),
        step("main", 5, "route", "r", path="/last", symbols=["H0"]), step("main", 6, "route", "g", path="/in", symbols=["M", "H1"]),
        step("setup", 0, "use", "e", symbols=["B"]), step("setup", 1, "call", "e", callee="setup", param="e"), step("setup", 2, "call", "e", callee="gone", param="x"),
        step("users", 0, "group", "rg", out="u", path="/users"), step("users", 1, "route", "u", path="/:id", symbols=["H2"]), step("users", 2, "use", "u", symbols=["L"]), step("users", 3, "route", "u", path="", symbols=["H3"]), step("users", 4, "call", "u", callee="deep", param="d"),
        step("deep", 0, "route", "d", path="/x", symbols=["H4"]), step("deep", 1, "route", "nope", path="/y", symbols=["H5"]), step("deep", 2, "route", "d", symbols=["H6"]), step("deep", 3, "route", "d", path="/z", symbols=[]),
        step("alone", 0, "route", "r", path="/never", symbols=["H7"]), step("lib", 0, "group", "r", out="g", path="/lib"),
    ]
    routes, diagnostics = found(spark, steps)
    assert (routes, diagnostics) == interpret(steps)
    assert routes == Counter({("main", "main", "/last", ("A", "B"), "H0"): 1, ("main", "main", "/api/in", ("A", "G", "M"), "H1"): 1, ("main", "users", "/api/users/:id", ("A", "G"), "H2"): 1, ("main", "users", "/api/users", ("A", "G", "L"), "H3"): 1, ("main", "deep", "/api/users/x", ("A", "G", "L"), "H4"): 1})
    parameters = spark.createDataFrame([("alone", "r"), ("lib", "r"), ("setup", "e"), ("main", "r"), ("lib", "other")], "func string, param string")
    assert {(r["func"], r["param"]) for r in registrars.library_entries(spark.createDataFrame(steps, registrars.STEPS), parameters).collect()} == {("alone", "r"), ("lib", "r")}
    assert {r["func"] for r in registrars.reachable(spark.createDataFrame(steps, registrars.STEPS)).collect()} >= {"main", "setup", "users", "deep"}


def test_factories_cycles_and_depth(spark):
    steps = [
        step("main", 0, "engine", out="own"), step("main", 1, "call", out="r", callee="outer"), step("main", 2, "route", "r", path="/a", symbols=["H"]), step("main", 3, "call", out="two", callee="unsure"), step("main", 4, "route", "two", path="/b", symbols=["H"]),
        step("outer", 0, "engine", out="x"), step("outer", 1, "call", out="e", callee="inner"), step("outer", 2, "use", "e", symbols=["O"]), step("outer", 3, "return", "e"),
        step("inner", 0, "engine", out="e"), step("inner", 1, "use", "e", symbols=["I"]), step("inner", 2, "route", "e", path="/health", symbols=["HH"]), step("inner", 3, "return", "e"),
        step("unsure", 0, "engine", out="p"), step("unsure", 1, "engine", out="q"), step("unsure", 2, "return", "p"), step("unsure", 3, "return", "q"),
        step("ping", 0, "engine", out="r"), step("ping", 1, "call", "r", callee="pong", param="r"), step("pong", 0, "call", "r", callee="ping2", param="r"), step("ping2", 0, "call", "r", callee="pong", param="r"),
    ]
    assert found(spark, steps) == interpret(steps)
    chain = [step("f0", 0, "engine", out="r"), *(step(f"f{i}", 1, "call", "r", callee=f"f{i + 1}", param="r") for i in range(9)), *(step(f"f{i}", 2, "route", "r", path=f"/{i}", symbols=["H"]) for i in range(10))]
    for depth in (3, 8, 32):
        routes, diagnostics = found(spark, chain, depth=depth)
        assert (routes, diagnostics) == interpret(chain, depth=depth) and sum(routes.values()) == min(depth, 9) + 1


@pytest.mark.parametrize("seed", range(3))
def test_random_programs(spark, seed):
    r, steps = random.Random(seed), []
    for f in range(14):
        names, n = (["r"] if f else []), 0
        if r.random() < 0.3 or not f:
            steps.append(step(f"f{f}", 0, "engine", out="n"))
            names.append("n")
        for o in range(1, r.randrange(3, 12)):
            var, kind = r.choice([*names, "lost"]), r.choice(["group", "use", "route", "route", "call", "call", "make"])
            if kind == "group":
                n += 1
                steps.append(step(f"f{f}", o, "group", var, out=f"g{n}", path=r.choice([f"/g{n}", f"/g{n}", None]), symbols=[f"s{o}"]))
                names.append(f"g{n}")
            elif kind == "use":
                steps.append(step(f"f{f}", o, "use", var, symbols=[f"u{f}.{o}"]))
            elif kind == "route":
                steps.append(step(f"f{f}", o, "route", var, path=r.choice(["/a", "/b", None]), symbols=r.choice([[f"h{o}"], ["m", f"h{o}"], []])))
            elif kind == "call":
                steps.append(step(f"f{f}", o, "call", var, callee=f"f{r.choice([f, f + 1, f + 2, f + 3])}", param="r"))
            else:
                n += 1
                steps.append(step(f"f{f}", o, "call", out=f"g{n}", callee=f"f{f + r.choice([1, 2])}"))
                names.append(f"g{n}")
        steps.append(step(f"f{f}", 50, "return", r.choice(names or ["r"])))
    assert found(spark, steps) == interpret(steps)


def test_an_engine_stands_before_a_parameter_of_its_name(spark):
    rows = []
    for i in range(40):
        main, inner = f"p.Main{i}", f"p.Inner{i}"
        rows += [step(main, 0, "engine", out="r"), step(main, 1, "group", "r", "g", "/outer", ["m"]), step(main, 2, "call", "g", callee=inner, param="r")]
        rows += [step(inner, 0, "engine", out="r"), step(inner, 1, "route", "r", path="/x", symbols=["h"]), step(inner, 2, "call", "r", callee=f"p.Leaf{i}", param="r")]
        rows += [step(f"p.Leaf{i}", 0, "route", "r", path="/y", symbols=["h"])]
    got = registrars.discover(spark.createDataFrame(rows, registrars.STEPS))
    assert got.diagnostics.isEmpty()
    assert Counter((r["path"], tuple(r["chain"])) for r in got.routes.collect()) == {("/x", ()): 80, ("/y", ()): 80}


def test_no_steps(spark):
    assert found(spark, []) == (Counter(), Counter())


# --- enforcement

T, N = True, None


def stmt(block, ord_, kind, on=None, method=None, then=None, receives=None, asks=None):
    return (block, ord_, kind, on, method, then, receives, asks)


def test_enforcement_shapes(spark):
    functions = [(n, p, b, t, h) for n, p, b, t, h in [
        ("direct", "p", "b1", T, False), ("logged", "p", "b2", T, False), ("waits", "p", "b3", T, False), ("late", "p", "b4", T, False), ("asks", "p", "b5", T, False), ("asksFar", "q", "b6", T, False), ("free", "p", "b7", T, False), ("opaque", "p", "b8", T, False),
        ("factory", "p", "f1", False, T), ("factory2", "p", "f2", False, T), ("factory3", "p", "f3", False, T), ("factory4", "p", "f4", False, T), ("farFactory", "q", "f5", False, T), ("twoReturns", "p", "f6", False, T), ("noSource", "p", N, T, False), ("plain", "p", "b9", False, False), ("noReturn", "p", "b10", T, False), ("empty", "p", "b11", T, False),
    ]]
    returns = [("f1", "literal", N, "lit", T), ("f2", "call", "factory", N, N), ("f3", "call", "factory2", N, N), ("f4", "call", "direct", N, N), ("f5", "call", "factory", N, N), ("f6", "literal", N, "lit", T), ("f6", "literal", N, "lit", T)]
    statements = [
        stmt("b1", 0, "if", then="t1"), stmt("t1", 0, "call", T, "AbortWithStatus"), stmt("t1", 1, "return"),
        stmt("b2", 0, "call", T, "Get"), stmt("b2", 1, "if", then="t2"), stmt("t2", 0, "call", False, "Println"), stmt("t2", 1, "call", T, "Abort"), stmt("t2", 2, "return"),
        stmt("b3", 0, "if", then="t3", receives=T), stmt("t3", 0, "call", T, "Abort"), stmt("t3", 1, "return"),
        stmt("b4", 0, "if", then="t4"), stmt("t4", 0, "call", T, "Abort"), stmt("t4", 1, "call", T, "Next"), stmt("t4", 2, "return"),
        stmt("b5", 0, "if", then="t5", asks="logged"), stmt("t5", 0, "return"), stmt("b6", 0, "if", then="t6", asks="logged"), stmt("t6", 0, "return"),
        stmt("b7", 0, "call", T, "Set"), stmt("b8", 0, "call", False, "check"), stmt("lit", 0, "if", then="t7"), stmt("t7", 0, "call", T, "AbortWithError"), stmt("t7", 1, "return"),
        stmt("b10", 0, "if", then="t8"), stmt("t8", 0, "call", T, "Abort"),
    ]
    calls = [("b1", T, "AbortWithStatus"), ("b2", False, "Println"), ("b2", T, "Abort"), ("b3", T, "Abort"), ("b4", T, "Abort"), ("b5", False, N), ("b6", False, N), ("b7", T, "Set"), ("b7", T, "Next"), ("b8", False, "check"), ("lit", T, "AbortWithError"), ("b10", T, "Abort")]
    frame = spark.createDataFrame
    rows = enforcement.shapes(frame(functions, enforcement.FUNCTIONS), frame(returns, enforcement.RETURNS), frame(statements, enforcement.STATEMENTS), frame(calls, enforcement.CALLS))
    got = {r["symbol"]: r["shape"] for r in rows.collect()}
    confirmed = {"direct", "logged", "asks", "factory", "factory2", "factory4"}
    assert got == {f[0]: "confirmed-shape" if f[0] in confirmed else "contradicted" if f[0] in ("free", "empty") else "unresolved" for f in functions}
    config = Config({"direct": Guard(), "free": Guard(), "other": Guard()})
    assert enforcement.guard_shapes(config, rows) == {"direct": "confirmed-shape", "free": "contradicted"}
    from test_operators import frame as evidence
    from test_operators import mw, route

    out = classify.classify(evidence(spark, [route(0, "GET", "/a", [mw("direct")]), route(1, "GET", "/b", [mw("free")])]), config, enforcement.guard_shapes(config, rows))
    assert {r["ord"]: r["auth"]["classificationBasis"] for r in out.collect()} == {0: "configured-guard-confirmed", 1: "configured-guard-contradicted"}


def test_wrapped_chains(spark):
    rows = [(1, "Outer", 2), (2, "Middle", 3), (3, "Inner", 4), (4, "Core", 5), (5, "Deep", None), (6, "W", 7), (7, None, 4), (8, "X", 99), (9, "Leaf", None)]
    got = {r["id"]: r["wrappedSymbols"] for r in enforcement.wrapped(spark.createDataFrame(rows, "id long, symbol string, first long")).collect()}
    assert got == {1: ["Middle", "Inner", "Core"], 2: ["Inner", "Core", "Deep"], 3: ["Core", "Deep"], 4: ["Deep"], 5: [], 6: [], 7: ["Core", "Deep"], 8: [], 9: []}


# --- constants


def brute_fold(node, nodes, held, bound, above=()):
    n = nodes.get(node)
    if n is None or node in above:
        return None
    kind, value, left, right, name, field = n
    if kind == "concat":
        a, b = (brute_fold(x, nodes, held, bound, (*above, node)) for x in (left, right))
        return None if a is None or b is None else a + b
    return {"literal": value, "variable": held.get(name), "field": bound.get((name, field))}.get(kind)


def test_constants(spark):
    r = random.Random(6)
    nodes = {f"n{i}": (r.choice(["concat", "concat", "literal", "variable", "field"] + ["other"] * (i % 9 == 0)), f"/{i}" if i % 13 else "", f"n{r.randrange(i + 1, i + 6)}", f"n{r.randrange(i + 1, i + 6)}", r.choice(["A", "B", "C", "D"]), r.choice(["Path", "Type"])) for i in range(45)}
    nodes |= {"loop": ("concat", None, "loop", "loop", None, None), "l1": ("concat", None, "l2", "n3", None, None), "l2": ("concat", None, "l1", "n3", None, None)}
    variables, writes = [("A", "/a"), ("B", "/b"), ("C", None), ("D", "/d"), ("D", "/e")], [("B",)]
    fields = [("c1", "A", "Path", "/pa"), ("c1", "B", "Path", "/pb"), ("c2", "A", "Type", "GET"), ("c2", "A", "Path", "/x"), ("c2", "A", "Path", "/y"), ("c3", "C", "Path", "/pc"), ("c3", "A", "Path", "/pd"), ("c3", "A", "Type", "T"), ("c3", "B", "Path", ""), ("c3", "B", "Type", "/t"), ("c3", "C", "Type", "/u"), ("c3", "D", "Path", "/v"), ("c3", "D", "Type", "/w")]
    wanted = [(c, n) for c in ("c1", "c2", "c3", None) for n in [*nodes, "gone"] if c]
    frame = spark.createDataFrame
    got = constants.folded(frame(wanted, "context string, id string"), frame([(k, *v) for k, v in nodes.items()], constants.NODES), frame(variables, "name string, value string"), frame(writes, "name string"), frame(fields, "context string, name string, field string, value string"))
    want = {}
    for c, n in wanted:
        many = Counter((b, f) for x, b, f, _ in set(fields) if x == c)
        bound = {(b, f): v for x, b, f, v in fields if x == c and many[b, f] == 1}
        want[c, n] = brute_fold(n, nodes, {"A": "/a"}, bound)
    assert {(r["context"], r["id"]): r["value"] for r in got.collect()} == want
    assert sum(v is not None for v in want.values()) > 40


def test_an_expression_is_opened_once_for_all_contexts(spark, monkeypatch):
    counts, real = [], constants.written

    def counted(frame, name):
        out = real(frame, name)
        if name == "parts":
            counts.append(out.count())
        return out

    monkeypatch.setattr(constants, "written", counted)
    nodes = spark.createDataFrame([("a", "concat", None, "b", "c", None, None), ("b", "literal", "/x", None, None, None, None), ("c", "field", None, None, None, "p", "Path")], constants.NODES)
    wanted = spark.range(50).selectExpr("cast(id AS string) AS context", "'a' AS id").union(spark.sql("SELECT CAST(NULL AS string), 'b'"))
    fields = spark.range(0, 50, 2).selectExpr("cast(id AS string) AS context", "'p' AS name", "'Path' AS field", "concat('/', id) AS value")
    nothing = spark.sql("SELECT 'n' AS name, 'v' AS value")
    got = {(r["context"], r["id"]): r["value"] for r in constants.folded(wanted, nodes, nothing, nothing.select("name"), fields).collect()}
    assert got == {(str(i), "a"): f"/x/{i}" if i % 2 == 0 else None for i in range(50)} | {(None, "b"): "/x"}
    assert sum(counts) == 3


def test_depth_has_no_limit(spark, monkeypatch):
    monkeypatch.setattr(constants, "LEVELS", 20, raising=False)
    n, frame = 66, spark.createDataFrame
    nodes = [(f"e{i}", "concat", None, f"e{i + 1}", f"t{i}", None, None) for i in range(n)] + [(f"t{i}", "literal", f"/{i}", None, None, None, None) for i in range(n)] + [(f"e{n}", "literal", "/a", None, None, None, None)]
    nodes += [(f"l{i}", "concat", None, f"l{(i + 1) % 5}", "t0", None, None) for i in range(5)]
    nothing = spark.sql("SELECT 'n' AS name, 'v' AS value")
    wanted = frame([("c", "e0"), ("c", f"e{n - 1}"), ("c", "l0")], "context string, id string")
    got = {r["id"]: r["value"] for r in constants.folded(wanted, frame(nodes, constants.NODES), nothing, nothing.select("name"), nothing.selectExpr("'c' AS context", "name", "'f' AS field", "value")).collect()}
    assert got == {"e0": "/a" + "".join(f"/{i}" for i in reversed(range(n))), f"e{n - 1}": f"/a/{n - 1}", "l0": None}


@pytest.mark.parametrize("few", [constants.FEW, 40])
def test_folded_paths_asks_for_all_parts_and_suppliers(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(constants, "FEW", few)
    parts, suppliers, orders = 1200, 60, 2500
    for table, key, n in (("part", "p_partkey", parts), ("supplier", "s_suppkey", suppliers), ("customer", "c_custkey", 40)):
        spark.range(n).withColumnRenamed("id", key).write.parquet(f"{tmp_path}/{table}.parquet")
    spark.range(orders).selectExpr("id AS o_orderkey", "id % 40 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    nodes = {}
    for k in range(parts):
        if k > 0 and 2 * k + 1 < parts and k % 3 != 1:
            nodes[k] = ("concat", None, 2 * k, 2 * k + 1, None, None)
        else:
            kind = {1: "variable", 2: "field"}.get(k % 7, "other" if k % 61 == 5 else "literal")
            nodes[k] = (kind, f"/{k % 17}", None, None, k % suppliers if kind == "variable" else "route", "Type" if k % 2 else "Path")
    held = {s: f"/s{s}" for s in range(suppliers) if s % 9 != 4 and s % 11 != 3}
    want = {(str(c), str(i)): brute_fold(i, nodes, held, {("route", "Path"): f"/c{c % 8}"} if c % 4 != 1 else {}) for c, i in {(o % 40, o % parts) for o in range(orders)}}
    got = {(r["context"], r["id"]): r["value"] for r in programs.folded_paths(spark, str(tmp_path)).collect()}
    assert got == want
    assert {i for _, i in got} == {str(k) for k in range(parts)}
    assert {v for v in got.values() if v and v in held.values()} == set(held.values())
