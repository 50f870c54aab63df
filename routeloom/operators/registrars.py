"""Routes of a whole program: router values followed through groups, registrar calls and engine factories.

Input are the steps of function bodies that touch router values, in source order (`STEPS`); a variable has one
definition in its function. Calls are followed from every function that builds an engine, as if their bodies stood
where they are called: a middleware that a registrar adds holds for what its caller registers later. A place in the
program is a text that sorts in this order, the numbers of the calls on the way and of the step.

Four plans of joins, each level of a recursion written before the next: instances of functions (the frontier meets the
calls), references to values (pointer doubling), values (groups meet their parents' middleware at the time they were
made), routes. Joins are on function, place and value; nothing is gathered but the middleware of one value.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import join_paths, normalize_path
from ..sinks.tables import written

#: kind: engine (binds out), group (of var, binds out), use (on var), route (on var), call (var is passed to the
#: callee's param, or out is bound to the engine that it returns), return (of var).
STEPS = "func string, ord int, kind string, var string, out string, path string, method string, symbols array<string>, callee string, param string"
DEPTH = 32
DIGITS = 9  # of a step's number in a place
RELEVANT = ("route", "use", "group")  # what makes an uncalled function with a router parameter a library's entry


class Registry(NamedTuple):
    """entry, at (place), func, method, path, normalizedPath, chain, handler of routes; entry, at, func, code of diagnostics."""

    routes: DataFrame
    diagnostics: DataFrame


def place(at: str | Column, ord_: str | Column) -> Column:
    return F.concat(at if isinstance(at, Column) else F.col(at), F.lpad((ord_ if isinstance(ord_, Column) else F.col(ord_)).cast("string"), DIGITS, "0"), F.lit("."))


def entries(steps: DataFrame) -> DataFrame:
    """Functions that build an engine: where the walk begins."""
    return steps.where("kind = 'engine'").select(F.col("func").alias("entry")).distinct()


def reachable(steps: DataFrame, depth: int = DEPTH) -> DataFrame:
    """func: the functions that the walk can come to, each once; others needn't be joined at all."""
    calls = steps.where("kind = 'call'").select("func", "callee").distinct()
    seen = written(entries(steps).select(F.col("entry").alias("func")), "reached")
    frontier = seen
    for _ in range(depth):
        frontier = written(calls.join(frontier, "func", "left_semi").select(F.col("callee").alias("func")).distinct().join(seen, "func", "left_anti"), "reached")
        if frontier.isEmpty():
            break
        seen = written(seen.union(frontier), "reached")
    return seen


def instances(steps: DataFrame, functions: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(instances: entry, at, func, callers), (calls followed: entry, at, t, var, out, param), (diagnostics).

    `at` is the place of the call that made the instance; an entry's is empty. A call into a function that is already
    being followed, deeper than `depth`, or of which `functions` has no source is a diagnostic, once a call.
    """
    calls = steps.where("kind = 'call'").select("func", "ord", "callee", "var", "out", "param")
    builders = entries(steps).select(F.col("entry").alias("callee"), F.lit(True).alias("builds"))
    known = functions.select(F.col("func").alias("callee"), F.lit(True).alias("known")).distinct()
    calls = written(calls.join(known, "callee", "left").join(builders, "callee", "left"), "calls")
    level = written(entries(steps).select("entry", F.lit("").alias("at"), F.col("entry").alias("func"), F.array("entry").alias("callers")), "instances")
    every, followed, lost = [level], [], []
    for n in range(depth + 1):
        made = level.join(calls, "func").select("entry", "at", "func", place("at", "ord").alias("t"), "callee", "var", "out", "param", "known", "builds", "callers")
        code = (
            F.when(F.lit(n >= depth), "gin-registrar-depth-exceeded")
            .when(F.array_contains("callers", F.col("callee")), "gin-recursive-registrar")
            .when(F.col("known").isNull() & F.col("var").isNotNull(), "gin-unresolved-registrar")
        )
        useful = F.col("var").isNotNull() | F.col("builds")  # a call that neither gets a router nor builds one is no concern
        made = written(made.where(useful).withColumn("code", code), "followed")
        lost.append(made.where("code is not null").select("entry", F.col("t").alias("at"), "func", "code", "var", F.col("at").alias("caller")).distinct())
        good = made.where("code is null and known")
        followed.append(good.select("entry", "at", "t", "var", "out", "param"))
        level = written(good.select("entry", F.col("t").alias("at"), F.col("callee").alias("func"), F.array_append("callers", F.col("callee")).alias("callers")).distinct(), "instances")
        if level.isEmpty():
            break
        every.append(level)
    union = lambda frames: written(frames[0] if len(frames) == 1 else _union(frames), "levels")
    return union(every), union(followed), union(lost)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def resolved(events: DataFrame, followed: DataFrame, depth: int = DEPTH) -> DataFrame:
    """entry, at, var, value_at, value_var: the definition (engine or group) that a variable of an instance stands for.

    A parameter points to its caller's variable, a variable bound to a factory's engine to what the factory returns.
    What a body defines itself comes after its parameters are bound, so it stands before a parameter of the same name.
    A factory that returns several variables is not resolved. Chains are followed by doubling.
    """
    made = events.where("kind in ('engine', 'group')").select("entry", "at", F.col("out").alias("var"), F.col("at").alias("to_at"), F.col("out").alias("to_var"), F.lit(True).alias("end"))
    passed = followed.where("var is not null and param is not null").groupBy("entry", F.col("t").alias("at"), F.col("param").alias("var")).agg(F.min("at").alias("to_at"), F.min("var").alias("to_var"), F.lit(False).alias("end"))
    back = events.where("kind = 'return' and var is not null").groupBy("entry", F.col("at").alias("t")).agg(F.min("var").alias("to_var"), F.count_distinct("var").alias("n")).where("n = 1")
    bound = followed.where("var is null and out is not null").select("entry", "at", F.col("out").alias("var"), "t").join(back, ["entry", "t"])
    links = made.unionByName(passed).unionByName(bound.select("entry", "at", "var", F.col("t").alias("to_at"), "to_var", F.lit(False).alias("end")))
    deepest = F.max(F.struct("end", F.length("to_at").alias("deep"), "to_at", "to_var"))  # an engine or group, then what a call gives, then a parameter
    links = links.groupBy("entry", "at", "var").agg(deepest.alias("to"))
    links = written(links.select("entry", "at", "var", "to.to_at", "to.to_var", "to.end"), "links")
    for _ in range(max(1, (2 * depth).bit_length())):
        if links.where("not end").isEmpty():
            break
        onward = links.select("entry", F.col("at").alias("to_at"), F.col("var").alias("to_var"), F.col("to_at").alias("next_at"), F.col("to_var").alias("next_var"), F.col("end").alias("ends"))
        open_ = links.where("not end").join(onward, ["entry", "to_at", "to_var"])  # links that lead nowhere are dropped
        links = written(links.where("end").unionByName(open_.select("entry", "at", "var", F.col("next_at").alias("to_at"), F.col("next_var").alias("to_var"), F.col("ends").alias("end"))), "links")
    return links.where("end").select("entry", "at", "var", F.col("to_at").alias("value_at"), F.col("to_var").alias("value_var"))


def values(events: DataFrame, refs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """entry, value_at, value_var, base (path), inherited, own (middleware: inherited when it was made; t and symbols added since).

    A group takes its parent's middleware as it was when the group was made, then its own arguments.
    """
    empty = F.array().cast("array<string>")
    by = ["entry", "value_at", "value_var"]
    on = written(events.where("kind in ('use', 'group') and var is not null").join(refs, ["entry", "at", "var"]), "on")
    uses = on.where("kind = 'use'").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("t", F.coalesce("symbols", empty).alias("symbols")))).alias("own"))
    uses = written(uses, "uses")
    none = F.array().cast("array<struct<t:string,symbols:array<string>>>")
    groups = on.where("kind = 'group' and path is not null").select("entry", F.col("value_at").alias("parent_at"), F.col("value_var").alias("parent_var"), "t", "path", F.coalesce("symbols", empty).alias("symbols"), F.col("at").alias("value_at"), F.col("out").alias("value_var"))
    groups = written(groups, "groups")
    roots = events.where("kind = 'engine'").select("entry", F.col("at").alias("value_at"), F.col("out").alias("value_var"), F.lit("/").alias("base"), empty.alias("inherited"))
    level = written(roots.join(uses, by, "left").withColumn("own", F.coalesce("own", none)), "values")
    every = [level]
    for _ in range(depth * 2):
        parents = level.select("entry", F.col("value_at").alias("parent_at"), F.col("value_var").alias("parent_var"), "base", "inherited", "own")
        level = groups.join(parents, ["entry", "parent_at", "parent_var"]).select(*by, join_paths(F.col("base"), F.col("path")).alias("base"), F.concat(chain_at(F.col("t")), "symbols").alias("inherited"))
        level = written(level.join(uses, by, "left").withColumn("own", F.coalesce("own", none)), "values")
        if level.isEmpty():
            break
        every.append(level)
    return _union(every)


def chain_at(t: Column) -> Column:
    """Middleware of a value (inherited, own) for what happens at place `t`."""
    return F.concat("inherited", F.flatten(F.transform(F.filter("own", lambda u: u["t"] < t), lambda u: u["symbols"])))


def discover(steps: DataFrame, functions: DataFrame | None = None, depth: int = DEPTH) -> Registry:
    """Routes and diagnostics of a program given by `steps`; `functions` (func): those whose source is there, by default all with steps.

    Each entry is walked on its own, so a route that two entries register comes twice. A route's chain is the
    middleware of its router at that moment and all its symbols but the last, which is the handler. Groups and routes
    without a path (it isn't a constant), and steps on routers that nothing tracks, are diagnostics. Functions with
    null names are not followed; no steps give no rows.
    """
    functions = functions if functions is not None else steps.select("func").distinct()
    within = written(steps.join(reachable(steps, depth), "func", "left_semi"), "steps")  # the rest never reaches a join
    made, followed, lost = instances(within, functions, depth)
    events = written(made.drop("callers").join(within, "func").withColumn("t", place("at", "ord")), "events")
    refs = written(resolved(events, followed, depth), "refs")
    known = written(values(events, refs, depth), "known")
    tracked = written(refs.join(known, ["entry", "value_at", "value_var"], "left_semi").select("entry", "at", "var"), "tracked")
    gone = written(unfollowed(made, followed, tracked), "gone")
    events = events.join(gone, ["entry", "at"], "left_anti")
    routes = events.where("kind = 'route'").join(refs, ["entry", "at", "var"], "left").join(known, ["entry", "value_at", "value_var"], "left")
    code = F.when(F.col("base").isNull(), "gin-untracked-router-value").when(F.col("path").isNull(), "gin-unresolved-path").when(F.coalesce(F.size("symbols"), F.lit(0)) < 1, "gin-no-handlers")
    routes = written(routes.withColumn("code", code), "routes")
    good = routes.where("code is null").withColumn("full", join_paths(F.col("base"), F.col("path")))
    n = F.size("symbols")
    out = good.select("entry", F.col("t").alias("at"), "func", "method", F.col("full").alias("path"), normalize_path(F.col("full")).alias("normalizedPath"), F.concat(chain_at(F.col("t")), F.slice("symbols", F.lit(1), n - 1)).alias("chain"), F.element_at("symbols", n).alias("handler"))
    pathless = events.where("kind = 'group' and path is null").join(tracked, ["entry", "at", "var"], "left_semi").select("entry", F.col("t").alias("at"), "func", F.lit("gin-unresolved-path").alias("code"))
    here = lost.join(gone.withColumnRenamed("at", "caller"), ["entry", "caller"], "left_anti")
    calls = here.join(tracked.withColumnRenamed("at", "caller"), ["entry", "caller", "var"], "left_semi").select(lost.columns).union(here.where("var is null").select(lost.columns))
    diagnostics = routes.where("code is not null").select("entry", F.col("t").alias("at"), "func", "code").union(pathless).union(calls.select("entry", "at", "func", "code").distinct())
    return Registry(out, diagnostics)


def unfollowed(made: DataFrame, followed: DataFrame, tracked: DataFrame) -> DataFrame:
    """entry, at of the instances that a call made with routers that nothing tracks, or that lie inside such a one."""
    seen = followed.where("var is not null").join(tracked.withColumn("seen", F.lit(True)), ["entry", "at", "var"], "left")
    dead = seen.groupBy("entry", F.col("t").alias("upto")).agg(F.bool_or(F.coalesce("seen", F.lit(False))).alias("seen")).where("not seen").select("entry", "upto")
    step = DIGITS + 1
    ends = F.when(F.length("at") > 0, F.sequence(F.lit(step), F.length("at"), F.lit(step))).otherwise(F.array().cast("array<int>"))
    above = made.select("entry", "at", F.explode(F.transform(ends, lambda n: F.substr(F.col("at"), F.lit(1), n))).alias("upto"))
    return above.join(dead, ["entry", "upto"], "left_semi").select("entry", "at").distinct()


def library_entries(steps: DataFrame, parameters: DataFrame) -> DataFrame:
    """func, param, code: functions that use a router parameter for routes, build no engine and that nothing calls.

    `parameters` (func, param): parameters that are routers. A parameter is used through groups made of it too. What
    they register can't be seen without the program that calls them.
    """
    called = steps.where("kind = 'call' and callee is not null").select(F.col("callee").alias("func")).distinct()
    used = steps.where(F.col("kind").isin(*RELEVANT)).select("func", F.col("var").alias("param")).distinct()
    # a group of a parameter counts as a use of it already, so what is done with the group needn't be followed
    alone = parameters.join(called, "func", "left_anti").join(entries(steps).withColumnRenamed("entry", "func"), "func", "left_anti")
    return alone.join(used, ["func", "param"], "left_semi").select("func", "param", F.lit("gin-library-entry-point").alias("code")).distinct()
