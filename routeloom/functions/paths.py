"""Route paths as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def normalize_path(path: Column) -> Column:
    """Double slashes collapse, a trailing slash and parameters stay, empty is the root."""
    body = F.concat(F.lit("/"), F.array_join(segments(path), "/"))
    return F.when(F.coalesce(path, F.lit("")) == "", "/").when((F.size(segments(path)) > 0) & path.endswith("/"), F.concat(body, F.lit("/"))).otherwise(body)


def clean_path(path: Column) -> Column:
    """Lexical cleaning: `.` and empty segments go, `..` takes its parent along (the root has none)."""
    fold = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s.isin("", "."), done).when(s == "..", F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(path.startswith("/"), done).otherwise(F.concat(done, F.array(s)))).otherwise(F.concat(done, F.array(s))),
    )
    body = F.array_join(fold, "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), body)).when(body == "", ".").otherwise(body)


def join_paths(base: Column, relative: Column) -> Column:
    """Base and relative path joined and cleaned; a trailing slash of the relative path stays; an empty one gives the base."""
    joined = F.when(base == "", clean_path(relative)).otherwise(clean_path(F.concat(base, F.lit("/"), relative)))
    return F.when(relative == "", base).when(relative.endswith("/") & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def route_key(method: Column, path: Column) -> Column:
    return F.concat(method, F.lit(" "), path)


def template_path(path: Column) -> Column:
    """`:x` and `*x` segments as `{x}`."""
    return F.array_join(F.transform(F.split(path, "/"), lambda s: F.when(s.substr(1, 1).isin(":", "*"), F.concat(F.lit("{"), F.substring(s, 2, 1 << 20), F.lit("}"))).otherwise(s)), "/")


def is_catch_all(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda s: s.startswith("*"))


def path_parameters(template: Column) -> Column:
    return F.regexp_extract_all(template, F.lit(r"\{([^{}/]+)\}"), F.lit(1))


def tag_for(template: Column) -> Column:
    """First segment that is not a parameter, else `default`."""
    return F.coalesce(F.try_element_at(F.filter(F.split(template, "/"), lambda s: (s != "") & ~s.startswith("{")), F.lit(1)), F.lit("default"))


def operation_base(method: Column, template: Column) -> Column:
    """Method and segments in capitals, parameters as `By…`; `Root` without segments."""
    parts = F.transform(segments(template), lambda s: F.when(s.startswith("{") & s.endswith("}"), F.concat(F.lit("By"), pascal_case(F.regexp_replace(s, "^.|.$", "")))).otherwise(pascal_case(s)))
    name = F.array_join(parts, "")
    return F.concat(F.lower(method), F.when(name == "", "Root").otherwise(name))


def pascal_case(text: Column) -> Column:
    """Runs of letters and digits, each with a capital."""
    parts = F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda s: s != "")
    return F.array_join(F.transform(parts, lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 20))), "")
