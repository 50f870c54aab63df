"""Path globs, compiled to regular expressions on the driver so that filters stay in the JVM.

`*`, `?` and `[..]` stay within a segment, `**` is any number of segments; outer slashes don't count. A malformed
pattern matches nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def segment_regex(segment: str) -> str | None:
    out, i = "", 0
    while i < len(segment):
        c = segment[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            j = i + 1
            negated = j < len(segment) and segment[j] == "^"
            j += negated
            items = ""
            while j < len(segment) and (segment[j] != "]" or not items):
                if segment[j] == "\\":
                    j += 1
                    if j == len(segment):
                        return None
                    items += re.escape(segment[j])
                elif segment[j] == "-":
                    items += "-"
                else:
                    items += re.escape(segment[j])
                j += 1
            if j >= len(segment) or not items or items.startswith("-") or items.endswith("-"):
                return None
            out += f"(?![/])[{'^' * negated}{items}]"
            i = j
        elif c == "\\":
            i += 1
            if i == len(segment):
                return None
            out += re.escape(segment[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def glob_regex(pattern: str) -> str | None:
    """A regular expression for a whole path without outer slashes; None: malformed."""
    parts = pattern.strip("/").split("/")
    out = ""
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        if p == "**":
            out += ("(?:.*)" if i == 0 else "(?:/.*)?") if last else "(?:[^/]*/)*" if not out or out.endswith("/") or out.endswith("/)*") else "(?:/[^/]*)*/"
            continue
        s = segment_regex(p)
        if s is None:
            return None
        out += ("" if not out or out.endswith("/") or out.endswith("/)*") else "/") + s
    return f"^{out}$"


def glob_match(path: Column, pattern: str) -> Column:
    regex = glob_regex(pattern)
    return F.lit(False) if regex is None else F.coalesce(F.regexp_replace(path, "^/+|/+$", "").rlike(regex), F.lit(False))


def any_glob(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | glob_match(path, p)
    return out


def in_scope(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Scan scope: an exclusion wins; with inclusions given one must match; paths outside the root stay."""
    outside = path.startswith("../") | (path == "..")
    return outside | (~any_glob(path, exclude) & (any_glob(path, include) if include else F.lit(True)))
