"""Doc-comment annotations of handlers and modules (`@Summary`, `@Param`, `@Router` …) as rows."""

from __future__ import annotations

import json
import re
import shlex
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "symbol string, summary string, description string, operation_id string, deprecated boolean, tags array<string>, accepts array<string>, produces array<string>, routers array<string>, security array<string>, parameters array<struct<name:string,place:string,type:string,required:boolean,description:string>>, responses array<struct<status:string,kind:string,type:string,description:string>>, headers array<struct<status:string,name:string,type:string,description:string>>, extensions string, issues array<string>"
#: Short names of media types (fixed values).
MEDIA = {"json": "application/json", "xml": "application/xml", "plain": "text/plain", "html": "text/html", "mpfd": "multipart/form-data", "x-www-form-urlencoded": "application/x-www-form-urlencoded", "json-api": "application/vnd.api+json", "octet-stream": "application/octet-stream", "png": "image/png", "jpeg": "image/jpeg"}
#: Words for truth values (fixed values).
TRUTH = {"1": True, "t": True, "T": True, "TRUE": True, "true": True, "True": True, "0": False, "f": False, "F": False, "FALSE": False, "false": False, "False": False}
PLACES = {"query", "path", "header", "body", "formData"}


def literal(text: str):
    """A JSON value, else a truth value, else a number, else the text itself."""
    text = text.strip()
    try:
        return json.loads(text, parse_constant=lambda name: TRUTH[name])  # NaN and the like are no JSON
    except (ValueError, KeyError):
        pass
    if text in TRUTH:
        return TRUTH[text]
    return float(text) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text) else text


def fields(text: str) -> list[str]:
    try:
        return shlex.split(text)
    except ValueError:
        return text.split()


def parse(comment: str | None) -> dict:
    """What one comment declares; lines that can't be read are issues."""
    out: dict = {k: None for k in ("summary", "description", "operation_id")} | {"deprecated": False, "extensions": {}}
    out |= {k: [] for k in ("tags", "accepts", "produces", "routers", "security", "parameters", "responses", "headers", "issues")}
    for line in (comment or "").splitlines():
        m = re.match(r"\s*(?://+|\*)?\s*@([\w.-]+)\s*(.*?)\s*$", line)
        if not m:
            continue
        name, rest = m[1].lower(), m[2]
        if name == "summary":
            out["summary"] = rest
        elif name == "description":
            out["description"] = rest if out["description"] is None else f"{out['description']}\n{rest}"
        elif name == "id":
            out["operation_id"] = rest
        elif name == "deprecated":
            out["deprecated"] = True
        elif name == "tags":
            out["tags"] += [t for t in map(str.strip, rest.split(",")) if t and t not in out["tags"]]
        elif name in ("accept", "produce"):
            out[f"{name}s"] = list(dict.fromkeys([*out[f"{name}s"], *(MEDIA.get(t.lower(), t) for t in map(str.strip, rest.split(",")) if t)]))
        elif name == "security":
            out["security"].append(rest)
        elif name in ("router", "deprecatedrouter"):
            if r := re.match(r"(\S+)\s+\[(\w+)\]", rest):
                out["routers"].append(f"{r[2].lower()} {r[1]}")
            else:
                out["issues"].append(line.strip())
        elif name == "param":
            p = fields(rest)
            if len(p) >= 4 and p[1] in PLACES and p[3] in ("true", "false"):
                out["parameters"].append({"name": p[0], "place": p[1], "type": p[2], "required": p[3] == "true" or p[1] == "path", "description": p[4] if len(p) > 4 else ""})
            else:
                out["issues"].append(line.strip())
        elif name in ("success", "failure", "response"):
            r = re.match(r"(\S+)(?:\s+\{(\w+)\}\s+(\S+))?\s*(.*)$", rest)
            for status in r[1].split(",") if r else [""]:
                if status == "default" or re.fullmatch(r"[1-5]\d\d", status):
                    out["responses"].append({"status": status, "kind": r[2], "type": r[3], "description": r[4].strip('"')})
                else:
                    out["issues"].append(line.strip())
        elif name == "header":
            r = re.match(r"(\S+)\s+\{(\w+)\}\s+(\S+)\s*(.*)$", rest)
            if r:
                out["headers"] += [{"status": s, "name": r[3], "type": r[2], "description": r[4].strip('"')} for s in r[1].split(",")]
            else:
                out["issues"].append(line.strip())
        elif name.startswith("x-"):
            out["extensions"][name] = literal(rest)
    return out


def annotations(comments: DataFrame) -> DataFrame:
    """One row for each row of `comments` (symbol, comment)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [parse(c) for c in pdf["comment"]]
            for r in rows:
                r["extensions"] = json.dumps(r["extensions"], sort_keys=True)
            yield pd.DataFrame([{"symbol": s} | r for s, r in zip(pdf["symbol"], rows, strict=True)], columns=[x.split()[0] for x in re.split(r", (?=\w+ )", SCHEMA)])

    return comments.select("symbol", "comment").mapInPandas(run, SCHEMA)
