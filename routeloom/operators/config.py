"""The reviewed configuration: small, on the driver, validated as a whole with every error told.

Guards, wrappers and policies number in the hundreds and reach the executors as literals of the plan.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Guard:
    assurance: str = "analyze"  # or attested
    tags: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    scopes: tuple[str, ...] = ()
    scheme: str | None = None


@dataclass(frozen=True)
class Selector:
    """Fields are combined by and, values of a field by or; an empty field matches all."""

    method: tuple[str, ...] = ()
    path: tuple[str, ...] = ()
    status: tuple[str, ...] = ()
    tag: tuple[str, ...] = ()
    role: tuple[str, ...] = ()
    scope: tuple[str, ...] = ()
    package: tuple[str, ...] = ()
    surfaceKind: tuple[str, ...] = ()  # noqa: N815  the documents' name


@dataclass(frozen=True)
class Requirement:
    """All fields given must hold; `all`, `any` and `not_` nest."""

    status: tuple[str, ...] = ()
    middlewareAny: tuple[str, ...] = ()  # noqa: N815
    middlewarePresent: tuple[str, ...] = ()  # noqa: N815
    middlewareAbsent: tuple[str, ...] = ()  # noqa: N815
    middlewareOrder: tuple[str, ...] = ()  # noqa: N815
    anyTag: tuple[str, ...] = ()  # noqa: N815
    allTags: tuple[str, ...] = ()  # noqa: N815
    anyRole: tuple[str, ...] = ()  # noqa: N815
    anyScope: tuple[str, ...] = ()  # noqa: N815
    all: tuple[Requirement, ...] = ()
    any: tuple[Requirement, ...] = ()
    not_: Requirement | None = None

    def depth(self) -> int:
        return 1 + max([r.depth() for r in (*self.all, *self.any, *([self.not_] if self.not_ else []))], default=0)


@dataclass(frozen=True)
class Exemption:
    reason: str
    expires: str
    match: Selector = field(default_factory=Selector)


@dataclass(frozen=True)
class Policy:
    id: str
    match: Selector = field(default_factory=Selector)
    require: Requirement = field(default_factory=Requirement)
    exceptions: tuple[Exemption, ...] = ()


@dataclass(frozen=True)
class Config:
    guards: dict[str, Guard] = field(default_factory=dict)
    wrappers: tuple[str, ...] = ()
    accepted_public: tuple[str, ...] = ()
    policies: tuple[Policy, ...] = ()
    max_depth: int = 32

    def errors(self) -> list[str]:
        out = [f"authMiddleware {s!r}: assurance {g.assurance!r}" for s, g in self.guards.items() if g.assurance not in ("analyze", "attested")]
        out += [f"authMiddleware {s!r}: double value in {k}" for s, g in self.guards.items() for k in ("tags", "roles", "scopes") if len(set(getattr(g, k))) < len(getattr(g, k))]
        out += [f"acceptedPublic {a!r}: not METHOD /path" for a in self.accepted_public if not re.fullmatch(r"[A-Z]+ /\S*", a)]
        for what, names in (("authWrappers", self.wrappers), ("acceptedPublic", self.accepted_public), ("policies", [p.id for p in self.policies])):
            out += [f"{what}: {n!r} is given twice" for n in sorted({n for n in names if list(names).count(n) > 1})]
        for p in self.policies:
            if not p.id:
                out.append("a policy has no id")
            if p.require.depth() > self.max_depth:
                out.append(f"policy {p.id!r}: nested deeper than {self.max_depth}")
            out += [f"policy {p.id!r}: expiry {e.expires!r} is not YYYY-MM-DD" for e in p.exceptions if not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])", e.expires)]
        return out


def _pairs(pairs: list) -> dict:
    out: dict = {}
    for k, v in pairs:
        if k in out:
            raise ValueError(f"key {k!r} is given twice")
        out[k] = v
    return out


def _build(kind: type, data: dict, names: dict[str, str] | None = None) -> object:
    known = {(names or {}).get(f.name, f.name): f.name for f in fields(kind)}
    if unknown := set(data) - set(known):
        raise ValueError(f"unknown fields {sorted(unknown)} in {kind.__name__.lower()}")
    return kind(**{known[k]: tuple(v) if isinstance(v, list) else v for k, v in data.items()})


def _requirement(data: dict) -> Requirement:
    data = dict(data)
    for k in ("all", "any"):
        if k in data:
            data[k] = [_requirement(d) for d in data[k]]
    if data.get("not"):
        data["not"] = _requirement(data["not"])
    return _build(Requirement, data, {"not_": "not"})


def _policy(data: dict) -> Policy:
    data = dict(data)
    data["match"] = _build(Selector, data.get("match", {}))
    data["require"] = _requirement(data.get("require", {}))
    data["exceptions"] = [_build(Exemption, {**e, "match": _build(Selector, e.get("match", {}))}) for e in data.get("exceptions", [])]
    return _build(Policy, data)


def _yaml(text: str) -> dict:
    """One YAML document of plain mappings, lists and strings: no double keys, aliases, tags of its own or second document."""
    import yaml

    loader = yaml.BaseLoader(text)
    try:
        node = loader.get_single_node()
        seen, todo = set(), [node] if node else []
        while todo:
            n = todo.pop()
            if id(n) in seen:
                raise ValueError(f"line {n.start_mark.line + 1}: aliases are not permitted in configuration")
            seen.add(id(n))
            if not n.tag.startswith("tag:yaml.org,2002:"):
                raise ValueError(f"line {n.start_mark.line + 1}: custom tag {n.tag!r} is not permitted in configuration")
            if isinstance(n, yaml.MappingNode):
                _pairs([(k.value, None) for k, _ in n.value])
                todo += [c for kv in n.value for c in kv]
            elif isinstance(n, yaml.SequenceNode):
                todo += n.value
        data = loader.construct_document(node) if node else {}
    except yaml.YAMLError as e:
        raise ValueError(f"invalid YAML: {e}") from None
    if not isinstance(data, dict):
        raise ValueError("configuration must be a mapping")
    return data


def decode(text: str) -> Config:
    """A strict configuration in JSON or YAML: unknown fields and double keys are refused, all other errors are told at once."""
    data = json.loads(text, object_pairs_hook=_pairs) if text.lstrip().startswith("{") else _yaml(text)
    known = {"version", "authMiddleware", "authWrappers", "acceptedPublic", "policies"}
    if unknown := set(data) - known:
        raise ValueError(f"unknown fields {sorted(unknown)}")
    guards = {s: _build(Guard, g, {"scheme": "openapiScheme"}) for s, g in data.get("authMiddleware", {}).items()}
    config = Config(guards, tuple(data.get("authWrappers", [])), tuple(data.get("acceptedPublic", [])), tuple(map(_policy, data.get("policies", []))))
    if errors := config.errors():
        raise ValueError("; ".join(errors))
    return config
