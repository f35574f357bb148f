"""Versions of semantic definitions: what a change breaks and what a migration has to cover."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

WIDER = {("integer", "decimal"), ("date", "datetime"), ("enum", "string")}


@dataclass(frozen=True)
class PropertyType:
    name: str
    value_type: str
    required: bool = False
    nullable: bool = True
    unique: bool = False
    many: bool = False
    default: str | None = None


@dataclass(frozen=True)
class ObjectType:
    name: str
    properties: tuple[PropertyType, ...]
    identity: tuple[str, ...]

    def __post_init__(self):
        names = [p.name for p in self.properties]
        if len(set(names)) != len(names):
            raise ValueError(f"{self.name}: a property is declared twice")
        if not self.identity or not set(self.identity) <= set(names):
            raise ValueError(f"{self.name}: identity needs declared properties")


@dataclass(frozen=True)
class RelationType:
    name: str
    source: str
    target: str
    directed: bool = True
    cardinality: str = "n-n"
    temporal: bool = False
    properties: tuple[PropertyType, ...] = ()


def _rows(properties: tuple[PropertyType, ...]) -> list:
    return sorted([p.name, p.value_type, p.required, p.nullable, p.unique, p.many, p.default] for p in properties)


@dataclass(frozen=True)
class Definition:
    name: str
    version: int
    types: tuple[ObjectType, ...]
    relations: tuple[RelationType, ...] = ()

    def __post_init__(self):
        known = {t.name for t in self.types}
        names = [t.name for t in (*self.types, *self.relations)]
        if len(set(names)) != len(names):
            raise ValueError(f"{self.name}: a type is declared twice")
        for r in self.relations:
            if not {r.source, r.target} <= known:
                raise ValueError(f"{r.name}: its ends need declared types")

    def body(self) -> str:
        """Canonical JSON: equal definitions have equal texts, whatever the order of their types."""
        objects = [[t.name, _rows(t.properties), list(t.identity)] for t in sorted(self.types, key=lambda t: t.name)]
        relations = [[r.name, r.source, r.target, r.directed, r.cardinality, r.temporal, _rows(r.properties)] for r in sorted(self.relations, key=lambda r: r.name)]
        return json.dumps([self.name, self.version, objects, relations], separators=(",", ":"))

    def digest(self) -> str:
        return hashlib.sha256(self.body().encode()).hexdigest()


def manifest(definition: Definition, mapping) -> dict[str, str]:
    """What a stored graph has to be read with: digests of the definition, the mapping and both together."""
    described = json.dumps(asdict(mapping), sort_keys=True, separators=(",", ":"), default=str)
    both = [definition.digest(), hashlib.sha256(described.encode()).hexdigest()]
    return {"definition": both[0], "mapping": both[1], "digest": hashlib.sha256(json.dumps(both).encode()).hexdigest()}


@dataclass(frozen=True)
class Change:
    path: str
    what: str
    breaking: bool


def differences(old: Definition, new: Definition) -> list[Change]:
    """All changes, in the order of their paths."""
    out = []
    for before, after, compare in ((old.types, new.types, _objects), (old.relations, new.relations, _relations)):
        before, after = {t.name: t for t in before}, {t.name: t for t in after}
        for name in before.keys() | after.keys():
            if name not in after:
                out.append(Change(name, "type removed", True))
            elif name not in before:
                out.append(Change(name, "type added", False))
            else:
                out += compare(name, before[name], after[name])
    return sorted(out, key=lambda c: (c.path, c.what))


def _objects(name: str, old: ObjectType, new: ObjectType) -> list[Change]:
    identity = [Change(name, "identity changed", True)] if old.identity != new.identity else []
    return identity + _properties(name, old, new)


def _relations(name: str, old: RelationType, new: RelationType) -> list[Change]:
    out = [Change(name, f"{end} changed", True) for end in ("source", "target", "directed") if getattr(old, end) != getattr(new, end)]
    if old.cardinality != new.cardinality:  # a wider side holds what the narrower one held
        wider = all(b in (a, "n") for a, b in zip(old.cardinality.split("-"), new.cardinality.split("-"), strict=True))
        out.append(Change(name, f"cardinality {old.cardinality} to {new.cardinality}", not wider))
    if old.temporal != new.temporal:
        out.append(Change(name, f"temporal {'set' if new.temporal else 'dropped'}", old.temporal))
    return out + _properties(name, old, new)


def _properties(name: str, old, new) -> list[Change]:
    out = []
    before, after = {p.name: p for p in old.properties}, {p.name: p for p in new.properties}
    for key in sorted(before.keys() | after.keys()):
        path, a, b = f"{name}.{key}", before.get(key), after.get(key)
        if b is None:
            out.append(Change(path, "property removed", True))
        elif a is None:
            out.append(Change(path, "property added", b.required and b.default is None))
        else:
            if a.value_type != b.value_type:
                out.append(Change(path, f"{a.value_type} to {b.value_type}", (a.value_type, b.value_type) not in WIDER))
            for flag, tighter in (("required", True), ("unique", True), ("nullable", False)):
                if getattr(a, flag) != getattr(b, flag):
                    out.append(Change(path, f"{flag} {'set' if getattr(b, flag) else 'dropped'}", getattr(b, flag) is tighter))
            if a.many != b.many:
                out.append(Change(path, "cardinality changed", a.many))
            if a.default != b.default:
                out.append(Change(path, "default changed", False))
    return out


class Registry:
    """Published versions; a breaking one needs a migration that covers exactly the paths it breaks."""

    def __init__(self):
        self._known: dict[str, list[Definition]] = {}

    def publish(self, definition: Definition, migration: set[str] | None = None) -> list[Change]:
        versions = self._known.setdefault(definition.name, [])
        if not versions:
            versions.append(definition)
            return []
        last = versions[-1]
        if definition.version == last.version and definition.digest() == last.digest():
            return []
        if definition.version <= last.version:
            raise ValueError("a version is published once and never goes back")
        found = differences(last, definition)
        broken = {c.path for c in found if c.breaking}
        if broken != (migration or set()):
            raise ValueError(f"the migration has to cover exactly {sorted(broken)}")
        versions.append(definition)
        return found

    def latest(self, name: str) -> Definition:
        return self._known[name][-1]
