"""Compiling a mapping: names, types, identities and ends are checked before a record is read."""

from __future__ import annotations

from qualigraph.operators.graph import Mapping, ObjectMapping, Property, SourceContract
from qualigraph.plans.registry import Definition, ObjectType, PropertyType, RelationType

#: Which types of source values a property of each type takes. Fixed values.
ACCEPTS = {
    "string": {"string"},
    "integer": {"integer"},
    "decimal": {"decimal", "integer", "string"},
    "boolean": {"boolean"},
    "date": {"date", "string"},
    "datetime": {"datetime", "string"},
    "enum": {"string", "integer"},
    "reference": {"reference", "string"},
    "json": {"json"},
}


class MappingError(ValueError):
    pass


def _property(p: Property, owner: ObjectType | RelationType, contract: SourceContract) -> None:
    where = f"{owner.name}.{p.name}"
    target: PropertyType | None = next((t for t in owner.properties if t.name == p.name), None)
    source = next((f for f in contract.fields if f.name == p.column), None)
    problem = (
        f"{where}: no such property" if target is None
        else f"{where}: no field {p.column} in the contract" if source is None
        else f"{where}: is declared as {target.value_type}" if target.value_type != p.value_type
        else f"{where}: {source.value_type} can't be {target.value_type}" if source.value_type not in ACCEPTS[target.value_type]
        else f"{where}: transforms need text" if p.transforms and source.value_type != "string"
        else f"{where}: the default differs from the declared one" if p.default != target.default
        else f"{where}: nulls of {p.column} need a default" if source.nullable and not target.nullable and target.default is None
        else None
    )
    if problem:
        raise MappingError(problem)


def _object(o: ObjectMapping, definition: Definition, contract: SourceContract) -> None:
    kind = next((t for t in definition.types if t.name == o.object_type), None)
    if kind is None:
        raise MappingError(f"{o.object_type}: no such type of object")
    for p in (*o.identity, *o.properties):
        _property(p, kind, contract)
    if missing := sorted(set(kind.identity) - {p.name for p in o.identity}):
        raise MappingError(f"{o.object_type}: the identity lacks {', '.join(missing)}")


def compiled(mapping: Mapping, definition: Definition, contract: SourceContract) -> Mapping:
    """The mapping, bound to the contract's fields; a MappingError names the first thing that doesn't fit.

    Fields that the contract has but doesn't require may be missing in a source: bind again to its columns.
    """
    for o in mapping.objects:
        _object(o, definition, contract)
    known = {o.object_type for o in mapping.objects}
    for r in mapping.relations:
        kind = next((t for t in definition.relations if t.name == r.relation_type), None)
        if kind is None:
            raise MappingError(f"{r.relation_type}: no such type of relation")
        for end, want, what in ((r.source, kind.source, "source"), (r.target, kind.target, "target")):
            if end.object_type not in known:
                raise MappingError(f"{r.relation_type}: {end.object_type} isn't mapped")
            if end.object_type != want:
                raise MappingError(f"{r.relation_type}: the {what} is {want}, not {end.object_type}")
        if r.directed != kind.directed:
            raise MappingError(f"{r.relation_type}: directed in one place and not in the other")
        if not 0 <= float(r.confidence) <= 1:
            raise MappingError(f"{r.relation_type}: confidence is between 0 and 1")
        for p in r.properties:
            _property(p, kind, contract)
    return mapping.bound({f.name for f in contract.fields})
