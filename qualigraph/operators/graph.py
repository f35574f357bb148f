"""The entity graph: records become objects, relations and assertions with provenance.

Tables
    objects     object_id, object_type, canonical_key
    relations   relation_id, relation_type, source_id, target_id
    assertions  assertion_id, subject_id, predicate, value_type, value, kind, offset,
                supersedes, valid_from, valid_to, confidence, observed_at, mapping_version,
                transformations

A value is the canonical text of its type (`canonical`), so equal values have equal texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualigraph.functions.text import uuid5
from qualigraph.operators.lineage import checkpointed

NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
MOST_HOPS = 16
MOST_PAGE = 10_000
VALUE_TYPES = ("string", "integer", "decimal", "boolean", "date", "datetime", "enum", "reference", "json")

#: Mapping transforms are Unicode-aware, unlike the data layer's.
NORMALIZERS: dict[str, Callable[[Column], Column]] = {
    "trim": lambda c: F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", ""),
    "lower": F.lower,
    "upper": F.upper,
}


def canonical(text: Column, value_type: str) -> Column:
    """The one text of a value: plain decimals without trailing zeros, ISO dates, UTC times; null if it isn't of the type."""
    if value_type == "integer":
        return text.try_cast("bigint").cast("string")
    if value_type == "decimal":
        plain = text.try_cast("decimal(38,18)").cast("string")
        return F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    if value_type == "boolean":
        return F.when(F.lower(text).isin("true", "false"), F.lower(text))
    if value_type == "date":
        return F.when(text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), text.try_cast("date").cast("string"))
    if value_type == "datetime":
        return F.concat(F.date_format(F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    if value_type == "reference":
        return F.when(text.rlike(r"(?i)\A[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"), F.lower(text))
    if value_type == "json":
        return F.when(F.try_parse_json(text).isNotNull(), text)
    if value_type in ("string", "enum"):
        return text
    raise ValueError(f"unknown type of value {value_type}")


@dataclass(frozen=True)
class Property:
    """A property and the column it comes from.

    `default` stands for a column that the source lacks (`bound` marks those), not for a null.
    """

    name: str
    column: str
    value_type: str = "string"
    transforms: tuple[str, ...] = ()
    required: bool = False
    nullable: bool = True
    default: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    regex: str | None = None
    minimum: float | None = None
    maximum: float | None = None
    values: tuple[str, ...] = ()
    absent: bool = False

    def bound(self, columns: set[str]) -> Property:
        return replace(self, absent=self.column not in columns)

    def raw(self) -> Column:
        return F.lit(self.default).cast("string") if self.absent else F.col(f"`{self.column}`").cast("string")

    def text(self) -> Column:
        c = self.raw()
        for t in () if self.absent else self.transforms:
            c = NORMALIZERS[t](c)
        return c

    def value(self) -> Column:
        return canonical(self.text(), self.value_type)

    def transformations(self) -> list[str]:
        return ["default@1"] if self.absent else [f"{t}@1" for t in self.transforms]

    def problem(self) -> Column:
        """The first constraint that a record breaks, null if none."""
        v = self.value()
        out = F.when(v.isNull() & self.text().isNotNull(), F.lit(f"{self.name}: not of type {self.value_type}"))
        out = out.when(v.isNull() & F.lit(self.required), F.lit(f"{self.name}: missing"))
        out = out.when(v.isNull() & F.lit(not self.nullable), F.lit(f"{self.name}: null"))
        if self.min_length is not None:
            out = out.when(F.char_length(v) < self.min_length, F.lit(f"{self.name}: too short"))
        if self.max_length is not None:
            out = out.when(F.char_length(v) > self.max_length, F.lit(f"{self.name}: too long"))
        if self.regex is not None:
            out = out.when(~v.rlike(rf"^(?:{self.regex})\z"), F.lit(f"{self.name}: no match"))
        if self.values:
            out = out.when(~v.isin(*self.values), F.lit(f"{self.name}: not allowed"))
        if self.minimum is not None:
            out = out.when(v.try_cast("decimal(38,18)") < F.lit(self.minimum), F.lit(f"{self.name}: below minimum"))
        if self.maximum is not None:
            out = out.when(v.try_cast("decimal(38,18)") > F.lit(self.maximum), F.lit(f"{self.name}: above maximum"))
        return out


@dataclass(frozen=True)
class ObjectMapping:
    object_type: str
    identity: tuple[Property, ...]
    properties: tuple[Property, ...] = ()

    def __post_init__(self):
        if any(p.value_type == "json" for p in self.identity):
            raise ValueError("JSON has no canonical text and can't be part of an identity")

    def bound(self, columns: set[str]) -> ObjectMapping:
        return replace(self, identity=tuple(p.bound(columns) for p in self.identity), properties=tuple(p.bound(columns) for p in self.properties))

    def key(self) -> Column:
        """Canonical identity: a JSON list with sorted keys; null if a part is missing or empty."""
        parts, known = [], F.lit(True)
        for p in self.identity:
            v = p.value()
            known = known & v.isNotNull() & (v != "")
            quoted = F.to_json(F.array(v))  # ["..."], of which the brackets go
            shown = v if p.value_type in ("integer", "boolean") else F.substring(quoted, F.lit(2), F.length(quoted) - 2)
            parts.append(F.concat(F.lit('{"property":"' + p.name + '","type":"' + p.value_type + '","value":'), shown, F.lit("}")))
        return F.when(known, F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")))

    def object_id(self) -> Column:
        return uuid5(NAMESPACE, F.concat(F.lit(f"{self.object_type}:"), self.key()))

    def problem(self) -> Column:
        missing = F.when(self.key().isNull(), F.lit(f"{self.object_type}: no identity"))
        return F.coalesce(missing, *[p.problem() for p in (*self.identity, *self.properties)])


@dataclass(frozen=True)
class RelationMapping:
    relation_type: str
    source: ObjectMapping
    target: ObjectMapping
    directed: bool = True
    properties: tuple[Property, ...] = ()
    confidence: str = "1"

    def bound(self, columns: set[str]) -> RelationMapping:
        return replace(self, source=self.source.bound(columns), target=self.target.bound(columns), properties=tuple(p.bound(columns) for p in self.properties))

    def ends(self) -> tuple[Column, Column]:
        a, b = self.source.object_id(), self.target.object_id()
        return (a, b) if self.directed else (F.least(a, b), F.greatest(a, b))

    def relation_id(self) -> Column:
        a, b = self.ends()
        return uuid5(NAMESPACE, F.concat_ws(":", F.lit(self.relation_type), a, b))


@dataclass(frozen=True)
class Mapping:
    objects: tuple[ObjectMapping, ...]
    relations: tuple[RelationMapping, ...] = field(default=())
    name: str = "mapping"
    version: int = 1

    def bound(self, columns) -> Mapping:
        """The mapping for a source with these columns: properties of others take their defaults."""
        there = set(columns)
        return replace(self, objects=tuple(o.bound(there) for o in self.objects), relations=tuple(r.bound(there) for r in self.relations))

    def problem(self) -> Column:
        return F.coalesce(*[o.problem() for o in self.objects], *[p.problem() for r in self.relations for p in r.properties])


@dataclass(frozen=True)
class SourceField:
    name: str
    value_type: str = "string"
    nullable: bool = True
    required: bool = False


@dataclass(frozen=True)
class SourceContract:
    name: str
    fields: tuple[SourceField, ...]
    version: int = 1

    def problem(self, columns: list[str], extra: str | None = None) -> Column:
        """The first breach of the contract in a record, null if none.

        A column outside the contract is a breach where it holds something; `extra` names columns that don't count.
        """
        known, out = {f.name for f in self.fields}, F.when(F.lit(False), F.lit(""))
        for c in columns:
            if c not in known and c != extra:
                out = out.when(F.col(f"`{c}`").isNotNull(), F.lit(f"{c}: outside the contract"))
        for f in self.fields:
            if f.name not in columns:
                if f.required:
                    out = out.when(F.lit(True), F.lit(f"{f.name}: required by the contract"))
                continue
            raw = F.col(f"`{f.name}`").cast("string")
            if not f.nullable:
                out = out.when(raw.isNull(), F.lit(f"{f.name}: null against the contract"))
            out = out.when(raw.isNotNull() & canonical(raw, f.value_type).isNull(), F.lit(f"{f.name}: not of type {f.value_type}"))
        return out


def split(records: DataFrame, mapping: Mapping, contract: SourceContract | None = None, policy: str = "quarantine", offset: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined): a record that breaks the contract or any constraint contributes nothing.

    With the policy `reject` such a record stops the job instead.
    """
    if policy not in ("quarantine", "reject"):
        raise ValueError(f"unknown policy {policy}")
    mapping = mapping.bound(records.columns)
    problem = mapping.problem()
    if contract is not None:
        problem = F.coalesce(contract.problem(records.columns, offset), problem)
    judged = records.withColumn("_problem", problem)
    good = judged.where("_problem is null") if policy == "quarantine" else judged.where(F.when(F.col("_problem").isNull(), True).otherwise(F.raise_error(F.col("_problem")).cast("boolean")))
    return good.drop("_problem"), judged.where("_problem is not null").withColumnRenamed("_problem", "error")


def objects(records: DataFrame, mapping: Mapping) -> DataFrame:
    """Distinct objects of good records. Ids are functions of identities, so partial aggregation removes repeats before the shuffle."""
    mapping, out = mapping.bound(records.columns), None
    for o in mapping.objects:
        rows = records.select(o.object_id().alias("object_id"), F.lit(o.object_type).alias("object_type"), o.key().alias("canonical_key"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def relations(records: DataFrame, mapping: Mapping) -> DataFrame:
    """Distinct relations of good records."""
    mapping, out = mapping.bound(records.columns), None
    for r in mapping.relations:
        a, b = r.ends()
        rows = records.select(r.relation_id().alias("relation_id"), F.lit(r.relation_type).alias("relation_type"), a.alias("source_id"), b.alias("target_id"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def assertions(records: DataFrame, mapping: Mapping, offset: str, run_id: str = "run", observed_at: str | None = None) -> DataFrame:
    """One assertion for each record and non-null property of its objects and relations.

    `kind` says whether a transform or a default changed the value; the confidence is that of the relation, 1 for objects.
    """
    mapping = mapping.bound(records.columns)
    # ids and values are columns of their own first: each is computed once a record
    columns, each = {}, []
    subjects = [(o.object_id(), (*o.identity, *o.properties), "1") for o in mapping.objects] + [(r.relation_id(), r.properties, r.confidence) for r in mapping.relations if r.properties]
    for i, (subject, properties, confidence) in enumerate(subjects):
        columns[f"_id{i}"] = subject
        for j, p in enumerate(properties):
            same, v = f"_s{i}_{j}", f"_v{i}_{j}"
            columns |= {same: F.lit(False) if p.absent else p.text().eqNullSafe(p.raw()), v: p.value()}
            kind = F.when(F.col(same), "observed").otherwise("transformed")
            steps = F.array(*map(F.lit, p.transformations())).cast("array<string>")
            each.append(
                F.struct(F.col(f"_id{i}").alias("subject_id"), F.lit(p.name).alias("predicate"), F.lit(p.value_type).alias("value_type"), F.col(v).alias("value"), kind.alias("kind"), F.lit(confidence).cast("decimal(19,18)").alias("confidence"), steps.alias("transformations"))
            )
    wide = records.select(F.col(offset).cast("long").alias("offset"), *[c.alias(n) for n, c in columns.items()])
    rows = wide.select("offset", F.explode(F.array(*each)).alias("a")).select("offset", "a.*").where("value is not null")
    name = F.concat_ws(":", F.lit(run_id), F.col("offset").cast("string"), "subject_id", "predicate", "value")
    time = lambda c, v=None: F.lit(v).cast("timestamp").alias(c)
    return rows.select(
        uuid5(NAMESPACE, name).alias("assertion_id"), "subject_id", "predicate", "value_type", "value", "kind", "offset",
        F.lit(None).cast("string").alias("supersedes"), time("valid_from"), time("valid_to"),
        "confidence", time("observed_at", observed_at), F.lit(mapping.version).alias("mapping_version"), "transformations",
    )


# ---- store


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The new rows to append: the first of each key by `order` (the least row without one), none that exists already."""
    rest = F.struct(*[c for c in new.columns if c != key])
    first = new.groupBy(key).agg((F.min(rest) if order is None else F.min_by(rest, F.struct(F.col(order), rest))).alias("r")).select(key, "r.*").select(*new.columns)
    return first.join(existing.select(key), key, "left_anti")


def collisions(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys that come with another shape than they have."""
    rest = [c for c in new.columns if c != key]
    both = existing.alias("e").join(new.alias("n"), key)
    differs = F.lit(False)
    for c in rest:
        differs = differs | ~F.col(f"e.{c}").eqNullSafe(F.col(f"n.{c}"))
    return both.where(differs).select(key).distinct()


def bad_ends(relation: DataFrame, object_: DataFrame, source_type: str, target_type: str) -> DataFrame:
    """Relations an end of which is missing or of another type."""
    of = lambda kind, name: object_.where(F.col("object_type") == kind).select(F.col("object_id").alias(name))
    good = relation.join(of(source_type, "source_id"), "source_id", "left_semi").join(of(target_type, "target_id"), "target_id", "left_semi")
    return relation.join(good.select("relation_id"), "relation_id", "left_anti")


def statistics(**tables: DataFrame) -> DataFrame:
    """(table_name, row_count)."""
    out = None
    for name, df in tables.items():
        rows = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- queries


def active(assertion: DataFrame, at: Column | None = None) -> DataFrame:
    """Assertions that no other of their subject supersedes and, given a time, that hold then (both ends included)."""
    gone = assertion.where("supersedes is not null").select("subject_id", F.col("supersedes").alias("assertion_id"))
    out = assertion.join(gone, ["subject_id", "assertion_id"], "left_anti")
    return out if at is None else out.where(_at(at))


def _at(at: Column) -> Column:
    return F.coalesce(F.col("valid_from") <= at, F.lit(True)) & F.coalesce(at <= F.col("valid_to"), F.lit(True))


NUMBER_TYPES = ("integer", "decimal")


def _holds(op: str, value) -> Column:
    v = F.col("value")
    if op == "contains":
        return F.coalesce((F.col("value_type") == "string") & v.contains(str(value)), F.lit(False))
    if op == "in":
        return v.isin(*map(str, value))
    if isinstance(value, str):
        same, left, right = F.col("value_type").isin("string", "enum", "date", "datetime"), v, F.lit(value)
    else:
        same, left, right = F.col("value_type").isin(*NUMBER_TYPES), v.try_cast("decimal(38,18)"), F.lit(str(value)).cast("decimal(38,18)")
    if op == "not_equals":
        return ~same | (left != right)
    made = {"equals": left == right, "less": left < right, "at_most": left <= right, "greater": left > right, "at_least": left >= right}
    return same & made[op]


def _page(limit: int, offset: int = 0) -> None:
    if not 1 <= limit <= MOST_PAGE or offset < 0:
        raise ValueError(f"a page has 1 to {MOST_PAGE} rows and starts at 0 or later")


def matching(object_: DataFrame, assertion: DataFrame, filters) -> DataFrame:
    """Objects for which every filter (predicate, operator, value) holds for some active value, a semi join each."""
    out, live = object_, active(assertion) if filters else None
    for predicate, op, value in filters:
        hit = live.where((F.col("predicate") == predicate) & _holds(op, value)).select(F.col("subject_id").alias("object_id"))
        out = out.join(hit, "object_id", "left_semi")
    return out


def find(object_: DataFrame, assertion: DataFrame, object_type: str, filters: list[tuple[str, str, object]], limit: int = 100, offset: int = 0) -> DataFrame:
    """Objects of a type that pass all filters; a page in id order."""
    _page(limit, offset)
    return matching(object_.where(F.col("object_type") == object_type), assertion, filters).orderBy("object_id").offset(offset).limit(limit)


def assertion_page(assertion: DataFrame, subject: Column, predicate: str | None = None, at: Column | None = None, superseded: bool = False, limit: int = 100) -> DataFrame:
    """Assertions of the subjects by id, `limit` at most: active ones (at a time), or all with `superseded`."""
    _page(limit)
    own = assertion.where(subject)
    if not superseded:
        own = active(own, at)
    elif at is not None:
        own = own.where(_at(at))
    return (own if predicate is None else own.where(F.col("predicate") == predicate)).orderBy("assertion_id").limit(limit)


def edges(relation: DataFrame, direction: str, types: list[str] | None = None) -> DataFrame:
    """(relation_id, relation_type, near, far) as seen from either or both ends, a loop once."""
    if types:
        relation = relation.where(F.col("relation_type").isin(*types))
    out = relation.select("relation_id", "relation_type", F.col("source_id").alias("near"), F.col("target_id").alias("far"))
    back = relation.select("relation_id", "relation_type", F.col("target_id").alias("near"), F.col("source_id").alias("far"))
    if direction == "outgoing":
        return out
    if direction == "incoming":
        return back
    if direction == "both":
        return out.unionByName(back.where("near != far"))
    raise ValueError(f"unknown direction {direction}")


def neighbors(start: DataFrame, relation: DataFrame, object_: DataFrame, direction: str = "both", types: list[str] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(object_id, relation_id, relation_type, neighbor_id, neighbor_type) of each start object; with a limit, a page in the order of relations."""
    met = edges(relation, direction, types).join(start.select(F.col("object_id").alias("near")), "near", "left_semi")
    kinds = object_.select(F.col("object_id").alias("far"), F.col("object_type").alias("neighbor_type"))
    out = met.join(kinds, "far").select(F.col("near").alias("object_id"), "relation_id", "relation_type", F.col("far").alias("neighbor_id"), "neighbor_type")
    if limit is None:
        return out
    _page(limit, offset)
    return out.orderBy("relation_id", "object_id").offset(offset).limit(limit)


@dataclass(frozen=True)
class Hop:
    """A step: its direction, the types of relations it takes, and what its target has to be."""

    direction: str = "both"
    types: tuple[str, ...] = ()
    target_type: str | None = None
    filters: tuple[tuple[str, str, object], ...] = ()


def traverse(start: DataFrame, relation: DataFrame, hops: list[str | Hop], include_once: bool = False, object_: DataFrame | None = None, assertion: DataFrame | None = None, most_nodes: int | None = None) -> DataFrame:
    """(kind, id, depth): nodes and edges met by breadth-first steps; a plain direction is a hop without conditions.

    Edges to nodes already visited are dropped, or kept once with `include_once`; such nodes
    are never expanded again. `object_` and `assertion` serve the hops' conditions. `most_nodes` new nodes
    at most are met, the first ones by depth and id; the walk ends there and edges to others are left out. Visited nodes are
    anti-joined, so a frontier is a distributed table of any size; each hop is cut by a checkpoint.
    """
    steps = [h if isinstance(h, Hop) else Hop(h) for h in hops]
    if len(steps) > MOST_HOPS:
        raise ValueError(f"{MOST_HOPS} hops at most")
    if any(h.target_type or h.filters for h in steps) and object_ is None:
        raise ValueError("conditions on targets need the objects")
    node = start.select(F.col("object_id").alias("id")).distinct().withColumn("depth", F.lit(0))
    edge, frontier, left = None, node, most_nodes
    for depth, hop in enumerate(steps, 1):
        step = edges(relation, hop.direction, list(hop.types)).join(frontier.select(F.col("id").alias("near")), "near", "left_semi").select("relation_id", "far")
        if hop.target_type or hop.filters:
            fit = object_.where(F.col("object_type") == hop.target_type) if hop.target_type else object_
            step = step.join(matching(fit, assertion, hop.filters).select(F.col("object_id").alias("far")), "far", "left_semi")
        fresh = step.join(node.select(F.col("id").alias("far")), "far", "left_anti")
        found = fresh.select(F.col("far").alias("id")).distinct().withColumn("depth", F.lit(depth))
        if left is not None:
            found = found.orderBy("id").limit(left)
        frontier = checkpointed(found)
        if left is not None:
            met = frontier.select(F.col("id").alias("far"))
            fresh = fresh.join(met, "far", "left_semi")
            step = step.join(met.unionByName(node.select(F.col("id").alias("far"))), "far", "left_semi")
            left -= frontier.count()
        taken = (step if include_once else fresh).select(F.col("relation_id").alias("id")).distinct().withColumn("depth", F.lit(depth))
        if edge is not None:
            taken = taken.join(edge.select("id"), "id", "left_anti")
        edge = taken if edge is None else edge.unionByName(taken)
        node = node.unionByName(frontier)
        if left is not None and left <= 0:
            break
    seen = node.select(F.lit("node").alias("kind"), "id", "depth")
    return seen.unionByName(edge.select(F.lit("edge").alias("kind"), "id", "depth")) if edge is not None else seen


def labelled(object_: DataFrame, assertion: DataFrame, preference: tuple[str, ...] = ("name", "label", "title")) -> DataFrame:
    """(object_id, object_type, label): nodes for a picture; the first preferred property with an active value names a node, else its key."""
    rank = F.coalesce(*[F.when(F.col("predicate") == p, F.lit(i)) for i, p in enumerate(preference)])
    best = active(assertion).where(F.col("predicate").isin(*preference)).groupBy(F.col("subject_id").alias("object_id")).agg(F.min_by("value", F.struct(rank, "assertion_id")).alias("_label"))
    return object_.join(best, "object_id", "left").select("object_id", "object_type", F.coalesce("_label", "canonical_key").alias("label"))


def provenance(assertion: DataFrame, subject: Column, limit: int | None = None) -> DataFrame:
    """(subject_id, offset): the distinct records that a subject's assertions come from; with a limit, the first ones."""
    out = assertion.where(subject).select("subject_id", "offset").distinct()
    return out if limit is None else out.orderBy("offset", "subject_id").limit(limit)
