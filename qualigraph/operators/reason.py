"""Bounded forward-chaining inference over assertions, its explanation, and identity resolution."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualigraph.functions.text import uuid5
from qualigraph.operators.graph import NAMESPACE, active
from qualigraph.operators.lineage import checkpointed

MOST_ITERATIONS = 8
MOST_ASSERTIONS = 10_000
MOST_OBJECTS = 100_000


class ReasoningError(ValueError):
    pass


@dataclass(frozen=True)
class Condition:
    predicate: str
    op: str = "exists"
    value: str | None = None

    def holds(self) -> Column:
        v = F.col("value")
        test = {"exists": F.lit(True), "equals": v == F.lit(self.value), "not_equals": v != F.lit(self.value)}[self.op]
        return (F.col("predicate") == self.predicate) & test


@dataclass(frozen=True)
class Rule:
    """Conditions on one subject and what follows; `copy_from` takes the value of that condition's premise instead of `value`."""

    id: str
    conditions: tuple[Condition, ...]
    predicate: str
    value: str | None = None
    version: int = 1
    confidence: float = 1.0
    copy_from: str | None = None
    value_type: str = "string"

    def __post_init__(self):
        if (self.value is None) == (self.copy_from is None):
            raise ReasoningError(f"{self.id}: a conclusion has a value or copies one")
        if not self.conditions or (self.copy_from and self.copy_from not in [c.predicate for c in self.conditions]):
            raise ReasoningError(f"{self.id}: a copied value comes from a condition")
        if not 0 <= self.confidence <= 1:
            raise ReasoningError(f"{self.id}: confidence is between 0 and 1")

    def check(self, declared: dict[str, str]) -> None:
        """Refuse predicates that a type doesn't declare, and conclusions of another type of value."""
        if unknown := sorted({c.predicate for c in self.conditions} - set(declared)):
            raise ReasoningError(f"{self.id}: conditions on undeclared {', '.join(unknown)}")
        if declared.get(self.predicate) != self.value_type:
            raise ReasoningError(f"{self.id}: the conclusion {self.predicate} is not declared as {self.value_type}")


#: What an assertion carries into its conclusions, and what stands for a column that the table lacks.
CARRIED = {"confidence": ("decimal(19,18)", 1), "observed_at": ("timestamp", None), "valid_from": ("timestamp", None), "valid_to": ("timestamp", None), "mapping_version": ("integer", 1)}


def _premises(facts: DataFrame, rule: Rule) -> DataFrame:
    """(subject_id, p0, p1, …): one assertion (its id and what it carries) for each condition, the one with the smallest id."""
    out = None
    for i, c in enumerate(rule.conditions):
        one = facts.where(c.holds()).groupBy("subject_id").agg(F.min(F.struct("assertion_id", "value", *CARRIED)).alias(f"p{i}"))
        out = one if out is None else out.join(one, "subject_id")
    return out


def apply(assertion: DataFrame, rules: list[Rule], most_iterations: int = MOST_ITERATIONS, most_assertions: int | None = MOST_ASSERTIONS, most_objects: int | None = MOST_OBJECTS, declared: dict[str, str] | None = None) -> tuple[DataFrame, int]:
    """(inferred facts, iterations): rules run until nothing new appears or a limit is reached.

    Facts: assertion_id, subject_id, predicate, value, rule_id, iteration, premises, and
    confidence (the least of the premises times the rule's), observed_at and mapping_version (the
    greatest), valid_from and valid_to (the common part of the premises; nothing is inferred if it
    is empty). Facts of an iteration are seen in the next one only; a fact that is active already
    is not inferred again. Truncation at the limit (None: no limit) is in (subject, rule, version)
    order; `most_objects` subjects, the first by id, are looked at. `declared` maps the predicates of
    the subjects' type to their types of value, against which rules are checked.
    """
    for r in rules if declared is not None else ():
        r.check(declared)
    # every rule of every iteration reads the facts: they are cut from their lineage once
    carried = [F.coalesce(F.col(c) if c in assertion.columns else F.lit(None), F.lit(default)).cast(kind).alias(c) for c, (kind, default) in CARRIED.items()]
    live = checkpointed(active(assertion).select("assertion_id", "subject_id", "predicate", "value", *carried))
    if most_objects is not None:
        live = checkpointed(live.join(live.select("subject_id").distinct().orderBy("subject_id").limit(most_objects), "subject_id", "left_semi").select(*live.columns))
    inferred, left, n = None, most_assertions, 0
    for n in range(1, most_iterations + 1):
        facts = live if inferred is None else live.unionByName(inferred.select(*live.columns))
        found = None
        for r in sorted(rules, key=lambda r: (r.id, r.version)):
            premises = _premises(facts, r)
            names = [f"p{i}" for i in range(len(r.conditions))]
            source = next((p for p, c in zip(names, r.conditions, strict=True) if c.predicate == r.copy_from), None)
            premises = premises.withColumn("value", F.lit(r.value) if source is None else F.col(f"{source}.value"))
            known = facts.where(F.col("predicate") == r.predicate).select("subject_id", "value")
            ids = [F.col(f"{p}.assertion_id") for p in names]
            sure, seen, starts, ends, versions = ([F.col(f"{p}.{c}") for p in names] for c in CARRIED)
            low, high = _common(starts, ends)
            new = premises.join(known, ["subject_id", "value"], "left_anti").where(F.coalesce(low <= high, F.lit(True))).select(
                uuid5(NAMESPACE, F.concat_ws(":", F.lit(f"{r.id}@{r.version}"), "subject_id", *ids)).alias("assertion_id"),
                "subject_id",
                F.lit(r.predicate).alias("predicate"),
                "value",
                F.lit(r.id).alias("rule_id"),
                F.lit(r.version).alias("rule_version"),
                F.lit(n).alias("iteration"),
                F.array(*ids).alias("premises"),
                (F.least(*sure, sure[0]) * F.lit(str(r.confidence)).cast("decimal(19,18)")).cast("decimal(19,18)").alias("confidence"),
                F.greatest(*seen, seen[0]).alias("observed_at"),
                low.alias("valid_from"),
                high.alias("valid_to"),
                F.greatest(*versions, versions[0]).alias("mapping_version"),
            )
            found = new if found is None else found.unionByName(new)
        # two rules with one conclusion: the first one's fact stands
        first = found.groupBy("subject_id", "predicate", "value").agg(F.min(F.struct("rule_id", "rule_version", "assertion_id", "iteration", "premises", *CARRIED)).alias("r"))
        found = first.select("r.assertion_id", "subject_id", "predicate", "value", "r.rule_id", "r.rule_version", "r.iteration", "r.premises", *[f"r.{c}" for c in CARRIED])
        found = checkpointed(found)
        count = found.count()
        if left is not None and count > left:
            found, count = checkpointed(found.orderBy("subject_id", "rule_id", "rule_version").limit(left)), left
        if not count:
            break
        inferred, left = found if inferred is None else inferred.unionByName(found), None if left is None else left - count
        if left is not None and left <= 0:
            break
    if inferred is None:
        inferred = found
    return inferred.drop("rule_version"), n


def explain(inferred: DataFrame, depth: int = 8) -> DataFrame:
    """(root_id, premise_id, depth): the premises of each inferred fact down to a depth; a premise that is its own root stops."""
    step = inferred.select("assertion_id", F.explode("premises").alias("premise_id"))
    level = step.select(F.col("assertion_id").alias("root_id"), "premise_id", F.lit(1).alias("depth"))
    out = level
    for d in range(2, depth + 1):
        below = level.select("root_id", F.col("premise_id").alias("assertion_id")).join(step, "assertion_id").where("root_id != premise_id")
        level = checkpointed(below.select("root_id", "premise_id", F.lit(d).alias("depth")).distinct())
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def _common(starts: list[Column], ends: list[Column]) -> tuple[Column, Column]:
    # a bound twice, since greatest and least want two columns
    return F.greatest(*starts, starts[0]), F.least(*ends, ends[0])


def intersect(starts: list[Column], ends: list[Column]) -> tuple[Column, Column]:
    """The common part of closed intervals, null bounds open; (null, null) if it is empty."""
    low, high = _common(starts, ends)
    bad = F.coalesce(low > high, F.lit(False))
    return F.when(~bad, low), F.when(~bad, high)


def candidates(pairs: DataFrame, score: Column) -> DataFrame:
    """(candidate_id, left_id, right_id, confidence) of unordered pairs, each once, the smaller id first."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    rows = pairs.where("a != b").select(low.alias("left_id"), high.alias("right_id"), score.alias("confidence")).where("confidence between 0 and 1")
    rows = rows.groupBy("left_id", "right_id").agg(F.max("confidence").alias("confidence"))
    return rows.select(uuid5(NAMESPACE, F.concat_ws(":", F.lit("candidate"), "left_id", "right_id")).alias("candidate_id"), "left_id", "right_id", "confidence")


def decide(candidate: DataFrame, threshold: float) -> DataFrame:
    """(candidate_id, decision, canonical_id, left_id, right_id): a merge creates a canonical id, a rejection none."""
    merge = F.col("confidence") >= threshold
    canonical = uuid5(NAMESPACE, F.concat_ws(":", F.lit("canonical"), "left_id", "right_id"))
    return candidate.select("candidate_id", F.when(merge, "merge").otherwise("reject").alias("decision"), F.when(merge, canonical).alias("canonical_id"), "left_id", "right_id")


def conflicts(decision: DataFrame) -> DataFrame:
    """(object_id, canonical_ids): objects merged into several canonical ones."""
    both = decision.where("decision = 'merge'").select(F.explode(F.array("left_id", "right_id")).alias("object_id"), "canonical_id")
    return both.groupBy("object_id").agg(F.count_distinct("canonical_id").alias("canonical_ids")).where("canonical_ids > 1")


def resolve(objects: DataFrame, decision: DataFrame, on_conflict: str = "error") -> DataFrame:
    """(object_id, canonical_id): one hop to the canonical id, or the object's own.

    An object merged into several canonical ones raises; with `least` the smallest of them stands.
    """
    if on_conflict not in ("error", "least"):
        raise ValueError(f"unknown way with conflicts {on_conflict}")
    both = decision.where("decision = 'merge'").select(F.explode(F.array("left_id", "right_id")).alias("object_id"), "canonical_id")
    one = F.min("canonical_id")
    if on_conflict == "error":
        one = F.when(one == F.max("canonical_id"), one).otherwise(F.raise_error(F.concat(F.lit("conflicting merges of "), F.first("object_id"))).cast("string"))
    first = both.groupBy("object_id").agg(one.alias("canonical_id"))
    return objects.select("object_id").join(first, "object_id", "left").select("object_id", F.coalesce("canonical_id", "object_id").alias("canonical_id"))


def get_object(objects: DataFrame, decision: DataFrame, ids: DataFrame, on_conflict: str = "error") -> DataFrame:
    """The rows of `objects` that `ids` (object_id) name: the canonical object if there is one, else the one named."""
    asked = resolve(ids, decision, on_conflict).withColumnRenamed("object_id", "asked_id")
    canonical = asked.join(objects.withColumnRenamed("object_id", "canonical_id"), "canonical_id", "left_semi").select("asked_id", F.col("canonical_id").alias("object_id"))
    own = asked.join(canonical, "asked_id", "left_anti").select("asked_id", F.col("asked_id").alias("object_id"))
    return canonical.unionByName(own).join(objects, "object_id")
