"""A fluent pipeline: typed input, profile, validation, cleaning, sink. Nothing runs before `run`."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from qualigraph.functions import typing
from qualigraph.operators import clean, profile, validate
from qualigraph.operators.lineage import spread
from qualigraph.sources import sinks


class PipelineError(ValueError):
    pass


@dataclass
class Result:
    rows: int
    invalid: DataFrame | None
    profile: DataFrame | None
    violations: DataFrame | None
    cleaned: DataFrame
    metrics: dict


class Pipeline:
    def __init__(self, source: DataFrame, offset: str | None = None):
        self._source, self._offset = source, offset
        self._fields: list[typing.Field] | None = None
        self._profile = self._ran = False
        self._rules: list[validate.Rule] = []
        self._transforms: list[clean.Transform] = []
        self._sink: Callable[[DataFrame], None] | None = None

    def with_types(self, fields: list[typing.Field] | None = None) -> Pipeline:
        self._fields = fields if fields is not None else typing.infer(self._source)
        return self

    def with_profile(self) -> Pipeline:
        self._profile = True
        return self

    def with_validation(self, rules: list[validate.Rule]) -> Pipeline:
        if self._offset is None:
            raise PipelineError("validation needs a column with row offsets")
        self._rules += rules
        return self

    def with_transform(self, transform: clean.Transform) -> Pipeline:
        if transform in self._transforms:
            raise PipelineError("DuplicateTransform")
        self._transforms.append(transform)
        return self

    def with_sink(self, sink: Callable[[DataFrame], None]) -> Pipeline:
        self._sink = sink
        return self

    def run(self) -> Result:
        """Run once. The typed rows are kept on disk while several consumers read them."""
        if self._sink is None:
            raise PipelineError("MissingSink")
        if self._ran:
            raise PipelineError("PipelineAlreadyRun")
        self._ran = True
        source = spread(self._source)
        typed = typing.convert(source, self._fields) if self._fields else source
        kept = typed.persist(StorageLevel.MEMORY_AND_DISK) if self._profile or self._rules else typed
        cleaned = clean.clean(kept, self._transforms) if self._transforms else kept
        metrics = sinks.measured(cleaned, self._sink)
        return Result(
            metrics["rows"],
            typing.invalid_counts(self._source, self._fields) if self._fields else None,
            profile.report(kept) if self._profile else None,
            validate.violations(kept, self._rules, self._offset) if self._rules else None,
            cleaned,
            metrics,
        )
