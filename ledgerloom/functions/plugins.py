"""Plug-ins: producers of feature columns, and document processors as Arrow functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Producer = Callable[[DataFrame], dict[str, Column]]


@dataclass
class FeaturePipeline:
    """Named producers whose columns are computed in one select, each prefixed with its producer's name.

    A producer that cannot be built for a table (a missing column, say) is left
    out and named in `failed`; values never raise, they are built from try_*
    functions.
    """

    producers: dict[str, Producer] = field(default_factory=dict)
    disabled: set[str] = field(default_factory=set)
    failed: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, producer: Producer) -> FeaturePipeline:
        self.producers[name] = producer
        return self

    def enable(self, name: str, on: bool = True) -> None:
        (self.disabled.discard if on else self.disabled.add)(name)

    def columns(self, df: DataFrame) -> dict[str, Column]:
        out: dict[str, Column] = {}
        self.failed.clear()
        for name, producer in self.producers.items():
            if name in self.disabled:
                continue
            try:
                made = {f"{name}_{k}": c for k, c in producer(df).items()}
                _ = df.select([c.alias(k) for k, c in made.items()]).schema
            except Exception as e:
                self.failed[name] = type(e).__name__
                continue
            out |= made
        return out

    def extract(self, df: DataFrame, keys: list[str]) -> DataFrame:
        made = self.columns(df)
        return df.select(*keys, *(c.alias(k) for k, c in made.items()), F.lit(len(made)).alias("n_features"), F.lit(len(self.producers) - len(self.disabled) - len(self.failed)).alias("n_producers"))


def process_documents(df: DataFrame, strategy: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, available: Callable[[], bool] = lambda: True) -> DataFrame:
    """df through a user's function of Arrow batches; an unavailable strategy gives no rows."""
    if not available():
        return df.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield strategy(b)

    return df.mapInArrow(run, schema)
