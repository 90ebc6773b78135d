"""Patterns learned from a stream of corrections, with a keyed state of their own.

Of each key the state holds the number of corrections, the first one by the
order columns (not by arrival) with its price, and the time of the last one.
Every micro-batch gives the changed patterns anew. Patterns that stay for good
are a streaming aggregation. One that may expire has a processor of its own,
which costs Python milliseconds a key and batch: a pattern that no correction
has confirmed for a while is given once more as expired and its state removed by
a timer of event time, or goes by the state's time to live.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

KEYS = ["supplier", "account", "description"]
#: A boost grows by STEP with each correction up to MOST; prices within so much of the first one fit.
STEP, MOST, LOW, HIGH = 0.05, 0.3, 0.8, 1.2
DESCRIPTION_CHARS = 100
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


#: Keyed state with timers needs RocksDB; without file allocation ahead, which takes 4 MB a partition and restart, many small partitions take little disk.
STATE_SETTINGS = {PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """While it lasts, streams keep their state in RocksDB; the settings are put back."""
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class PatternState(StatefulProcessor):
    """One pattern per key; keep_ms: how long after its last correction it expires in event time; ttl_ms: in processing time."""

    def __init__(self, order: list[str], state: StructType, keep_ms: int | None, ttl_ms: int | None):
        self.order, self.fields, self.keep_ms, self.ttl_ms = order, state, keep_ms, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.pattern = handle.getValueState("pattern", self.fields, self.ttl_ms)

    def _row(self, key: tuple, state: tuple, expired: bool) -> pd.DataFrame:
        n, last, price = state[0], state[1], state[2]
        found = {"n": n, "boost": min(MOST, STEP * n), "first_price": price, "price_min": max(0.0, LOW * price), "price_max": HIGH * price, "last_updated": pd.Timestamp(last, unit="us", tz="UTC"), "expired": expired}
        return pd.DataFrame([dict(zip(KEYS, key, strict=True)) | found])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.pattern.get() if self.pattern.exists() else None
        n, last, best = (old[0], old[1], tuple(old[2:])) if old else (0, None, None)
        for batch in rows:
            first = batch.sort_values(self.order, kind="stable").iloc[0]
            mine = (float(first["price"]), *(first[c].item() if hasattr(first[c], "item") else first[c] for c in self.order))
            best = mine if best is None or mine[1:] < best[1:] else best
            n += len(batch)
            newest = int(batch["ts_us"].max())
            last = newest if last is None else max(last, newest)
        self.pattern.update((n, last, *best))
        if self.keep_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(last // 1000 + self.keep_ms)
        yield self._row(key, (n, last, *best), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.pattern.exists():
            state = self.pattern.get()
            self.pattern.clear()
            yield self._row(key, tuple(state), True)

    def close(self) -> None:
        pass


def _lasting_patterns(c: DataFrame, order: list[str]) -> DataFrame:
    """keyed_patterns of prepared corrections whose patterns never expire; those of a batch are summed up before they are dealt by key."""
    p = c.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.min_by("price", F.struct(*order)).alias("first_price"), F.max("ts").alias("last_updated"))
    price = F.col("first_price")
    return p.select(*KEYS, "n", F.least(F.lit(MOST), STEP * F.col("n")).alias("boost"), price, F.greatest(F.lit(0.0), LOW * price).alias("price_min"), (HIGH * price).alias("price_max"), "last_updated", F.lit(False).alias("expired"))


def keyed_patterns(corrections: DataFrame, order: list[str], keep: str | None = None, ttl_ms: int | None = None, late: str = "1 hour") -> DataFrame:
    """(supplier, account, description, n, boost, first_price, price_min, price_max, last_updated, expired), for update mode.

    corrections(supplier, account, description, price, ts, order...) is a
    stream. Those without supplier ("unknown" too), account or description
    teach nothing; a missing price counts as 0. order tells which correction is
    the first; it should be unique within a key and without nulls. keep, an
    interval like "30 days", needs a watermark, which late gives.
    """
    if keep is not None and ttl_ms is not None:
        raise ValueError("a pattern expires by event time or by processing time, not by both")
    c = corrections.withColumn("description", F.substring("description", 1, DESCRIPTION_CHARS)).withColumn("price", F.coalesce(F.col("price").cast("double"), F.lit(0.0)))
    c = c.where("supplier <> 'unknown' AND supplier <> '' AND account <> '' AND description <> ''").withColumn("ts_us", F.unix_micros("ts"))
    if keep is None and ttl_ms is None:
        return _lasting_patterns(c, order)
    if keep is not None:
        c = c.withWatermark("ts", late)
        keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    fields = StructType().add("n", "long").add("last", "long").add("price", "double")
    for name in order:
        fields = fields.add(c.schema[name])
    out = StructType([c.schema[k] for k in KEYS]).add("n", "long").add("boost", "double").add("first_price", "double").add("price_min", "double").add("price_max", "double").add("last_updated", "timestamp").add("expired", "boolean")
    processor = PatternState(order, fields, keep_ms if keep is not None else None, ttl_ms)
    mode = "EventTime" if keep is not None else "ProcessingTime"
    needed = list(dict.fromkeys([*KEYS, "price", "ts", "ts_us", *order]))
    return c.select(needed).groupBy(*KEYS).transformWithStateInPandas(processor, out, "Update", mode)
