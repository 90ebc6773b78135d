"""Comparing strategies: each runs over the same stored input, and what it does is observed while it runs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.scratch import stored

RESULT = "strategy string, success boolean, error string, items long, classified long, faults long, mean_confidence double, time_ms double"


def compare_strategies(items: DataFrame, strategies: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(strategy, success, error, items, classified, faults, mean_confidence, time_ms), a row per strategy in the given order.

    A strategy turns items into a table with account and confidence, a row per
    item; an account counts as classified where it is not null, a confidence
    outside 0 to 1 (or none) as a fault. A strategy that raises has success
    false and the error's kind. Two strategies are needed at least.
    """
    if len(strategies) < 2:
        raise ValueError("a comparison needs two strategies")
    source, rows = stored(items, "items"), []
    for name, run in strategies.items():
        seen = Observation(name)
        began = time.time()
        try:
            fine = F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
            observed = run(source).observe(seen, F.count(F.lit(1)).alias("items"), F.count("account").alias("classified"), F.count_if(~fine).alias("faults"), F.avg("confidence").alias("mean_confidence"))
            observed.write.format("noop").mode("overwrite").save()
            got = seen.get
            rows.append((name, True, None, got["items"], got["classified"], got["faults"], got["mean_confidence"], (time.time() - began) * 1000))
        except Exception as e:  # noqa: BLE001  a strategy is a plug-in
            rows.append((name, False, type(e).__name__, None, None, None, None, None))
    return items.sparkSession.createDataFrame(rows, RESULT)


def comparison_summary(compared: DataFrame) -> DataFrame:
    """One row (tested, successful, fastest, highest_confidence, most_classifications); the first by name on ties, null where none ran."""
    won = lambda order: F.min_by("strategy", F.when(F.col("success"), F.struct(order.alias("o"), F.col("strategy").alias("s"))))
    return compared.agg(
        F.count(F.lit(1)).alias("tested"),
        F.count_if("success").alias("successful"),
        won(F.col("time_ms")).alias("fastest"),
        won(-F.coalesce("mean_confidence", F.lit(-1.0))).alias("highest_confidence"),
        won(-F.col("classified")).alias("most_classifications"),
    )
