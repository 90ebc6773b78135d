"""Running sums and counts over few large groups, and sums over a moving stretch of time.

A window function gives a whole group to one task. Here rows are dealt by ranges
of (group, order), so that a large group spans many tasks; each range is summed
for itself, the sums of the ranges before it (a row per range and group) are its
offset, and windows run within ranges only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import is_small, stored


def running_sums(df: DataFrame, keys: list[str], order: list[Column | str], value: Column | str, before: str = "before", total: str | None = None) -> DataFrame:
    """df with the sum of value over all earlier rows of its group (0 for the first), and the group's total.

    order should tell a group's rows apart; of equal ones any may come first. A
    null value adds nothing, null keys are a group, an empty table stays empty.
    """
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = df.withColumn("_value", F.col(value) if isinstance(value, str) else value).repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *by)
    # The ranges are written with their numbers, as both passes have to see the same ones.
    rows = stored(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = rows.groupBy("_range", *keys).agg(F.sum("_value").alias("_sum"))
    group = Window.partitionBy(*keys)
    offsets = ranges.select(F.col("_range").alias("_r"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("_sum").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"), F.coalesce(F.sum("_sum").over(group), F.lit(0)).alias("_total"))
    offsets = stored(offsets, "offsets")
    within = Window.partitionBy("_range", *keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = local.join(F.broadcast(offsets) if is_small(offsets) else offsets, same).withColumn(before, F.col("_offset") + F.col("_local"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.select(*df.columns, before, *([total] if total else []))


def moving_sums(df: DataFrame, keys: list[str], at: str, width: int, value: Column | str, result: str = "moving") -> DataFrame:
    """df with the sum of value over its group's rows from at - width to at, both included, at being a whole number.

    Time is cut into steps of width; a row is sent to its own step and as
    history to the next one, so a task holds two steps of a group, never the
    group. Rows without at are left out.
    """
    step = F.floor(F.col(at) / width)
    known = df.where(F.col(at).isNotNull()).withColumn("_value", F.col(value) if isinstance(value, str) else value)
    twice = known.withColumn("_step", F.explode(F.array(step, step + 1)))
    stretch = Window.partitionBy("_step", *keys).orderBy(at).rangeBetween(-width, 0)
    return twice.withColumn(result, F.sum("_value").over(stretch)).where(F.col("_step") == step).select(*df.columns, result)
