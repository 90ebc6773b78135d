"""Running and moving sums against plain loops, with a group that spans many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.running import moving_sums, running_sums


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    out = [(i, rnd.choice(["hot"] * 8 + ["a", None]), rnd.randrange(40), rnd.choice([None, *range(9)])) for i in range(500)]
    return out


def test_running_sums(spark, rows):
    df = spark.createDataFrame(rows, "id long, g string, at long, v long")
    # Without coalescing, the large group lies in several ranges.
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.id: (r.before, r.total) for r in running_sums(df, ["g"], [F.desc("at"), "id"], "v", total="total").collect()}
        ranged = df.repartitionByRange("g", F.desc("at"), "id").where("g = 'hot'").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected, sums, totals = {}, {}, {}
    for i, g, at, v in sorted(rows, key=lambda r: (-r[2], r[0])):
        expected[i] = sums.get(g, 0)
        sums[g] = sums.get(g, 0) + (v or 0)
    totals = sums
    assert found == {i: (expected[i], totals[g]) for i, g, _, _ in rows}
    assert ranged >= 5


def test_running_count_without_keys_and_without_rows(spark, rows):
    df = spark.createDataFrame(rows, "id long, g string, at long, v long")
    assert sorted(r.before for r in running_sums(df, [], ["id"], F.lit(1)).collect()) == list(range(500))
    empty = running_sums(df.limit(0), ["g"], ["id"], "v", total="t")
    assert empty.columns == ["id", "g", "at", "v", "before", "t"] and empty.count() == 0


@pytest.mark.parametrize("width", [1, 7, 40])
def test_moving_sums(spark, rows, width):
    df = spark.createDataFrame([*rows, (900, "hot", None, 1), (901, "hot", -3, 4), (902, "hot", -1, 2)], "id long, g string, at long, v long")
    found = {r.id: r.moving for r in moving_sums(df, ["g"], "at", width, "v").collect()}
    known = [*rows, (901, "hot", -3, 4), (902, "hot", -1, 2)]
    for i, g, at, _ in known:
        near = [v for _, h, b, v in known if h == g and at - width <= b <= at and v is not None]
        assert found[i] == (sum(near) if near else None)
    assert set(found) == {r[0] for r in known}
