"""Keyed state, the bucket store and late rows: arrival order, restarts, replays and stopped batches."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import patterns as P
from ledgerloom.streaming import streams as ST
from ledgerloom.streaming.seen import SeenIndex, dedupe_stream
from ledgerloom.streaming.store import BucketStore, upsert_stream

CORRECTIONS = "supplier string, account string, description string, price double, ts timestamp, id long, wave int"


def corrections(spark, rows):
    return spark.createDataFrame(rows, "supplier string, account string, description string, price double, ts string, id long, wave int").withColumn("ts", F.to_timestamp("ts"))


def test_keyed_patterns_do_not_depend_on_arrival(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(60):
        rows.append((rnd.choice(["s", "t"]), rnd.choice(["3400", "4930"]), "x" * 120 if i % 7 == 0 else "bolt", None if i % 11 == 0 else float(rnd.randrange(1, 50)), f"2024-01-{rnd.randrange(1, 28):02d} 10:00:00", i, rnd.randrange(3)))
    rows += [(None, "1", "d", 1.0, "2024-01-01 00:00:00", 90, 0), ("unknown", "1", "d", 1.0, "2024-01-01 00:00:00", 91, 0), ("s", "", "d", 1.0, "2024-01-01 00:00:00", 92, 1), ("s", "1", "", 1.0, "2024-01-01 00:00:00", 93, 2)]
    with P.keyed_state(spark):
        out = ST.latest(ST.through_restarts(corrections(spark, rows), lambda s: P.keyed_patterns(s, ["ts_us", "id"]), "update"), P.KEYS)
    found = {(r.supplier, r.account, r.description): (r.n, round(r.boost, 6), r.first_price, round(r.price_min, 6), round(r.price_max, 6), str(r.last_updated)) for r in out.collect()}
    expected = {}
    for s, a, d, p, ts, i, _ in sorted(rows, key=lambda r: (r[4], r[5])):
        if s not in (None, "unknown") and a and d:
            n, _, first, *_ = expected.get((s, a, d[:100]), (0, 0, p or 0.0))
            expected[s, a, d[:100]] = (n + 1, round(min(0.3, 0.05 * (n + 1)), 6), first, round(0.8 * first, 6), round(1.2 * first, 6), ts)
    assert found == expected


def test_unconfirmed_patterns_expire(spark):
    rows = [("s", "1", "old", 5.0, "2024-01-01 00:00:00", 1, 0), ("s", "1", "kept", 5.0, "2024-01-01 00:00:00", 2, 0), ("s", "1", "kept", 7.0, "2024-01-09 00:00:00", 3, 1), ("s", "1", "clock", 1.0, "2024-01-15 00:00:00", 4, 2), ("s", "1", "clock", 1.0, "2024-01-15 00:00:00", 5, 2)]
    with P.keyed_state(spark):
        out = ST.through_restarts(corrections(spark, rows), lambda s: P.keyed_patterns(s, ["ts_us", "id"], keep="10 days"), "update")
    found = {r.description: (r.n, r.expired) for r in ST.latest(out, P.KEYS).collect()}
    assert found == {"old": (1, True), "kept": (2, False), "clock": (2, False)}


def test_lasting_patterns_need_no_python(spark, tmp_path):
    """Many keys, each changed by every wave, and one that has half of the corrections; a processor of our own took milliseconds for each."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, "s").otherwise(F.concat(F.lit("t"), (F.col("id") % 20_000).cast("string"))).alias("supplier"), F.lit("1").alias("account"), F.lit("d").alias("description"), (1 + F.col("id")).cast("double").alias("price"), F.timestamp_seconds(1_700_000_000 - F.col("id")).alias("ts"), "id", (F.col("id") / 20_000).cast("int").alias("wave"))
    rows.drop("wave").limit(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.drop("wave").schema).parquet(f"file://{tmp_path}/in")
    plan = lambda **expiry: P.keyed_patterns(stream, ["ts_us", "id"], **expiry)._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan() and "TransformWithState" not in plan()
    assert all("TransformWithState" in plan(**expiry) for expiry in ({"keep": "1 day"}, {"ttl_ms": 5}))
    with P.keyed_state(spark):
        out = ST.latest(ST.through_restarts(rows, lambda s: P.keyed_patterns(s, ["ts_us", "id"]), "update"), P.KEYS).drop("account", "description")
    found = {r.supplier: tuple(r)[1:4] + (r.last_updated.timestamp(), r.expired) for r in out.collect()}
    # Later ids are earlier in time: the third wave has the first correction of each key, the first wave the last one.
    expected = {f"t{i}": (3, 0.15, 40_001.0 + i, 1_700_000_000 - i, False) for i in range(1, 20_000, 2)} | {"s": (30_000, 0.3, 59_999.0, 1_700_000_000, False)}
    assert {k: (v[0], round(v[1], 6), *v[2:]) for k, v in found.items()} == expected


def test_state_settings(spark):
    before = spark.conf.get(P.PROVIDER, None)
    with pytest.raises(ZeroDivisionError), P.keyed_state(spark):
        assert "RocksDB" in spark.conf.get(P.PROVIDER)
        1 / 0  # noqa: B018
    assert spark.conf.get(P.PROVIDER, None) == before
    with pytest.raises(ValueError, match="not by both"):
        P.keyed_patterns(corrections(spark, []), ["id"], keep="1 day", ttl_ms=5)


def test_state_takes_no_disk_ahead(spark):
    """RocksDB allocates 4 MB a partition and restart ahead, unless it is told not to; the setting is put back too."""
    name = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"
    before = spark.conf.get(name, None)
    with P.keyed_state(spark):
        assert spark.conf.get(name) == "false"
    assert spark.conf.get(name, None) == before


ROWS = "k long, at long, v string"


def contents(store):
    return {r.k: (r.at, r.v) for r in store.read().collect()}


@pytest.fixture
def store(spark, tmp_path):
    return BucketStore(spark, f"file://{tmp_path}/store", "k", ["at"], first_buckets=4, bucket_rows=1_000)


def test_store_replaces_by_key(spark, store):
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.merge(spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (2, 2, "c"), (None, 1, "x"), (3, None, "n")], ROWS), 0)
    assert contents(store) == {1: (1, "a"), 2: (2, "c"), 3: (None, "n")}
    before = store.manifest()
    assert store.merge(spark.createDataFrame([(1, 0, "older"), (3, 1, "m")], ROWS), 1)
    assert contents(store) == {1: (1, "a"), 2: (2, "c"), 3: (1, "m")}
    assert not store.merge(spark.createDataFrame([(1, 9, "again")], ROWS), 1)
    assert contents(store)[1] == (1, "a")
    assert store.merge(spark.createDataFrame([], ROWS), 2) and contents(store) == {1: (1, "a"), 2: (2, "c"), 3: (1, "m")}
    assert store.manifest()["version"] == before["version"] + 2


def test_store_rewrites_touched_buckets_only(spark, store):
    store.merge(spark.range(100).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("at"), F.lit("a").alias("v")), 0)
    before = store.manifest()
    store.merge(spark.createDataFrame([(7, 2, "new")], ROWS), 1)
    after = store.manifest()
    assert sum(before["files"][b] != after["files"][b] for b in before["files"]) == 1
    assert sum(after["rows"].values()) == 100 and contents(store)[7] == (2, "new")


def test_store_survives_a_stopped_batch(spark, store, monkeypatch):
    store.merge(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], ROWS), 0)
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda manifest: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            store.merge(spark.createDataFrame([(1, 2, "half")], ROWS), 1)
    again = BucketStore(spark, store.path, "k", ["at"])
    assert contents(again) == {1: (1, "a"), 2: (1, "b")}
    assert again.merge(spark.createDataFrame([(1, 2, "whole")], ROWS), 1)
    assert contents(again) == {1: (2, "whole"), 2: (1, "b")}
    assert len(again.clean(keep=1)) == 1 and contents(again) == {1: (2, "whole"), 2: (1, "b")}


def test_store_has_one_writer_a_version(spark, store):
    store.merge(spark.createDataFrame([(1, 1, "a")], ROWS), 0)
    stale = store.manifest()
    store.merge(spark.createDataFrame([(1, 2, "b")], ROWS), 1)
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(stale | {"version": stale["version"] + 1})
    assert contents(store) == {1: (2, "b")}


def test_store_grows(spark, tmp_path):
    store = BucketStore(spark, f"file://{tmp_path}/grown", "k", ["at"], first_buckets=2, bucket_rows=50)
    for epoch in range(4):
        store.merge(spark.range(100 * epoch, 100 * epoch + 150).select(F.col("id").alias("k"), F.lit(epoch).cast("long").alias("at"), F.lit(str(epoch)).alias("v")), epoch)
    m = store.manifest()
    assert m["buckets"] == 16 and sum(m["rows"].values()) == 450 and m["epoch"] == 3
    assert contents(store) == {k: (min(3, k // 100), str(min(3, k // 100))) for k in range(450)}


def test_upsert_goes_on_from_its_log(spark, tmp_path, store):
    rows = [(i % 20, i, str(i)) for i in range(90)]
    log = f"file://{tmp_path}/log"
    for k in range(3):
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], ROWS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(ROWS).parquet(f"file://{tmp_path}/in")
        upsert_stream(stream, store, log)
        assert store.manifest()["epoch"] == k
    upsert_stream(spark.readStream.schema(ROWS).parquet(f"file://{tmp_path}/in"), store, log)
    assert store.manifest()["epoch"] == 2 and contents(store) == {k: max((i, str(i)) for i in range(90) if i % 20 == k) for k in range(20)}


def test_late_rows_are_set_apart_and_batches_repeat(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", 0), (2, "2024-01-01 05:00:00", 0), (3, "2024-01-01 00:20:00", 1), (4, "2024-01-01 03:30:00", 1), (5, "2024-01-01 02:59:00", 1), (6, "2024-01-01 09:00:00", 2)]
    d = spark.createDataFrame(rows, "event_id long, ts string, wave int").withColumn("ts", F.to_timestamp("ts")).withColumns({"user_id": F.lit(1), "event_type": F.lit("error"), "value": F.col("event_id").cast("double"), "props": F.lit("{}")})
    folder = ST.through_restarts(d, lambda e: e, sink=ST.tumbling_partials)
    late = {r.event_id for r in spark.read.parquet(f"{folder}/late").collect()}
    # The newest event of the first wave is of 5:00: hours that ended at 4:00 or before are closed.
    assert late == {3, 4, 5}
    sums = {str(r.start)[11:13]: (r.n, r.mean, r.error_rate) for r in ST.merged_partials(spark, folder).collect()}
    assert sums == {"00": (1, 1.0, 1.0), "05": (1, 2.0, 1.0), "09": (1, 6.0, 1.0)}


def test_seen_contents(spark, tmp_path):
    index = SeenIndex(spark, f"file://{tmp_path}/seen")
    hashed = lambda ids: spark.createDataFrame([(i, None if i is None else f"h{i}") for i in ids], "id long, hash string")
    assert index.unseen(hashed([1, None]), ["id"], 0).count() == 1
    index.add(hashed(range(3000)), 0)
    index.add(hashed(range(5000, 5010)), 1)
    batch = hashed([*range(2990, 3200), 5005, 5020, 5020, *range(9000, 12000)])
    judged = {r.id: r.doubtful for r in index.with_doubt(batch).collect()}
    assert all(judged[i] for i in (*range(2990, 3000), 5005))
    assert sum(judged[i] for i in judged if not (i < 3000 or i == 5005)) < 60
    new = sorted(r.id for r in index.unseen(batch, ["id"], 2).collect())
    assert new == [*range(3000, 3200), 5020, *range(9000, 12000)]
    # Epoch 1 given again reads epoch 0 only.
    assert [r.id for r in index.unseen(hashed([5005, 2999]), ["id"], 1).collect()] == [5005]
    index.add(hashed([5005]), 1)
    assert index.hashes().count() == 3001


def test_dedupe_goes_on_from_its_log(spark, tmp_path):
    index, source, folder = SeenIndex(spark, f"file://{tmp_path}/seen"), f"file://{tmp_path}/in", f"file://{tmp_path}/work"
    for k in range(3):
        spark.createDataFrame([(10 * k + i, f"h{(7 * k + i) % 12}") for i in range(10)], "id long, hash string").coalesce(1).write.mode("append").parquet(source)
        dedupe_stream(spark.readStream.schema("id long, hash string").parquet(source), index, ["id"], folder)
    assert sorted((r.hash, r.id) for r in spark.read.schema("id long, hash string").parquet(f"{folder}/out").collect()) == sorted([(f"h{i}", i) for i in range(10)] + [("h10", 13), ("h11", 14)])


def test_streams_without_rows(spark):
    none = spark.createDataFrame([], "event_id long, ts timestamp, user_id long, event_type string, value double, props string, wave int")
    assert ST.through_restarts(none, ST.learned_patterns, "update").count() == 0
    assert ST.through_restarts(none, ST.tumbling_metrics).count() == 0
