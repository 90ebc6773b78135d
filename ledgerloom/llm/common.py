"""What several corpus operators share: tables, checkpoints, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of whole texts that go to Python at a time.
ARROW_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Hands whole texts to Python in batches that stay small where documents are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir; where none is set, a folder of a local session's own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the checkpoint folder and goes on from there."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._scratch_path = path
    return stored


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, made from name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remove_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def put_new(spark: SparkSession, path: str, text: str) -> None:
    """Writes a new small file as a whole: under another name first, then renamed; an error if it is there."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder, _, name = path.rpartition("/")
    to, made = jvm.Path(path), jvm.Path(f"{folder}/.{uuid.uuid4().hex}-{name}")
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(to.getParent())
    out = fs.create(made, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(to) or not fs.rename(made, to):
        fs.delete(made, False)
        raise RuntimeError(f"{path} is there already")


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where there is no folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def discard(*tables: DataFrame) -> None:
    """Removes tables that cut wrote, once nothing that is still to run reads them."""
    for t in tables:
        remove_path(t.sparkSession, t._scratch_path)


#: Ids that are broadcast at most: 16 MB of longs.
MAX_BROADCAST_IDS = 1_000_000


def only_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of df with a doc_id of ids(doc_id), a stored table; few ids are broadcast, more are joined by a shuffle."""
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


#: A path of n edges settles in about the logarithm of n rounds; this is beyond any table.
MOST_ROUNDS = 1_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over undirected edges (a, b).

    Every round takes the least label among neighbours and then jumps to the
    label's own label, so that rounds grow with the logarithm of a path's
    length. State is checkpointed each round; a row count of changed labels is
    all that reaches the driver. Self-loops and repeated edges do no harm; null
    ends are left out; an empty input gives an empty result.
    """
    e = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    swapped = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = cut(e.union(swapped).distinct())
    last = labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    for _ in range(MOST_ROUNDS):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        hooked = labels.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        up = hooked.select(F.col("id").alias("component"), F.col("component").alias("above"))
        new = cut(hooked.join(up, "component", "left").select("id", "old", F.least("component", "above").alias("component")))
        changed = new.where("old <> component").limit(1).count()
        discard(last)
        last, labels = new, new.select("id", "component")
        if not changed:
            discard(both)
            return labels
    raise RuntimeError("components did not settle")


_HELD: dict = {}


def release() -> None:
    """Gives back the memory of this Python worker's last model, before work that needs none."""
    _HELD.clear()


def held(key, make):
    """What make() returns, kept in this Python worker for the next task; only the last key's value is kept.

    Workers serve one operator after another, so the memory of an earlier
    model is given back when the next one is loaded.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]
