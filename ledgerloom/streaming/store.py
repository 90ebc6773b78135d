"""A table that a stream replaces by key: hash buckets, copied on write, listed by manifests.

A version of the table is a manifest, which names the files' folder of every
bucket. A batch reads and rewrites the buckets that its keys fall in and leaves
all others where they are; its manifest is put in place as the last step, by a
rename that fails if that version exists. Folders that no manifest names (a
batch that was stopped on its way) are never read, and are removed by `clean`.
A batch that is given again after its manifest was written changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FIRST_BUCKETS = 16
#: Buckets are split in two when they hold more rows than this on average.
BUCKET_ROWS = 2_000_000


class BucketStore:
    """The store below path; rows have the unique column key, and of equal keys the one with the greatest order columns stays (nulls are least)."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: list[str], first_buckets: int = FIRST_BUCKETS, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, order
        self.first_buckets, self.bucket_rows = first_buckets, bucket_rows

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at, fs = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("manifests") if n.endswith(".json")]

    def manifest(self) -> dict:
        """The newest version: {version, epoch, schema, buckets, files: {bucket: folder}, rows: {bucket: n}}; an empty one before the first batch."""
        found = self.versions()
        if not found:
            return {"version": -1, "epoch": -1, "schema": None, "buckets": self.first_buckets, "files": {}, "rows": {}}
        text = self.spark.read.text(f"{self.path}/manifests/{max(found):012d}.json", wholetext=True).first().value
        m = json.loads(text)
        return m | {"files": {int(k): v for k, v in m["files"].items()}, "rows": {int(k): v for k, v in m["rows"].items()}}

    def _commit(self, m: dict) -> None:
        folder, fs = self._fs(f"{self.path}/manifests")
        fs.mkdirs(folder)
        new, _ = self._fs(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(new, False)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        final, _ = self._fs(f"{self.path}/manifests/{m['version']:012d}.json")
        if fs.exists(final) or not fs.rename(new, final):
            fs.delete(new, False)
            raise RuntimeError(f"version {m['version']} was written by another writer")

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _rows(self, m: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(m["schema"])
        paths = [f"{self.path}/data/{f}" for f in sorted({m["files"][b] for b in (m["files"] if buckets is None else buckets) if b in m["files"]})]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """All rows of the newest version."""
        m = self.manifest()
        if m["schema"] is None:
            raise FileNotFoundError(f"nothing has been stored at {self.path}")
        return self._rows(m)

    def merge(self, batch: DataFrame, epoch: int) -> bool:
        """Puts the rows of a batch in place; False if that epoch (or a later one) is in already. Rows without key are left out."""
        m = self.manifest()
        if epoch <= m["epoch"]:
            return False
        new = batch.where(F.col(self.key).isNotNull())
        schema = m["schema"] or new.schema.jsonValue()
        new = new.select([f["name"] for f in schema["fields"]])
        touched = sorted(r.b for r in new.select(self._bucket(m["buckets"]).alias("b")).distinct().collect())  # at most a number per bucket
        old = self._rows(m | {"schema": schema}, touched)
        self._replace(m | {"schema": schema, "epoch": epoch}, touched, old.unionByName(new), m["buckets"])
        return True

    def _replace(self, m: dict, touched: list[int], rows: DataFrame, buckets: int) -> None:
        rest = [f["name"] for f in m["schema"]["fields"] if f["name"] != self.key]
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(*self.order)).alias("_r")).select(self.key, "_r.*")
        folder = f"{m['version'] + 1:012d}-{uuid.uuid4().hex}"
        placed = last.withColumn("_bucket", self._bucket(buckets))
        placed.repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        files, counts = dict(m["files"]), dict(m["rows"])
        for b in touched:
            files.pop(b, None)
            counts.pop(b, None)
        written, names = self.spark.read.parquet(f"{self.path}/data/{folder}") if touched else None, self._names(f"data/{folder}")
        if any(n.startswith("_bucket=") for n in names):
            for r in written.groupBy("_bucket").count().collect():
                files[r._bucket], counts[r._bucket] = f"{folder}/_bucket={r._bucket}", r["count"]
        m = m | {"version": m["version"] + 1, "buckets": buckets, "files": files, "rows": counts}
        self._commit(m)
        if sum(counts.values()) > self.bucket_rows * buckets:
            self.split()

    def split(self) -> None:
        """Twice as many buckets; a version of its own with the same rows."""
        m = self.manifest()
        rows, buckets = self._rows(m), 2 * m["buckets"]
        self._replace(m | {"files": {}, "rows": {}}, list(range(buckets)), rows, buckets)

    def clean(self, keep: int = 2) -> list[str]:
        """Removes manifests but the newest ones and the folders that none of these names; returns what went. No batch may be on its way."""
        gone = []
        for v in self.versions()[:-keep]:
            at, fs = self._fs(f"{self.path}/manifests/{v:012d}.json")
            fs.delete(at, False)
        named: set[str] = set()
        for v in self.versions():
            text = self.spark.read.text(f"{self.path}/manifests/{v:012d}.json", wholetext=True).first().value
            named |= {f.split("/")[0] for f in json.loads(text)["files"].values()}
        for folder in self._names("data"):
            if folder not in named:
                at, fs = self._fs(f"{self.path}/data/{folder}")
                fs.delete(at, True)
                gone.append(folder)
        return gone


def upsert_stream(stream: DataFrame, store: BucketStore, log: str) -> None:
    """Merges all that a stream has now into the store; started again with the same log it goes on where it stopped."""
    stream.writeStream.foreachBatch(lambda batch, epoch: store.merge(batch, epoch) and None).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
