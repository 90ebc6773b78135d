"""Contents that a stream has seen: stored hashes, and Bloom filters in front of them.

Every batch leaves its new hashes as a run of its own and a blocked Bloom filter
of them: a hash belongs to one block of 32,768 bits and sets a few of them. A
row whose bits are not all set in any run's filter is new for certain; only the
others meet the stored hashes in an anti join. A batch that is given again reads
the runs before it and writes the same run. Everything is DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_BITS = 32_768
#: Bits that a hash sets, and bits for each stored hash: about one in 250 unknown hashes is then looked up in vain.
SET, BITS_EACH = 4, 16


def _block(blocks: int):
    return F.pmod(F.xxhash64(F.lit(7), "hash"), F.lit(blocks))


def _places():
    return [F.pmod(F.xxhash64(F.lit(k), "hash"), F.lit(BLOCK_BITS)) for k in range(SET)]


class SeenIndex:
    """The index below path: runs hashes/epoch=k and filters bloom/epoch=k/blocks=n."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str, before: int) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        df = self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)
        return df.where(F.col("epoch") < before)

    def hashes(self, before: int = 1 << 40) -> DataFrame:
        """The hashes of all runs of earlier epochs."""
        return self._read("hashes", "hash string, epoch long", before).select("hash")

    def add(self, hashes: DataFrame, epoch: int) -> None:
        """Stores distinct hashes(hash) as the run of an epoch, in place of what that had; filters come last."""
        run = f"{self.path}/hashes/epoch={epoch}"
        hashes.select("hash").where("hash IS NOT NULL").write.mode("overwrite").parquet(run)
        stored = self.spark.read.schema("hash string").parquet(run)
        blocks = 1
        while blocks * BLOCK_BITS < BITS_EACH * stored.count():
            blocks *= 2
        bits = stored.select(_block(blocks).alias("block"), F.explode(F.array(*_places())).alias("place"))
        made = bits.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))
        made.withColumn("blocks", F.lit(blocks).cast("long")).write.mode("overwrite").parquet(f"{self.path}/bloom/epoch={epoch}")

    def with_doubt(self, df: DataFrame, before: int = 1 << 40) -> DataFrame:
        """df(hash, ...) with doubtful: whether a run before that epoch may hold the hash; false is certain."""
        bloom = self._read("bloom", "block long, bits binary, blocks long, epoch long", before)
        sizes = sorted(r.blocks for r in bloom.select("blocks").distinct().collect())  # powers of two
        out = df.withColumn("doubtful", F.lit(False))
        for n in sizes:
            # Filters of runs with equally many blocks are one filter.
            merged = bloom.where(F.col("blocks") == n).groupBy(F.col("block").alias("_block")).agg(F.bitmap_or_agg("bits").alias("_bits"))
            byte = lambda p: F.conv(F.hex(F.substring("_bits", F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            held = reduce(lambda a, b: a & b, (F.getbit(byte(p), (p % 8).cast("int")) == 1 for p in _places()))
            out = out.join(merged, _block(n) == F.col("_block"), "left").withColumn("doubtful", F.col("doubtful") | F.coalesce(held, F.lit(False))).drop("_block", "_bits")
        return out

    def unseen(self, batch: DataFrame, order: list[str], epoch: int) -> DataFrame:
        """The first row by order of each hash of batch(hash, ...) that no earlier epoch has; rows without hash are left out."""
        first = batch.where("hash IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy("hash").orderBy(*order))).where("_n = 1").drop("_n")
        judged = self.with_doubt(first, epoch)
        new = judged.where("NOT doubtful").drop("doubtful")
        return new.unionByName(judged.where("doubtful").drop("doubtful").join(self.hashes(epoch), "hash", "left_anti"))


def dedupe_stream(stream: DataFrame, index: SeenIndex, order: list[str], folder: str) -> None:
    """Writes the rows of stream(hash, ...) with a new hash to folder/out, batch by batch, and adds their hashes to the index."""

    def write(batch: DataFrame, epoch: int) -> None:
        out = f"{folder}/out/epoch={epoch}"
        index.unseen(batch, order, epoch).write.mode("overwrite").parquet(out)
        index.add(batch.sparkSession.read.schema(batch.schema).parquet(out), epoch)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
