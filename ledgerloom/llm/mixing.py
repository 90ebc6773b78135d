"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

The rates of all documents are those nearest to "every document once" in
relative entropy, under a token constraint per source and at most MAX_COPIES
for a document. The convex dual has one multiplier per source; its solution is
the exponential tilt rate = min(MAX_COPIES, exp(lambda * size / mean size)).
Newton iterations (on the logarithm of the constraint, kept within a bracket)
solve it: each is one distributed aggregation over cells, the documents of one
source and size, which are sufficient statistics. Sums are taken in decimals
and rates are whole multiples of 2^-20, so that reruns agree to the last copy.

Rates become copies by systematic rounding along falling sizes: the running sum
of rates within a source is rounded, and a document takes the difference. A
source's words then miss its target by about a document at most. Of PHASES
places to start the rounding, each source takes the one that misses least.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, unused

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
UNIT = 1 << 20
TOLERANCE, RESOLUTION = 1e-10, 1e-9
MAX_ROUNDS = 60
#: Documents of one cell are numbered in so many parts.
PARTS = 256
PHASES = 32
WORD = r"[^\x20\x09-\x0D]+"


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key): words of each text, 0 for null; key names the source, null too."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """(key, source_size, target): all sizes shared by weight, capped at MAX_COPIES times the source, the excess reshared.

    Sources come by code point with null last and take the weights in turn. The
    windows here run over one row per source.
    """
    s = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    s = s.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", MAX_COPIES * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("level", "place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumn("left_words", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_level), F.lit(0)))
    s = s.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_level), F.lit(0)))
    s = s.withColumn("share", F.col("left_words") / F.col("left_weight"))
    s = s.withColumn("share", F.min(F.when(F.col("level") >= F.col("share"), F.struct("level", "place", "share"))).over(every)["share"])
    return s.select("key", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("share"), F.lit(0.0)) * F.col("weight")).alias("target"))


def _exact(x):
    return F.sum(x.cast("decimal(38,9)")).cast("double")


def tilts(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, mean, tilt): the multiplier of each source with words; cells(key, size, n), size above 0."""
    means = cells.groupBy("key").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    state = cut(targets.where("target > 0").join(means, "key").select("key", "mean", "target", "source_size", F.lit(0.0).alias("tilt"), F.lit(-1e7).alias("lo"), F.lit(1e7).alias("hi"), F.lit(1.0).alias("miss")))
    x = F.col("size") / F.col("mean")
    rate = F.least(F.lit(float(MAX_COPIES)), F.exp(F.least(F.col("tilt") * x, F.lit(10.0))))
    for _ in range(MAX_ROUNDS):
        words = F.col("n") * F.col("size")
        sums = cells.join(state.select("key", "mean", "tilt"), "key").groupBy("key").agg(_exact(words * rate).alias("got"), _exact(F.when(rate < MAX_COPIES, words * x * rate).otherwise(F.lit(0.0))).alias("slope"), F.count(F.lit(1)).alias("cells"))
        s = state.join(sums, "key")
        over = F.col("got") > F.col("target")
        s = s.withColumn("miss", F.abs(F.col("got") / F.col("target") - 1))
        s = s.withColumn("lo", F.when(over, F.col("lo")).otherwise(F.col("tilt"))).withColumn("hi", F.when(over, F.col("tilt")).otherwise(F.col("hi")))
        step = F.col("tilt") - F.log(F.col("got") / F.col("target")) * F.try_divide(F.col("got"), F.col("slope"))
        inside = (step > F.col("lo")) & (step < F.col("hi"))
        far = F.when(over, F.least(F.col("tilt") - 1, 2 * F.col("tilt"))).otherwise(F.greatest(F.col("tilt") + 1, 2 * F.col("tilt")))
        other = F.when(F.col("hi") - F.col("lo") > 1e6, F.least(F.greatest(far, F.col("lo")), F.col("hi"))).otherwise((F.col("lo") + F.col("hi")) / 2)
        # Each cell's words are rounded to 1e-9, so a sum can't come nearer to its target than that; nor can a tilt between neighbouring doubles.
        near = F.abs(F.col("got") - F.col("target")) <= F.greatest(TOLERANCE * F.col("target"), RESOLUTION * F.col("cells"))
        narrow = F.col("hi") - F.col("lo") <= 4e-16 * F.greatest(F.lit(1.0), F.abs("tilt"))
        done = near | narrow | (F.col("target") >= MAX_COPIES * F.col("source_size"))
        state = cut(s.select("key", "mean", "target", "source_size", F.when(done, F.col("tilt")).otherwise(F.when(inside, step).otherwise(other)).alias("tilt"), "lo", "hi", F.when(done, F.lit(0.0)).otherwise(F.col("miss")).alias("miss")))
        if not state.where("miss > 0").limit(1).count():
            break
    else:
        raise RuntimeError(f"the tilts have not settled in {MAX_ROUNDS} rounds")
    return state.select("key", "mean", "target", "source_size", F.round("tilt", 9).alias("tilt"))


def mixture(docs: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken), a row per row of docs(doc_id, text, source).

    Null and empty texts have size 0 and are never taken. A null source is a
    source of its own, the last. Repeated rows are counted and rounded each for
    itself. An empty table gives an empty result. Other columns are ignored.
    """
    sizes = cut(document_sizes(docs))
    targets = cut(source_targets(sizes, weights))
    cells = cut(sizes.where("size > 0").groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")))
    solved = tilts(cells, targets)
    full = F.col("target") >= MAX_COPIES * F.col("source_size")
    tilted = F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(10.0)))
    units = F.when(full, F.lit(MAX_COPIES * UNIT)).otherwise(F.round(F.least(F.lit(float(MAX_COPIES)), tilted) * UNIT)).cast("long")
    rated = cells.join(solved, "key").select("key", "size", "n", units.alias("units"))
    falling = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    rated = rated.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("units")).over(falling), F.lit(0)))

    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part")
    numbered = sizes.where("size > 0").select("*", part)
    parts = numbered.groupBy("key", "size", "part").agg(F.count(F.lit(1)).alias("m"))
    parts = parts.withColumn("skip", F.coalesce(F.sum("m").over(Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")
    numbered = numbered.withColumn("k", F.row_number().over(Window.partitionBy("key", "size", "part").orderBy(F.xxhash64("doc_id"), "doc_id")))
    placed = numbered.join(parts, ["key", "size", "part"]).join(rated, ["key", "size"])
    place = F.col("skip") + F.col("k")
    placed = cut(placed.select("doc_id", "size", "key", (F.col("before") + (place - 1) * F.col("units")).alias("low"), (F.col("before") + place * F.col("units")).alias("high")))

    def copies(phase):
        return F.shiftright(F.col("high") + phase, 20) - F.shiftright(F.col("low") + phase, 20)

    phases = [(2 * j + 1) * UNIT // (2 * PHASES) for j in range(PHASES)]
    totals = placed.groupBy("key").agg(*(F.sum(F.col("size") * copies(F.lit(u))).alias(f"t{u}") for u in phases)).join(targets, "key")
    best = totals.select("key", F.array_min(F.array(*(F.struct(F.abs(F.col(f"t{u}") - F.col("target")).alias("miss"), F.lit(u).alias("phase")) for u in phases)))["phase"].alias("phase"))
    taken = placed.join(best, "key").select("doc_id", "size", "key", copies(F.col("phase")).cast("long").alias("copies"))
    none = sizes.where("size = 0").select("doc_id", "size", "key", F.lit(0).cast("long").alias("copies"))
    return taken.unionByName(none).join(targets, "key").select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take_mixture(docs: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """docs with every row as often as the mixture takes it, columns kept.

    Rows that share a doc_id (or have none) share the copies of all of them,
    rounded up to an equal number for each.
    """
    copies, of = unused(docs, "copies"), unused(docs, "copies_of")
    shares = mixture(docs, weights).groupBy("doc_id").agg(F.ceil(F.sum("copies") / F.count(F.lit(1))).cast("int").alias(copies)).where(F.col(copies) > 0)
    joined = docs.join(shares.withColumnRenamed("doc_id", of), F.col("doc_id").eqNullSafe(F.col(of)))
    return joined.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document; null texts have size 0, a null source is the last one."""
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
