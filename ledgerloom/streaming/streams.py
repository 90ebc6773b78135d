"""Structured Streaming jobs over an events stream (event_id, ts, user_id, event_type, value, props)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import work_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def tumbling_metrics(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.avg((F.col("event_type") == "error").cast("double")).alias("error_rate")).select(F.col("window.start").alias("start"), "event_type", "n", "mean", "error_rate")


def sliding_cost(events: DataFrame, budget: float, width: str = "1 hour", step: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.sum("value").alias("cost"))
    return w.select(F.col("window.start").alias("start"), "cost", (F.col("cost") <= budget).alias("within"))


def learned_patterns(events: DataFrame) -> DataFrame:
    """Per key the corrections so far, their boost and the first price; for update mode."""
    c = events.where("event_type = 'error'").withColumn("account", F.get_json_object("props", "$.k"))
    return c.groupBy("user_id", "account").agg(F.count(F.lit(1)).alias("n"), F.least(F.lit(0.3), 0.05 * F.count(F.lit(1))).alias("boost"), F.min_by("value", F.struct("ts", "event_id")).alias("first_price"))


def success_alerts(events: DataFrame, least: float, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.avg((F.col("event_type") != "error").cast("double")).alias("rate"))
    return w.where(F.col("rate") < least).select(F.col("window.start").alias("start"), "rate")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select(F.col("session_window.start").alias("start"), "user_id", "n")


#: Waves of files in which the registered queries' events arrive.
WAVES = 3


def time_waves(df: DataFrame, ts: str = "ts", n: int = WAVES) -> DataFrame:
    """df with wave, 0 to n - 1: equal stretches of the time from the first to the last row."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    bounds = df.agg(F.min(us).alias("_lo"), F.max(us).alias("_hi"))
    return df.join(F.broadcast(bounds), how="cross").withColumn("wave", F.expr(f"CAST(({n} * (unix_micros(CAST({ts} AS timestamp)) - _lo)) div (_hi - _lo + 1) AS int)")).drop("_lo", "_hi")


def through_restarts(waves: DataFrame, make: Callable[[DataFrame], DataFrame], mode: str = "append", n: int = WAVES, sink: Callable[[DataFrame, str], None] | None = None) -> DataFrame | str:
    """What a stream writes whose files arrive in waves, stopped after each wave and started again from its log.

    waves has a column wave, 0 to n - 1; make turns the stream of the other
    columns into the job. Instead of writing rows, sink(stream, folder) can run
    the job itself up to the end of what is there; the folder is returned then.
    """
    spark = waves.sparkSession
    folder = work_folder(spark)
    for k in range(n):
        waves.where(F.col("wave") == k).drop("wave").write.mode("append").parquet(f"{folder}/in")
        stream = make(spark.readStream.schema(waves.drop("wave").schema).parquet(f"{folder}/in"))
        if sink:
            sink(stream, folder)
        else:
            _run(stream, folder, mode)
    return folder if sink else _written(spark, folder, stream, mode)


def _run(stream: DataFrame, folder: str, mode: str) -> None:
    out = stream.writeStream.option("checkpointLocation", f"{folder}/log").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        out.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    else:

        def write(batch: DataFrame, epoch: int) -> None:
            batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

        out.foreachBatch(write).start().awaitTermination()


def _written(spark: SparkSession, folder: str, stream: DataFrame, mode: str) -> DataFrame:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    schema = stream.schema if mode == "append" else stream.schema.add("_epoch", "integer")
    return spark.read.schema(schema).parquet(f"{folder}/out") if there else spark.createDataFrame([], schema)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote."""
    folder = work_folder(stream.sparkSession)
    _run(stream, folder, mode)
    return _written(stream.sparkSession, folder, stream, mode)


def latest(written: DataFrame, keys: list[str]) -> DataFrame:
    """Of what a job in update mode wrote, the last row of each key."""
    rest = [c for c in written.columns if c not in (*keys, "_epoch", "epoch")]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_epoch").alias("_r")).select(*keys, "_r.*")


def tumbling_partials(stream: DataFrame, folder: str, width_s: int = 3_600, late_s: int = 3_600) -> None:
    """Sums per window and event type of each batch, and apart from them the rows that came too late.

    A row is late if its window's end is no later than the newest time of all
    earlier batches less late_s. Every batch writes sums/epoch=k, late/epoch=k
    and, at last, its newest time as marks/epoch=k; given again it writes the
    same, as it reads earlier marks only.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        newest = None
        if epoch:
            newest = spark.read.schema("newest timestamp, epoch long").parquet(f"{folder}/marks").where(F.col("epoch") < epoch).agg(F.max("newest")).first()[0]
        start = F.window("ts", f"{width_s} seconds")["start"]
        rows = batch.withColumn("start", start)
        ends = F.unix_micros("start") + width_s * 1_000_000
        rows = rows.withColumn("late", F.lit(False) if newest is None else ends <= F.unix_micros(F.lit(newest)) - late_s * 1_000_000)
        rows.where("late").drop("late", "start").write.mode("overwrite").parquet(f"{folder}/late/epoch={epoch}")
        sums = rows.where("NOT late").groupBy("start", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"))
        sums.write.mode("overwrite").parquet(f"{folder}/sums/epoch={epoch}")
        batch.agg(F.max("ts").alias("newest")).write.mode("overwrite").parquet(f"{folder}/marks/epoch={epoch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()


def merged_partials(spark: SparkSession, folder: str) -> DataFrame:
    """(start, event_type, n, mean, error_rate) of all batches' sums."""
    p = spark.read.schema("start timestamp, event_type string, n long, total double, errors long").parquet(f"{folder}/sums")
    return p.groupBy("start", "event_type").agg(F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("n")).alias("mean"), (F.sum("errors") / F.sum("n")).alias("error_rate"))
