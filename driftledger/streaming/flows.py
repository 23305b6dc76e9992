"""Streams over events and link states.

A batch of a stream is summed where it is read and its sums are written under the
batch's number, so a batch that runs again replaces itself.  Sums of batches merge by
key in any order, whatever the number of files: no state grows with the keys, and a
row that comes late counts where it belongs and is told as late.  The watermark is the
newest time read less a delay; windows and spans that it hasn't passed are still open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from driftledger.functions.workers import shared_folder

#: Ramp thresholds: fill below / from which a queue is low / high, pressure that is high,
#: low marks in a row that ramp up.  Fixed values.
LOW, HIGH, PRESSURE, LOW_HITS = 0.5, 2.0, 0.75, 2

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 16) -> DataFrame:
    """A table's files as a stream: those of its folder, or its one file."""
    path = f"{sf_dir}/{name}.parquet"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jvm_path).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path) if is_folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drained(rows: DataFrame, name: str, of_batch: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote, with the number of each ``batch``.

    ``of_batch`` sums a batch before it is written.
    """
    spark = rows.sparkSession
    base = shared_folder(spark, f"stream-{name}")
    schema: list[StructType] = []

    def put(batch: DataFrame, number: int) -> None:
        out = of_batch(batch) if of_batch else batch
        schema[:] = [out.schema]
        out.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    # State in RocksDB, so that it may be larger than memory; the session's own setting comes back once the query has taken it.
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        query = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)
    query.awaitTermination()
    return spark.read.schema(schema[0].add("batch", "long")).option("basePath", f"{base}/out").parquet(f"{base}/out")


def watermarks(sums: DataFrame, delay_us: int) -> DataFrame:
    """``batch``, ``watermark`` (null before the first) at its start and the ``last`` one of all, from ``newest`` of the sums."""
    newest = sums.groupBy("batch").agg(F.max("newest").alias("newest"))
    order = Window.orderBy("batch")  # a row a batch
    before = F.max("newest").over(order.rowsBetween(Window.unboundedPreceding, -1)) - delay_us
    last = F.max("newest").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - delay_us
    return newest.select("batch", before.alias("watermark"), last.alias("last"))


def event_counts(events: DataFrame, code: Column) -> DataFrame:
    """A batch's counts by error code."""
    return events.groupBy(code.alias("error_code")).agg(F.count(F.lit(1)).alias("count"))


def throughput(events: DataFrame, width: str, slide: str) -> DataFrame:
    """A batch's bytes by link, direction and sliding window."""
    rows = events.groupBy(F.window("ts", width, slide).alias("w"), "link", "direction").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("events"), F.max(F.unix_micros("ts")).alias("newest"))
    return rows.select(F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "link", "direction", "bytes", "events", "newest")


def closed_windows(sums: DataFrame, delay_us: int) -> DataFrame:
    """Bytes and rate of the windows that the watermark has passed, and how many events came after that."""
    rows = sums.join(F.broadcast(watermarks(sums, delay_us)), "batch").where(F.col("end_us") <= F.col("last"))
    late = F.coalesce(F.sum(F.when(F.col("end_us") <= F.col("watermark"), F.col("events"))), F.lit(0))
    rows = rows.groupBy("start_us", "end_us", "link", "direction").agg(F.sum("bytes").alias("bytes"), late.alias("late_events"))
    return rows.select("start_us", "link", "direction", "bytes", F.round(F.col("bytes") * 8 / (F.col("end_us") - F.col("start_us")) / 1000, 9).alias("gbps"), "late_events")


def spans(events: DataFrame, key: str, gap: str) -> DataFrame:
    """A batch's spans of each key without a pause of ``gap``, with their bytes and last state."""
    last = F.struct("ts", "event_id", "state")
    rows = events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events"), F.sum("bytes").alias("bytes"), F.max(last).alias("last"), F.max(F.unix_micros("ts")).alias("newest"))
    return rows.select(key, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "events", "bytes", "last", "newest")


def merged_spans(sums: DataFrame, key: str, delay_us: int) -> DataFrame:
    """Spans of all batches that the watermark has passed, those that touch merged; ``late_events`` came after it."""
    rows = sums.join(F.broadcast(watermarks(sums, delay_us)).withColumnRenamed("last", "closed"), "batch")
    order = Window.partitionBy(key).orderBy("start_us", "end_us")
    so_far = F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(so_far >= F.col("start_us"), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    late = F.coalesce(F.sum(F.when(F.col("end_us") <= F.col("watermark"), F.col("events"))), F.lit(0))
    whole = rows.groupBy(key, "island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("events").alias("events"), F.sum("bytes").alias("bytes"), F.max("last").alias("last"), late.alias("late_events"), F.max("closed").alias("closed"))
    return whole.where("end_us <= closed").select(key, "start_us", "end_us", "events", "bytes", F.col("last.state").alias("state"), "late_events")


def ramp_alerts(observations: DataFrame) -> DataFrame:
    """What each recorded link state calls for: ``down``, ``up`` or ``hold``, with the first reason that holds.

    A high mark, pressure or a new retry calls for less; each second low mark in a row for more.
    """
    by = Window.partitionBy("link_id").orderBy("ts", "event_id")
    high, pressed = F.col("fill") >= HIGH, F.col("pressure") >= PRESSURE
    again = F.col("retries") > F.lag("retries", 1, 0).over(by)
    down = F.when(high, "high_watermark").when(pressed, "send_pressure").when(again, "retry_pressure")
    rows = observations.withColumn("reason", down).withColumn("low", F.col("reason").isNull() & (F.col("fill") < LOW))
    # Low marks in a row: numbered since the last row that isn't one.
    run = F.sum(F.when(F.col("low"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("run", run)
    hits = F.sum(F.col("low").cast("int")).over(Window.partitionBy("link_id", "run").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    up = F.col("low") & (hits % LOW_HITS == 0)
    return rows.select("link_id", "event_id", F.when(F.col("reason").isNotNull(), "down").when(up, "up").otherwise("hold").alias("action"), F.coalesce("reason", F.when(up, "low_watermark"), F.lit("balanced")).alias("reason"))
