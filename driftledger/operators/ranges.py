"""Chunk plans and half-open byte ranges ``[begin, stop)``.

Everything is a closed form or a window over one file's ranges; nothing loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from driftledger.functions.workers import dealt

from .ranks import placed


def _pieces(n: Column) -> Column:
    """Rows 0 to ``n`` - 1, none if ``n`` is 0."""
    return F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)))


def plan_chunks(files: DataFrame, chunk: int, connections: int) -> DataFrame:
    """Fixed chunks of each file; the last is short; streams take turns."""
    if chunk < 1 or not 1 <= connections <= 64:
        raise ValueError("chunk must be positive and connections 1 to 64")
    n = F.ceil(F.col("size") / chunk).cast("long")
    rows = files.select("file_id", "size", _pieces(n).alias("chunk_id"))
    return rows.select("file_id", "chunk_id", (F.col("chunk_id") * chunk).alias("begin"), F.least(F.lit(chunk).cast("long"), F.col("size") - F.col("chunk_id") * chunk).alias("length"), (F.col("chunk_id") % connections).alias("stream"))


def plan_ranges(files: DataFrame, chunk: int, channels: int, rtt: float, bandwidth: float, disk: float, least: int, overhead: int, striped_only: bool = True) -> DataFrame:
    """Adaptive ranges for files over the threshold; else none, or fixed chunks."""
    smallest = max(least, chunk)
    threshold = max(int(max(smallest * channels, bandwidth * rtt + overhead, disk * rtt + overhead)), smallest * channels)
    striped = (F.col("size") > threshold) & F.lit(channels > 1)
    target = F.greatest(F.lit(smallest).cast("long"), F.ceil(F.col("size") / (2 * channels)).cast("long"))
    rounded = (F.ceil(target / chunk) * chunk).cast("long")
    step = F.when(striped, rounded).otherwise(F.lit(chunk).cast("long"))
    rows = files.where(striped) if striped_only else files
    rows = rows.select("file_id", "size", striped.alias("striped"), step.alias("range_size")).withColumn("k", _pieces(F.ceil(F.col("size") / F.col("range_size")).cast("long")))
    at = F.col("k") * F.col("range_size")
    return rows.select("file_id", "striped", "range_size", (F.col("k") + 1).alias("range_id"), at.alias("begin"), F.least("range_size", F.col("size") - at).alias("length"), (F.col("k") % channels).alias("channel"))


def plan_work_items(files: DataFrame, least: int, most: int) -> DataFrame:
    """Dispatch items of files that are neither completed nor changed; a short tail joins the item before it."""
    rows = files.where(~F.col("status").isin("completed", "changed"))
    whole = F.ceil(F.col("size") / most).cast("long")
    tail = F.col("size") - (whole - 1) * most
    n = F.when(F.col("size") <= most, F.lit(1).cast("long")).otherwise(F.when(tail < least, whole - 1).otherwise(whole))
    rows = rows.select("file_id", "size", "status", n.alias("n")).withColumn("k", _pieces(F.col("n")))
    at = F.col("k") * most
    return rows.select("file_id", F.col("k").alias("item"), at.alias("begin"), F.when(F.col("k") == F.col("n") - 1, F.col("size") - at).otherwise(F.lit(most)).cast("long").alias("length"), (F.col("status") != "pending").cast("int").alias("retry"), (F.col("k") == 0).alias("dispatchable"))


def assign_round_robin(plan: DataFrame, workers: int) -> DataFrame:
    return plan.withColumn("worker", F.pmod(F.col("range_id") - 1, F.lit(workers)))


#: Keys that one task sums in a running total over keys that are numbers.
WIDTH = 4096


def totals_before(rows: DataFrame, key: str, value: str, before: str) -> DataFrame:
    """``rows`` (one for each whole-number ``key``) with ``before``: the sum of ``value`` of all smaller keys.

    Sums of ranges of ``WIDTH`` keys come first, so no task sees all rows: the
    one that orders the ranges has a row for each.
    """
    rows = rows.withColumn("__range", F.floor(F.col(key) / WIDTH))
    ranges = rows.groupBy("__range").agg(F.sum(value).alias("__sum"))
    ranges = ranges.select("__range", F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn(before, inside).join(ranges, "__range").withColumn(before, F.col(before) + F.col("__start")).drop("__range", "__start")


def interleave_weighted(items: DataFrame) -> DataFrame:
    """Fair order of a backlog: item k of a task of weight w goes in round floor((k - 1) / w).

    Items are numbered and rounds are put in order by ranges, so neither a task nor a
    round of very many items is in one task of Spark's.
    """
    numbered = placed(items.select("task_id", "item", F.greatest(F.col("weight"), F.lit(1)).alias("weight")), "task_id", ["item"]).withColumnRenamed("before", "k").drop("whole")
    rows = numbered.select("task_id", "item", F.floor(F.col("k") / F.col("weight")).cast("long").alias("round"))
    return placed(rows, None, ["round", "task_id", "item"]).select("task_id", "item", (F.col("before") + 1).cast("long").alias("dispatch_no"))


def validate(ranges: DataFrame, total: int) -> DataFrame:
    """Length positive and within the file; the comparison can't overflow."""
    return ranges.withColumn("is_valid", (F.col("length") > 0) & (F.col("length") <= total - F.col("begin")))


def _so_far() -> Column:
    return F.max("stop").over(Window.partitionBy("file_id").orderBy("begin", "stop").rowsBetween(Window.unboundedPreceding, -1))


def overlaps(ranges: DataFrame) -> DataFrame:
    """Ranges that begin before an earlier one of their file stops."""
    return ranges.withColumn("previous_stop", _so_far()).where(F.col("previous_stop") > F.col("begin")).select("file_id", "begin", "stop", "previous_stop")


def opening(ranges: DataFrame) -> DataFrame:
    """``ranges`` with ``past``, the furthest stop of those before, and ``new``: whether one neither overlaps nor touches those."""
    return dealt(ranges, "file_id").withColumn("past", _so_far()).withColumn("new", ~F.coalesce(F.col("past") >= F.col("begin"), F.lit(False)))


def coalesce(ranges: DataFrame) -> DataFrame:
    """Overlapping and adjacent ranges of a file merged to the least list.

    One order serves all steps: a merged range comes out at its last row, so no table of files or ranges is held.
    """
    by = Window.partitionBy("file_id").orderBy("begin", "stop")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    marked = opening(ranges).withColumn("after_null", F.lag("begin").over(by).isNull())
    # A range without a begin comes first and takes that of the next one that it reaches.
    begin = F.last(F.when(F.col("new") | F.col("after_null"), F.col("begin")), ignorenulls=True)
    islands = marked.select("file_id", "begin", "stop", F.sum(F.col("new").cast("int")).over(so_far).alias("island"), begin.over(so_far).alias("first"), F.coalesce(F.lead("new").over(by), F.lit(True)).alias("ends"))
    merged = islands.withColumn("last", F.max(F.struct("island", "stop")).over(so_far)["stop"]).where("ends")
    return merged.select("file_id", F.col("first").alias("begin"), F.col("last").alias("stop"))


def missing(ranges: DataFrame, totals: DataFrame) -> DataFrame:
    """The complement within ``[0, total)``, for files without a range as well."""
    merged = coalesce(ranges).join(totals, "file_id", "right").select("file_id", "total", F.coalesce("begin", "total").alias("begin"), F.coalesce("stop", "total").alias("stop"))
    by = Window.partitionBy("file_id").orderBy("begin")
    gaps = merged.select("file_id", F.lag("stop", 1, 0).over(by).alias("begin"), F.col("begin").alias("stop"))
    tails = merged.groupBy("file_id", "total").agg(F.max("stop").alias("begin")).select("file_id", "begin", F.col("total").alias("stop"))
    return gaps.unionByName(tails).where("begin < stop")


def coverage(ranges: DataFrame, totals: DataFrame) -> DataFrame:
    """Per file: out_of_bounds, duplicate, missing, empty or complete, and bytes covered.

    One pass: a range adds what lies beyond all ranges before it.
    """
    rows = ranges.withColumn("past", _so_far())
    added = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("begin"), F.coalesce("past", "begin")))
    again = F.coalesce(F.col("past") > F.col("begin"), F.lit(False))
    facts = rows.groupBy("file_id").agg(F.max("stop").alias("last"), F.min("begin").alias("first"), F.bool_or(again).alias("again"), F.sum(added).alias("done"))
    bytes_ = F.coalesce("done", F.lit(0))
    status = F.when((F.col("last") > F.col("total")) | (F.col("first") < 0), "out_of_bounds").when(F.col("again"), "duplicate").when(bytes_ < F.col("total"), "missing").when(F.col("total") == 0, "empty").otherwise("complete")
    return totals.join(facts, "file_id", "left").select("file_id", status.alias("status"), bytes_.alias("bytes_completed"))


def exact_cover(ranges: DataFrame, totals: DataFrame) -> DataFrame:
    """Whether a file's sorted ranges start at 0, abut and end at its size.

    Where ``ranges`` have a ``channel`` and ``totals`` the number ``expected`` of them, as many different ones must have brought them.
    """
    by = Window.partitionBy("file_id").orderBy("begin", "stop")
    abut = ranges.withColumn("ok", F.col("begin") == F.lag("stop", 1, 0).over(by))
    told = "channel" in ranges.columns
    facts = abut.groupBy("file_id").agg(F.bool_and("ok").alias("ok"), F.max("stop").alias("last"), F.count(F.lit(1)).alias("ranges"), *([F.count_distinct("channel").alias("channels")] if told else []))
    rows = totals.join(facts, "file_id", "left")
    exact = F.coalesce(F.col("ok") & (F.col("last") == F.col("total")), F.col("total") == 0)
    channels = F.coalesce("channels", F.lit(0)) if told else None
    if told and "expected" in totals.columns:
        exact &= channels == F.col("expected")
    return rows.select("file_id", exact.alias("is_exact"), F.coalesce("ranges", F.lit(0)).alias("ranges"), *([channels.alias("channels")] if told else []))


def id_runs(plan: DataFrame, verified: DataFrame, chunk: int) -> DataFrame:
    """Chunk ids that aren't verified, as runs with their byte spans."""
    lost = plan.join(verified.select("file_id", "chunk_id").distinct(), ["file_id", "chunk_id"], "left_anti")
    run = F.col("chunk_id") - F.row_number().over(Window.partitionBy("file_id").orderBy("chunk_id"))
    spans = lost.withColumn("run", run).groupBy("file_id", "run").agg(F.min("chunk_id").alias("first_id"), F.max("chunk_id").alias("last_id"), F.max("total").alias("total"))
    return spans.select("file_id", "first_id", "last_id", (F.col("first_id") * chunk).alias("begin"), F.least((F.col("last_id") + 1) * chunk, F.col("total")).alias("stop"))


def progress(totals: DataFrame, verified: DataFrame, chunk: int) -> DataFrame:
    done = verified.groupBy("file_id").agg(F.countDistinct("chunk_id").alias("verified"), F.sum("length").alias("bytes"))
    n = F.ceil(F.col("total") / chunk).cast("long")
    v = F.coalesce("verified", F.lit(0))
    rows = totals.join(done, "file_id", "left")
    return rows.select("file_id", F.when(v == n, "complete").otherwise("partial").alias("state"), n.alias("total_chunks"), v.alias("verified"), (n - v).alias("missing"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.round(F.when(n > 0, v / n).otherwise(1.0), 6).alias("ratio"))


def union_seconds(intervals: DataFrame, key: list[str]) -> DataFrame:
    """Measure of the union of each key's intervals, in microseconds; negative ones are counted apart."""
    file_id = F.struct(*key)
    good = intervals.where("stop >= begin").select(file_id.alias("file_id"), "begin", "stop")
    union = coalesce(good).groupBy("file_id").agg(F.sum(F.col("stop") - F.col("begin")).alias("union_us"))
    sums = intervals.groupBy(file_id.alias("file_id")).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.when(F.col("stop") >= F.col("begin"), F.col("stop") - F.col("begin")).otherwise(0)).alias("sum_us"), F.count_if(F.col("stop") < F.col("begin")).alias("invalid"))
    return sums.join(union, "file_id", "left").select(*(F.col(f"file_id.{k}").alias(k) for k in key), "calls", "sum_us", F.coalesce("union_us", F.lit(0)).alias("union_us"), "invalid")


def overlap_seconds(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Per key: time of ``left``, of ``right`` and of both at once, in microseconds.

    A sweep over the starts and stops of both sides: between two of them the open
    intervals of each side are known, however long an interval is.  Negative intervals count nothing.
    """
    steps = lambda rows, a, b: rows.where("stop >= begin").select(F.col(key).alias("key"), F.inline(F.array(F.struct(F.col("begin").alias("at"), F.lit(a).alias("a"), F.lit(b).alias("b")), F.struct(F.col("stop").alias("at"), F.lit(-a).alias("a"), F.lit(-b).alias("b")))))
    marks = steps(left, 1, 0).unionByName(steps(right, 0, 1)).groupBy("key", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    by = Window.partitionBy("key").orderBy("at")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    spans = marks.select("key", (F.sum("a").over(so_far) > 0).alias("a"), (F.sum("b").over(so_far) > 0).alias("b"), (F.lead("at", 1).over(by) - F.col("at")).alias("us"))
    time = lambda c, n: F.coalesce(F.sum(F.when(c, F.col("us"))), F.lit(0)).alias(n)
    return spans.groupBy(F.col("key").alias(key)).agg(time(F.col("a"), "wait_us"), time(F.col("b"), "hold_us"), time(F.col("a") & F.col("b"), "overlap_us"))
