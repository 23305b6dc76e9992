"""Summaries, baselines, counters and gates over benchmark and event records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from driftledger.functions.workers import stored

from .ranks import quantiles, with_quantiles

#: The median, and how it is named.
MIDDLE = {"median": ("linear", 0.5)}


def median(column: str | Column) -> Column:
    return F.percentile(column, F.lit(0.5))


def summary(runs: DataFrame, keys: list[str], spread_limit: float = 20.0) -> DataFrame:
    """Counts, goodput statistics and verdict of each group; blank goodput isn't measured.

    The spread is (max - min) / median in percent.  Failures come before a group that is
    blocked as a whole, then instability, passes and partly blocked groups.
    """
    n, is_ = F.count(F.lit(1)), lambda p: F.count_if(F.col("result").startswith(p))
    first = F.min_by("result", F.struct("repeat_index", "line"))
    rows = runs.groupBy(*keys).agg(n.alias("repeats"), is_("pass").alias("passes"), is_("blocked").alias("blocked"), is_("fail").alias("fails"), F.min("goodput").alias("min_goodput"), F.max("goodput").alias("max_goodput"), first.alias("first"))
    rows = with_quantiles(rows, runs, keys, {"goodput": F.col("goodput")}, MIDDLE).withColumn("median_goodput", F.round("goodput_median", 6)).drop("goodput_median")
    spread = F.when(F.col("median_goodput") > 0, F.round((F.col("max_goodput") - F.col("min_goodput")) / F.col("median_goodput") * 100, 3)).otherwise(0.0)
    rows = rows.withColumn("spread_pct", spread).withColumn("unstable", F.coalesce(F.col("spread_pct") > spread_limit, F.lit(False)))
    verdict = F.when(F.col("fails") > 0, "fail_runtime").when((F.col("blocked") > 0) & (F.col("blocked") == F.col("repeats")), F.col("first")).when(F.col("unstable"), "inconclusive_unstable").when(F.col("passes") == F.col("repeats"), "pass").when(F.col("blocked") > 0, "partial_blocked").otherwise(F.col("first"))
    return rows.withColumn("result", verdict).drop("first")


def passing_summary(runs: DataFrame, keys: list[str], stages: list[str]) -> DataFrame:
    """Statistics of passing rows only: throughput, elapsed time and the median of each stage; groups without one have nulls."""
    good = lambda c: F.when(F.col("result") == "pass", F.col(c))
    ok = good("goodput")
    n = F.count_if(F.col("result") == "pass")
    rows = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("repeats"), n.alias("passes"), (F.count(F.lit(1)) - n).alias("fails"), F.min(ok).alias("goodput_min"), F.max(ok).alias("goodput_max"))
    return _rounded(with_quantiles(rows, runs, keys, {c: good(c) for c in ("goodput", "elapsed", *stages)}, MIDDLE))


def describe(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, sum, median, linear and nearest-rank 95th percentile, maximum."""
    sums = rows.groupBy(*keys).agg(F.count(value).alias("count"), F.round(F.sum(value), 4).alias("sum"), F.max(value).alias("max"))
    found = with_quantiles(sums, rows, keys, {"v": F.col(value)}, {"p50": ("linear", 0.5), "p95": ("linear", 0.95), "p95_rank": ("disc", 0.95)})
    return found.select(*keys, "count", "sum", F.round("v_p50", 6).alias("p50"), F.round("v_p95", 6).alias("p95"), F.col("v_p95_rank").alias("p95_rank"), "max")


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys`` and the ``median`` of each group, to six places."""
    return quantiles(rows, keys, {"v": F.col(value)}, MIDDLE).select(*keys, F.round("v_median", 6).alias("median"))


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.round(c, 6).alias(c) if c.endswith("_median") else c for c in rows.columns))


def stage_share(runs: DataFrame, keys: list[str], stages: list[str]) -> DataFrame:
    """Each stage's share of the measured time of its group, and the dominant one."""
    sums = runs.groupBy(*keys).agg(*(F.sum(s).alias(s) for s in stages))
    long = sums.unpivot(keys, stages, "stage", "seconds")
    by = Window.partitionBy(*keys)
    best = F.first("stage").over(by.orderBy(F.desc("seconds"), "stage"))
    total = F.sum("seconds").over(by)
    return long.select(*keys, "stage", F.round("seconds", 4).alias("seconds"), F.round(F.when(total > 0, F.col("seconds") / total).otherwise(0.0), 6).alias("share"), (F.col("stage") == best).alias("is_dominant"))


def baseline_delta(medians: DataFrame, key: str, config: str, baseline: str) -> DataFrame:
    """Each configuration's change against the baseline of its key, null if that isn't positive."""
    base = medians.where(F.col(config) == baseline).select(key, F.col("median").alias("baseline"))
    delta = F.when(F.col("baseline") > 0, F.round((F.col("median") - F.col("baseline")) / F.col("baseline") * 100, 6))
    return medians.join(base, key, "left").select(key, config, "median", "baseline", delta.alias("delta_pct"))


def mode_compare(medians: DataFrame, key: list[str], config: str, left: str, right: str) -> DataFrame:
    """Two configurations side by side; keys that lack one are dropped."""
    wide = medians.groupBy(*key).pivot(config, [left, right]).agg(F.first("median")).where(F.col(left).isNotNull() & F.col(right).isNotNull())
    return wide.select(*key, F.col(left).alias("left_median"), F.col(right).alias("right_median"), F.round(F.col(right) - F.col(left), 6).alias("delta"))


def mode_deltas(runs: DataFrame, key: list[str], mode: str, off: str, others: list[str], values: list[str]) -> DataFrame:
    """Medians of ``values`` of each mode beside those of ``off``, and their differences; keys without ``off`` or any other are dropped."""
    wide = runs.groupBy(*key).pivot(mode, [off, *others]).agg(*(F.round(median(v), 6).alias(v) for v in values), F.count(F.lit(1)).alias("n"))
    some = F.coalesce(*(F.col(f"{o}_{values[0]}") for o in others)).isNotNull()
    deltas = [F.round(F.col(f"{o}_{v}") - F.col(f"{off}_{v}"), 6).alias(f"{o}_{v}_delta") for o in others for v in values]
    return wide.where(F.col(f"{off}_{values[0]}").isNotNull() & some).select(*key, *(f"{m}_{v}" for m in (off, *others) for v in values), *deltas)


def sched_counts(events: DataFrame, summaries: DataFrame, kinds: list[str]) -> DataFrame:
    """Events of each run by kind; a summary's count is taken unless it is 0 or missing."""
    counted = events.where(F.col("event").isin(*kinds)).groupBy("run").agg(*(F.count_if(F.col("event") == k).alias(k) for k in kinds))
    told = summaries.groupBy("run").agg(*(F.max(k).alias(f"told_{k}") for k in kinds))
    return counted.join(told, "run", "full").select("run", *(F.coalesce(F.nullif(F.col(f"told_{k}"), F.lit(0)), F.col(k), F.lit(0)).cast("long").alias(k) for k in kinds))


def run_ratios(medians: DataFrame, older: DataFrame, key: str, config: str, left: str, right: str) -> DataFrame:
    """Ratio of two systems' medians of each key, and of the second one's to an older run's; keys that lack one are dropped."""
    now = mode_compare(medians, [key], config, left, right)
    was = older.where(F.col(config) == right).select(key, F.col("median").alias("older"))
    return now.join(was, key).select(key, F.round(F.col("right_median") / F.col("left_median"), 6).alias("ratio"), F.round(F.col("right_median") / F.col("older"), 6).alias("older_ratio"))


def paired_gate(runs: DataFrame, experiment: str, pair: str, arm: str, arms: tuple[str, str], value: str, size_bytes: int, parts: tuple[str, ...] = (), wall: str | None = None, seq: str | None = None) -> DataFrame:
    """All experiments at once: medians, rates, variation and paired improvement of two arms in ``value`` seconds.

    Improvement is (a - b) / a in percent; variation is the population deviation
    over the mean, also of ``wall`` if it is named.  Preconditions are columns:
    ``reps_ok`` (pairs numbered from 1, both arms in each), ``content_ok`` (one
    ``digest`` in all rows), ``errors`` (their sum), ``parts_ok`` (``parts`` sum to the value)
    and, if ``seq`` orders the runs, ``order_ok``: the first arm leads in odd pairs, the second in even ones.
    """
    a, b = arms
    whole = F.lit(True)
    for i, name in enumerate(parts):
        whole = F.abs(sum((F.col(c) for c in parts[1:]), F.col(parts[0])) - F.col(value)) <= 1e-6 if i == 0 else whole
    facts = [F.first(value).alias("v"), F.first(wall or value).alias("w"), F.sum("errors").alias("e"), F.min("digest").alias("least"), F.max("digest").alias("most"), F.bool_and(whole).alias("p"), *([F.first(seq).alias("s")] if seq else [])]
    wide = runs.groupBy(experiment, pair).pivot(arm, [a, b]).agg(*facts)
    side = lambda n, x: F.col(f"{x}_{n}")
    both = side("v", a).isNotNull() & side("v", b).isNotNull()
    wide = wide.select(experiment, pair, side("v", a).alias("a"), side("v", b).alias("b"), side("w", a).alias("aw"), side("w", b).alias("bw"), both.alias("both"), (F.coalesce(side("e", a), F.lit(0)) + F.coalesce(side("e", b), F.lit(0))).alias("e"), F.least(side("least", a), side("least", b)).alias("least"), F.greatest(side("most", a), side("most", b)).alias("most"), (F.coalesce(side("p", a), F.lit(True)) & F.coalesce(side("p", b), F.lit(True))).alias("p"), *([F.coalesce((side("s", a) < side("s", b)) == (F.col(pair) % 2 == 1), F.lit(False)).alias("led")] if seq else []))
    wide = wide.withColumn("gain", (F.col("a") - F.col("b")) / F.col("a") * 100)
    rate = lambda c: F.round(F.lit(size_bytes * 8.0) / median(c) / 1e9, 6)
    vary = lambda c: F.round(F.stddev_pop(c) / F.avg(c), 6)
    n = F.count(F.lit(1))
    reps = F.bool_and("both") & (F.min(pair) == 1) & (F.max(pair) == n)
    walls = [vary("aw").alias("a_wall_cv"), vary("bw").alias("b_wall_cv")] if wall else []
    return wide.groupBy(experiment).agg(n.alias("pairs"), F.round(median("a"), 6).alias("a_median"), F.round(median("b"), 6).alias("b_median"), rate("a").alias("a_gbps"), rate("b").alias("b_gbps"), vary("a").alias("a_cv"), vary("b").alias("b_cv"), *walls, F.count_if(F.col("gain") > 0).alias("improved_pairs"), F.round(median("gain"), 6).alias("gain_pct"), F.round(F.percentile("a", F.lit(0.95)), 6).alias("a_p95"), F.round(F.percentile("b", F.lit(0.95)), 6).alias("b_p95"), reps.alias("reps_ok"), (F.min("least") == F.max("most")).alias("content_ok"), F.sum("e").alias("errors"), F.bool_and("p").alias("parts_ok"), *([F.bool_and("led").alias("order_ok")] if seq else []))


def gate(report: DataFrame, rule: str, least_pairs: int) -> DataFrame:
    """A verdict for each experiment of a report; one that breaks a precondition is invalid, with the first as ``reason``."""
    reason = F.when(F.col("pairs") < least_pairs, "pairs").when(~F.col("reps_ok"), "reps").when(~F.col("content_ok"), "content").when(~F.col("parts_ok"), "parts")
    if "order_ok" in report.columns:
        reason = F.when(~F.col("order_ok"), "order").otherwise(reason)
    verdict = F.when(reason.isNotNull(), "invalid").when(F.expr(rule), "go").otherwise("no_go")
    return report.select("*", reason.isNull().alias("valid"), reason.alias("reason"), verdict.alias("verdict"))


#: Width of a time range whose rows are ordered in one task, microseconds: a day.
SPAN = 86_400_000_000


def counter_delta(counters: DataFrame, gauges: str = "") -> DataFrame:
    """Change of each counter since its last snapshot; a fall is a regression, and so is a counter that is missing.

    Snapshots of a host are the times at which it has any counter.  A counter that is in
    one and not in the next is missing there, with no ``delta``, whether it comes back or not.  Names that match ``gauges`` may fall
    and are left out.  Rows are ordered in ranges of time; each range's first and last row
    take what the ranges beside it end with, so a counter of very many rows is split.
    """
    rows = counters.where(~F.col("name").rlike(gauges)) if gauges else counters
    rows = rows.select("host", "name", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "value")
    rows = rows.withColumn("span", F.expr(f"ts div {SPAN}"))
    following = _beside(rows.select("host", "ts", "span").distinct(), ["host"], "ts", 1).select("host", "ts", F.col("beside").alias("following"))
    known = _beside(_beside(rows, ["host", "name"], "value", -1).withColumnRenamed("beside", "before"), ["host", "name"], "ts", 1)
    known = known.join(following, ["host", "ts"])
    found = known.where("before IS NOT NULL").select("host", "name", "ts", (F.col("value") - F.col("before")).alias("delta"), (F.col("value") < F.col("before")).alias("regressed"))
    gone = known.where("following IS NOT NULL AND (beside IS NULL OR beside > following)").select("host", "name", F.col("following").alias("ts"), F.lit(None).cast("long").alias("delta"), F.lit(True).alias("regressed"))
    return found.unionByName(gone)


def _beside(rows: DataFrame, key: list[str], value: str, step: int) -> DataFrame:
    """``rows`` with ``beside``: the value of the row before (-1) or after (1) in the key's order of time, across ranges ``span``."""
    edge = (F.max_by if step < 0 else F.min_by)(value, "ts").alias("edge")
    spans = Window.partitionBy(*key).orderBy("span")
    carried = rows.groupBy(*key, "span").agg(edge).withColumn("carried", (F.lag if step < 0 else F.lead)("edge").over(spans)).drop("edge")
    inside = (F.lag if step < 0 else F.lead)(value).over(Window.partitionBy(*key, "span").orderBy("ts"))
    return rows.withColumn("inside", inside).join(carried, [*key, "span"]).withColumn("beside", F.coalesce("inside", "carried")).drop("inside", "carried")


def append_watermark(acks: DataFrame) -> DataFrame:
    """Whether each acknowledgement is a monotone append, and the next chunk id."""
    past = Window.partitionBy("file_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = acks.select("file_id", "seq", "begin", "chunk_id", F.max("begin").over(past).alias("max_offset"), F.max("chunk_id").over(past).alias("max_chunk_id"))
    fast = F.coalesce((F.col("begin") > F.col("max_offset")) & (F.col("chunk_id") > F.col("max_chunk_id")), F.lit(True))
    return rows.select("file_id", "seq", "max_offset", "max_chunk_id", fast.alias("fast_path"), (F.greatest(F.coalesce("max_chunk_id", F.lit(-1)), F.col("chunk_id")) + 1).alias("next_id"))


#: Legal steps of a lease.  Fixed values.
LEASE_STEPS = [("claimed", "in_flight"), ("in_flight", "commit_pending"), ("commit_pending", "completed"), ("reclaimable", "claimed"), *((s, "reclaimable") for s in ("claimed", "in_flight", "commit_pending"))]


def lease_transitions(events: DataFrame) -> DataFrame:
    """Each step of a lease and whether it is legal; the first state has none before it.

    Where ``events`` have ``io``, the bytes of IO that a row starts (above 0) or finishes (below 0), nothing may be in
    flight when a lease waits for its result, completes or is claimed anew: IO is summed from each claim on,
    and a balance other than 0, or one that was negative, is illegal.
    """
    before = F.lag("state").over(Window.partitionBy("lease_id").orderBy("ts", "event_id"))
    legal = F.struct(F.col("from"), F.col("to")).isin(*(F.struct(F.lit(a).alias("from"), F.lit(b).alias("to")) for a, b in LEASE_STEPS))
    if "io" not in events.columns:
        return events.select("lease_id", "event_id", before.alias("from"), F.col("state").alias("to")).where(F.col("from").isNotNull()).withColumn("legal", legal)
    by = Window.partitionBy("lease_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    # Steps are the rows with a state; the others are IO within the state before.
    rows = events.withColumn("steps", F.count("state").over(by)).withColumn("attempt", F.count_if(F.col("state") == "claimed").over(by))
    flight = Window.partitionBy("lease_id", "attempt").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("balance", F.sum(F.coalesce("io", F.lit(0))).over(flight))
    rows = rows.withColumn("least", F.min("balance").over(flight))
    told = rows.where("state IS NOT NULL").withColumn("from", before)
    # A claim begins another sum, so what the attempt before left is the balance of the row before.
    left = rows.groupBy("lease_id", "attempt").agg(F.max_by("balance", F.struct("ts", "event_id")).alias("left")).withColumn("attempt", F.col("attempt") + 1)
    told = told.join(left, ["lease_id", "attempt"], "left").where(F.col("from").isNotNull())
    undrained = F.when(F.col("state") == "claimed", F.coalesce("left", F.lit(0)) != 0).when(F.col("state").isin("commit_pending", "completed"), (F.col("balance") != 0) | (F.col("least") < 0)).otherwise(False)
    return told.select("lease_id", "event_id", "from", F.col("state").alias("to"), "balance", undrained.alias("undrained")).withColumn("legal", legal & ~F.col("undrained"))


def queue_wait(events: DataFrame) -> DataFrame:
    """Microseconds from each lease's first claim to its first flight after it, described over all leases."""
    start = events.where("state = 'claimed'").groupBy("lease_id").agg(F.min("ts").alias("start"))
    waits = events.where("state = 'in_flight'").join(start, "lease_id").where("ts >= start").groupBy("lease_id").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))).alias("us"))
    waits = stored(waits, "waits")
    found = quantiles(waits, [], {"us": F.col("us")}, {"p50": ("linear", 0.5), "p95": ("linear", 0.95)})
    told = waits.agg(F.count(F.lit(1)).alias("leases"), F.max("us").alias("max_us")).join(F.broadcast(found), how="left")  # a row each
    return told.select("leases", F.round("us_p50", 3).alias("p50_us"), F.round("us_p95", 3).alias("p95_us"), "max_us")


def event_summary(events: DataFrame, code: Column) -> DataFrame:
    """Events by error code, with the first of each in sequence."""
    return events.withColumn("error_code", code).groupBy("error_code").agg(F.count(F.lit(1)).alias("events"), F.min("sequence").alias("first_sequence"), F.min_by("message", "sequence").alias("first_message"))


def profile(files: DataFrame) -> DataFrame:
    """Counts and true size quantiles of each dataset."""
    return files.groupBy("dataset").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.min("size").alias("size_min"), F.max("size").alias("size_max"), F.round(F.avg("size"), 6).alias("size_mean")).transform(with_quantiles, files, ["dataset"], {"size": F.col("size")}, {"p50": ("linear", 0.5), "p90": ("linear", 0.9)}).withColumns({c: F.round(c, 6) for c in ("size_p50", "size_p90")})


#: Of so few files one may hold all bytes; else the largest is taken as so many times the mean.  Fixed value.
FEW = 4


def estimated(profiles: DataFrame) -> DataFrame:
    """``profiles`` with the sizes that counts and bytes alone would suggest, beside the true ones."""
    mean = F.col("bytes") / F.col("files")
    largest = F.when(F.col("files") <= FEW, F.col("bytes")).otherwise(F.floor(mean * FEW)).cast("long")
    least = F.when(F.col("bytes") == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(mean))).cast("long")
    return profiles.withColumns({"estimated_min": least, "estimated_max": largest, "estimated_p50": F.round(mean, 6), "estimated_p90": F.round(F.greatest(mean, largest.cast("double")), 6)})


def phase_totals(phases: DataFrame, aliases: dict[tuple[str, str], str]) -> DataFrame:
    """Seconds and bytes of each run's phases; ``aliases`` name a role's phase, e.g. a receiver's write."""
    name = F.lit(None).cast("string")
    for (role, phase), alias in aliases.items():
        name = F.when((F.col("role") == role) & (F.col("phase") == phase), alias).otherwise(name)
    return phases.groupBy("run", "role", "phase").agg(F.round(F.sum("seconds"), 4).alias("seconds"), F.sum("bytes").alias("bytes")).withColumn("alias", name)


def regime(mib: int = 1 << 20, small: int = 64 << 10) -> Column:
    c = F.col
    return F.when((c("files") > 32) & (c("size_p50") < small) & (c("bytes") < 5 * mib), "small_files").when((c("size_max") >= 50 * mib) & (c("files") <= 4), "large_objects").when((c("files") > 10) & (c("size_p90") >= mib), "mixed").when(c("bytes") >= 80 * mib, "bandwidth").otherwise("general")
