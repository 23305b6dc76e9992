"""Verdicts on runs, files and configurations: ordered rules, the first that holds counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from driftledger.functions.workers import dealt

from .ranges import coalesce
from .ranks import with_quantiles
from .runs import MIDDLE, _rounded, median


def result_class(exit_code: Column, timed_out: Column, hash_match: Column) -> Column:
    return F.when(timed_out | (exit_code != 0), "fail_runtime").when(~hash_match, "fail_correctness").otherwise("pass")


def compression_decision(ratio: Column, gbps: Column, cpu: Column, ready: Column) -> Column:
    """Why a sample stays raw, or ``worthwhile``."""
    return F.when(ratio > 0.85, "poor_ratio").when(gbps < 1.0, "slow_compression").when(cpu > 85.0, "cpu_pressure").when(ready < 0.5, "link_starvation").otherwise("worthwhile")


def evidence(wire: Column, payload: Column, parts: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Status of wire accounting, of the evidence, and its missing parts joined by ``; ``."""
    accounting = F.when(wire.isNull(), "missing").when(wire < 0, "invalid").when(wire < payload, "compressed").otherwise("equal")
    errors = F.array_join(F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in parts.items())), lambda x: x.isNotNull()), "; ")
    return accounting, F.when(errors == "", "complete").otherwise("partial"), errors


def changed_details(events: DataFrame) -> DataFrame:
    """Path and both states of drift messages ``...: PATH manifest_size=n k=v ...``; other messages are left out.

    The path is all between the last ``: `` and the marker, spaces included; without a
    ``: `` it is all before the marker.  Of repeated keys the last counts.
    """
    marker = " manifest_size="
    number = lambda k: F.regexp_extract("message", rf"(?s)^(?:.*\s)?{k}=(\S*)", 1).try_cast("long")
    fields = ("manifest_size", "manifest_mtime", "current_size", "current_mtime")
    path = F.substring_index(F.substring_index("message", marker, 1), ": ", -1)
    return events.where(F.col("message").contains(marker)).select("transfer_id", path.alias("changed_path"), *(number(k).alias(k) for k in fields))


def valid_goodput(result: Column, hash_match: Column, integrity: Column, value: Column) -> Column:
    """The value as a number if the run passed, its hashes match, integrity passed or wasn't told, and it is finite and above 0; else null."""
    x = value.try_cast("double")
    sound = (result == "pass") & (F.lower(hash_match.cast("string")) == "true") & (F.coalesce(integrity, F.lit("")).isin("", "pass"))
    return F.when(sound & ~F.isnan(x) & (x > 0) & (x < float("inf")), x)


def artifact_reason(path: Column, sensitive: str, built: str, suffixes: str) -> Column:
    """Why an artifact path is refused, by the caller's patterns; null if it isn't."""
    return F.when(path.startswith("/"), "absolute").when(F.array_contains(F.split(path, "/"), ".."), "parent").when(path.rlike(sensitive), "sensitive").when(path.rlike(built), "build_output").when(path.rlike(suffixes), "blocked_suffix")


def reconcile(stored: DataFrame, chunks: DataFrame) -> DataFrame:
    """Whether each file's stored ranges are those that its chunks give, each as often.

    Stored ranges count up and derived ones down; in their order the sum must be 0 after each range (equal ones
    at once).  A file's answer comes out at its last row, so neither lists nor a table of files are held.
    """
    side = lambda d, n: d.select("file_id", "begin", "stop", F.lit(n).alias("side"))
    by = Window.partitionBy("file_id").orderBy("begin", "stop")
    even = dealt(side(stored, 1).unionByName(side(coalesce(chunks), -1)), "file_id").withColumn("even", F.sum("side").over(by) == 0)
    so_far = F.bool_and("even").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return even.select("file_id", so_far.alias("matches"), F.lead("side").over(by).isNull().alias("ends")).where("ends").drop("ends")


def final_verify(coverage: DataFrame, policy: str, algorithm: str) -> DataFrame:
    """``verified_chunks`` where a transfer may skip the full read, else ``full``; it may only if its manifest was ``flushed``."""
    allowed = F.lit(policy == "verified_chunks" and algorithm != "none") & (F.col("status") == "complete") & (F.col("bytes_completed") == F.col("total")) & F.coalesce("flushed", F.lit(False))
    return coverage.select("file_id", F.when(allowed, "verified_chunks").otherwise("full").alias("effective_policy"))


#: What identifies a file's state, beside its path.
SNAPSHOT = ("size", "device", "inode", "mtime_ns", "ctime_ns")


def hash_reuse(before: DataFrame, after: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Whether a root's recorded digests may be used again: each file there once, unchanged, and covered by its chunks.

    Both sides have root, relative_path and those of ``SNAPSHOT`` that they share; ``chunks``
    has root, relative_path, begin and length.  Chunks cover a file if in order they start at 0, abut and
    end at its size; chunks of an unknown file are left over.  The reason is the first that holds of any file.
    """
    state = F.struct(*(c for c in SNAPSHOT if c in before.columns and c in after.columns))
    side = lambda d, n: d.groupBy("root", "relative_path").agg(F.count(F.lit(1)).alias(f"{n}_times"), F.min(state).alias(n), F.min("size").alias(f"{n}_size"))
    rows = side(before, "was").join(side(after, "now"), ["root", "relative_path"], "full")
    left_over, covered = F.lit(False), F.lit(True)
    if chunks is not None:
        stop = F.col("begin") + F.col("length")
        abut = F.col("begin") == F.lag(stop, 1, 0).over(Window.partitionBy("root", "relative_path").orderBy("begin", "length"))
        held = chunks.withColumn("abut", abut).groupBy("root", "relative_path").agg((F.bool_and("abut") & (F.min("length") > 0)).alias("abut"), F.max(stop).alias("held"))
        rows = rows.join(held, ["root", "relative_path"], "full")
        left_over = F.col("was").isNull() & F.col("now").isNull()
        covered = F.when(F.col("held").isNull(), F.col("now_size") == 0).otherwise(F.col("abut") & (F.col("held") == F.col("now_size")))
    place = F.when((F.col("was_times") > 1) | (F.col("now_times") > 1), 1).when(left_over, 6).when(F.col("was").isNull(), 2).when(F.col("now").isNull(), 3).when(F.col("was") != F.col("now"), 4).when(~covered, 5).otherwise(9)
    worst = rows.groupBy("root").agg(F.min(place).alias("worst"))
    reason = F.lit(None).cast("string")
    for place_of, name in enumerate(("repeated", "added", "removed", "changed", "not_covered", "left_over"), 1):
        reason = F.when(F.col("worst") == place_of, name).otherwise(reason)
    return worst.select("root", (F.col("worst") == 9).alias("reusable"), reason.alias("reason"))


def resume_stats(totals: DataFrame, chunks: DataFrame) -> DataFrame:
    """What a resumed transfer has of each file: chunks, verified and skipped bytes, missing bytes and ranges.

    ``totals`` has file_id and total; a file without chunks has none.  Chunks are merged once; each merged
    range tells the gap before it, and the last one the gap after it.
    """
    chunks = dealt(chunks, "file_id")
    merged = coalesce(chunks.select("file_id", "begin", (F.col("begin") + F.col("length")).alias("stop"))).join(totals, "file_id")
    before = F.greatest(F.lit(0), F.least("begin", "total") - F.lag("stop", 1, 0).over(Window.partitionBy("file_id").orderBy("begin")))
    held = F.greatest(F.lit(0), F.least("stop", "total") - F.col("begin"))
    sums = merged.withColumns({"gap": before, "held": held}).groupBy("file_id").agg(F.sum(F.col("stop") - F.col("begin")).alias("bytes"), F.sum("held").alias("inside"), F.count_if(F.col("gap") > 0).alias("gaps"), F.max("stop").alias("last"))
    counts = chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("loaded_chunks"))
    rows = totals.join(counts, "file_id", "left").join(sums, "file_id", "left").na.fill(0)
    return rows.select("file_id", "loaded_chunks", F.col("bytes").alias("verified_bytes"), F.col("bytes").alias("skipped_bytes"), (F.col("total") - F.col("inside")).alias("missing_bytes"), (F.col("gaps") + (F.col("last") < F.col("total")).cast("int")).alias("missing_ranges"))


#: Bounds of pressure, CPU percent, effective ratio, and the shares of the wire and of the queue below which it lacks supply.  Fixed values.
PRESSED, CPU_BOUND, RATIO_BOUND, WIRE_LOW, QUEUE_LOW = 0.5, 85.0, 0.95, 0.5, 0.5


def bottleneck(runs: DataFrame, capacity_gbps: float) -> Column:
    """What holds a run back: the first rule that holds of its summary and its link's state."""
    c = F.col
    wire = c("wire_gbps") / capacity_gbps
    return (
        F.when(c("send_pressure") > PRESSED, "network_or_receiver_backpressure")
        .when(c("write_pressure") > PRESSED, "receiver_write")
        .when(c("cpu") > CPU_BOUND, "cpu")
        .when((c("ratio") < RATIO_BOUND) & (c("compressed_items") > 0), "compression")
        .when((wire < WIRE_LOW) & (c("queue_fill") < QUEUE_LOW), "scheduler_supply")
        .when(wire < WIRE_LOW, "network_or_receiver_backpressure")
        .otherwise("unknown_or_balanced")
    )


def freshness(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Recorded artifacts that are ``missing`` or whose digest is another (``stale_hash``)."""
    rows = recorded.join(current.select("path", F.col("sha256").alias("now")), "path", "left")
    reason = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "stale_hash")
    return rows.select("path", reason.alias("reason")).where("reason IS NOT NULL")


def plan_check(planned: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Cases that are missing, extra or planned more than once."""
    rows = planned.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(expected.select(*keys).distinct().withColumn("wanted", F.lit(True)), keys, "full")
    finding = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "extra").when(F.col("n") > 1, "duplicate")
    return rows.select(*keys, finding.alias("finding")).where("finding IS NOT NULL")


def log_coverage(log: DataFrame, expected: DataFrame, success: int) -> DataFrame:
    """Whether each run's log has the expected files and bytes, and only successes; a run without a log fails."""
    rows = log.groupBy("run").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.bool_and(F.col("code") == success).alias("codes"))
    want = expected.select("run", F.col("files").alias("want_files"), F.col("bytes").alias("want_bytes"))
    ok = lambda c: F.coalesce(c, F.lit(False))
    return want.join(rows, "run", "left").select("run", ok(F.col("files") == F.col("want_files")).alias("files_ok"), ok(F.col("bytes") == F.col("want_bytes")).alias("bytes_ok"), ok(F.col("codes")).alias("codes_ok"))


def bind(items: DataFrame, identities: DataFrame) -> DataFrame:
    """Plan items against identities by file, offset and length."""
    keys = ["file_id", "begin", "length"]
    rows = items.select(*keys, F.lit(True).alias("a")).join(identities.select(*keys, F.lit(True).alias("b")), keys, "full")
    return rows.select(*keys, F.when(F.col("a").isNull(), "unplanned").when(F.col("b").isNull(), "unbound").otherwise("bound").alias("status"))


def samples_in_runs(samples: DataFrame, spans: DataFrame) -> DataFrame:
    """Samples and peak of each counter inside each run's span, joined by host and run before times are compared."""
    inside = samples.join(spans, ["host", "run"]).where(F.col("ts").between(F.col("begin"), F.col("stop")))
    return inside.groupBy("host", "run", "name").agg(F.count(F.lit(1)).alias("samples"), F.max("value").alias("peak"))


#: Parts of a preset's cost.
COSTS = ["t_connect", "t_handshake", "t_meta", "t_data"]


def preset_costs(profiles: DataFrame, presets: list[dict], rtt: float, bandwidth: float) -> DataFrame:
    """The cheapest of a few presets (a parameter) for each dataset; ties go to the first name.

    A preset has name, streams, pipeline and handshakes.  Each dataset keeps one row, so
    presets are an array in it, not a join.
    """
    options = [F.struct(F.lit(p["name"]).alias("preset"), F.lit(p["streams"] * rtt).alias("t_connect"), F.lit(p["handshakes"] * rtt).alias("t_handshake"), (F.col("files") * rtt / p["pipeline"]).alias("t_meta"), (F.col("bytes") / (bandwidth * p["streams"])).alias("t_data")) for p in presets]
    total = lambda o: sum((o[c] for c in COSTS[1:]), o[COSTS[0]])
    best = F.array_min(F.transform(F.array(*options), lambda o: F.struct(F.round(total(o), 9).alias("t_job"), o["preset"].alias("preset"), *(F.round(o[c], 9).alias(c) for c in COSTS))))
    rows = profiles.select("dataset", best.alias("o")).select("dataset", "o.*")
    most = F.greatest(*COSTS)
    name = F.coalesce(*(F.when(F.col(c) == most, F.lit(c[2:])) for c in COSTS))
    return rows.withColumn("dominant", name)


#: Percent of spread that is unstable; ratio of extremes; bounds of a stage that doesn't move with its run.  Fixed values.
UNSTABLE, OUTLIER, STILL, MOVED = 20.0, 1.5, 10.0, 30.0


def spread_summary(runs: DataFrame, keys: list[str], metrics: list[str], stages: list[str] | None = None) -> DataFrame:
    """Counts, and the least, median, most, nearest-rank 95th percentile and spread in percent of each metric.

    The first metric is the throughput, the second, if ``stages`` are given, the
    elapsed time.  A stage mismatch: throughput moves and no stage does, or a stage
    moves and neither throughput nor time does.
    """
    out = [c for m in metrics for c in (F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"))]
    ok = F.count_if(F.col("result") == "pass")
    rows = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("repeats"), ok.alias("passes"), (F.count(F.lit(1)) - ok).alias("fails"), *out)
    rows = with_quantiles(rows, runs, keys, {m: F.col(m) for m in metrics}, MIDDLE | {"p95": ("disc", 0.95)})
    width = lambda m: F.col(f"{m}_max") - F.col(f"{m}_min")
    rows = _rounded(rows.withColumns({f"{m}_spread": F.round(F.when(F.col(f"{m}_median") != 0, width(m) / F.abs(f"{m}_median") * 100).when(width(m) == 0, 0.0), 3) for m in metrics}))
    first = metrics[0]
    rows = rows.withColumn("unstable", F.coalesce(F.col(f"{first}_spread") > UNSTABLE, F.lit(False))).withColumn("wide", F.coalesce(F.col(f"{first}_max") / F.nullif(f"{first}_min", F.lit(0.0)) > OUTLIER, F.lit(False)))
    if stages:
        most = F.greatest(*(F.coalesce(f"{m}_spread", F.lit(0.0)) for m in stages)) if len(stages) > 1 else F.coalesce(f"{stages[0]}_spread", F.lit(0.0))
        own, time = (F.coalesce(f"{m}_spread", F.lit(0.0)) for m in metrics[:2])
        rows = rows.withColumn("stage_mismatch", ((own > UNSTABLE) & (most < STILL)) | ((own < STILL) & (most > MOVED) & (time < STILL)))
    return rows


def tree_summary(runs: DataFrame, keys: list[str], sums: list[str], metrics: list[str], common: str) -> DataFrame:
    """Outcomes, statistics of each metric, sums of counters and the most common ``common`` of each group."""
    is_ = lambda r: F.count_if(F.col("result") == r)
    stats = [c for m in metrics for c in (F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"))]
    rows = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), is_("pass").alias("passes"), is_("fail_runtime").alias("fails"), F.count_if(~F.col("hash_match")).alias("hash_mismatches"), *stats, *(F.sum(c).alias(c) for c in sums))
    rows = _rounded(with_quantiles(rows, runs, keys, {m: F.col(m) for m in metrics}, MIDDLE))
    return rows.join(most_common(runs, keys, common), keys)


def most_common(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each group; ties go to the smallest."""
    counts = runs.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def fold_stages(rows: DataFrame, key: str) -> DataFrame:
    """Sums of totals, most of peaks, and whether all rows share one schema."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("ranges"), F.sum("total").alias("total"), F.max("peak").alias("peak"), (F.count_distinct("schema") == 1).alias("schema_ok"))


def observation_status(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Enabled, disabled and broken records of each source, and whether it is complete: none but enabled ones.

    ``rows`` has source, ``parsed`` and, of parsed ones, ``enabled``.
    """
    on = F.col("parsed") & F.coalesce("enabled", F.lit(False))
    counts = rows.groupBy("source").agg(F.count_if(on).alias("enabled"), F.count_if(F.col("parsed") & ~on).alias("disabled"), F.count_if(~F.col("parsed")).alias("malformed"))
    rows = sources.join(counts, "source", "left").na.fill(0, ["enabled", "disabled", "malformed"])
    status = F.when(F.col("enabled") + F.col("disabled") == 0, "missing").when(F.col("malformed") + F.col("disabled") > 0, "partial").otherwise("complete")
    return rows.select("source", "enabled", "disabled", "malformed", status.alias("status"))


def steps(rows: DataFrame) -> DataFrame:
    """Steps of each run, and the first that failed."""
    failed = F.col("status") != "pass"
    return rows.groupBy("run").agg(F.count(F.lit(1)).alias("total"), F.count_if(~failed).alias("passed"), F.count_if(failed).alias("failed"), F.min_by("name", F.when(failed, F.col("step"))).alias("first_failed"))


def interleaved(runs: DataFrame, plan: str) -> DataFrame:
    """Whether the arms of each experiment came in the order of ``plan``, a string of arms that repeats."""
    place = F.row_number().over(Window.partitionBy("experiment").orderBy("seq")) - 1
    wanted = F.substring(F.lit(plan), (place % len(plan) + 1).cast("int"), F.lit(1))
    return runs.select("experiment", (F.col("arm") == wanted).alias("ok")).groupBy("experiment").agg(F.bool_and("ok").alias("in_order"))


def recovery(active: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each active lease of a lost worker must have one verdict; a verdict without such a lease is wrong too."""
    counts = verdicts.groupBy("lease_id").agg(F.count(F.lit(1)).alias("n"))
    rows = active.select("lease_id", F.lit(True).alias("active")).join(counts, "lease_id", "full")
    return rows.select("lease_id", F.coalesce("n", F.lit(0)).alias("verdict_count"), F.coalesce(F.col("active") & (F.col("n") == 1), F.lit(False)).alias("ok"))


def recommend(summary: DataFrame, medians: DataFrame, keys: list[str], config: str) -> DataFrame:
    """The best configuration of each key; opt in only where its runs are stable."""
    best = medians.groupBy(*keys).agg(F.max_by(config, F.struct("median", config)).alias(config))
    rows = best.join(summary, [*keys, config])
    return rows.groupBy(*keys, config).agg(F.max("spread_pct").alias("spread_pct"), F.bool_or("unstable").alias("unstable")).select(*keys, config, "spread_pct", F.when(~F.col("unstable") & (F.col("spread_pct") <= 20), "opt_in").otherwise("keep_default").alias("decision"))


def least_loaded(items: DataFrame, links: DataFrame) -> DataFrame:
    """A healthy link of the least load per capacity for each item; links that tie take turns by the item's index.

    ``links`` may have ``draining``: such links get nothing.  Load doesn't change while
    items are dealt, so only tied links matter; their ids are one array, a scalar
    of the plan, which items index.  Without a healthy link nothing is dealt.
    """
    load = F.round((F.col("ready_bytes") / F.col("capacity")).cast("double"), 9)
    usable = links.where("healthy AND NOT draining") if "draining" in links.columns else links.where("healthy")
    tied = usable.groupBy(load.alias("load")).agg(F.array_sort(F.collect_list("link_id")).alias("ids")).agg(F.min_by("ids", "load")).scalar()
    turn = F.pmod(F.col("index"), F.greatest(F.size(tied), F.lit(1))).cast("int")
    return items.withColumn("link_id", F.get(tied, turn)).where("link_id IS NOT NULL")


def artifact_finding(path: Column, content: Column, built: str, suffixes: str) -> Column:
    """Why a file doesn't belong into a release: its name, its suffix, an ELF head or NUL bytes near its start."""
    head = F.substring(content, 1, 8192)
    return F.when(path.rlike(built), "build_name").when(path.rlike(suffixes), "binary_suffix").when(F.substring(content, 1, 4) == F.lit(b"\x7fELF"), "elf").when(F.contains(head, F.lit(b"\0")), "nul_bytes")


def artifact_type(path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The class of the first rule (``starts`` or ``ends``, text, class) that holds; else ``other``."""
    out = None
    for how, text, name in rules:
        meets = path.startswith(text) if how == "starts" else path.endswith(text)
        out = F.when(meets, name) if out is None else out.when(meets, name)
    return F.lit("other") if out is None else out.otherwise("other")


def publish_conflicts(targets: DataFrame, outputs: DataFrame, manifests: DataFrame) -> DataFrame:
    """Whether each target (path, resume) may be written: no output yet, and a manifest if and only if it resumes."""
    rows = targets.join(outputs.select("path").distinct().withColumn("there", F.lit(True)), "path", "left").join(manifests.select("path").distinct().withColumn("known", F.lit(True)), "path", "left")
    verdict = F.when(F.col("there"), "output_exists").when(F.col("resume") & F.col("known").isNull(), "manifest_required").when(~F.col("resume") & F.col("known"), "manifest_exists").otherwise("ok")
    return rows.select("path", verdict.alias("verdict"))


def population(members: DataFrame, trees: DataFrame, n: int, size: int) -> DataFrame:
    """Whether each slot has ``n`` committed members of one size and one tree of ``n`` distinct complete paths."""
    good = (F.col("state") == "committed") & (F.col("total_size") == size)
    a = members.groupBy("slot").agg(F.count(F.lit(1)).alias("members"), F.bool_and(good).alias("good"))
    per_tree = trees.groupBy("slot", "manifest_id").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("relative_path").alias("paths"), F.bool_and(F.col("status") == "completed").alias("done"))
    b = per_tree.groupBy("slot").agg(F.count(F.lit(1)).alias("trees"), F.bool_and((F.col("files") == n) & (F.col("paths") == n)).alias("whole"), F.bool_and("done").alias("done"))
    rows = a.join(b, "slot", "full").na.fill(0, ["members", "trees"])
    reason = F.when(F.col("members") != n, "member_count").when(F.col("trees") != 1, "tree_count").when(~F.col("good"), "member_state").when(~F.col("whole"), "tree_paths").when(~F.col("done"), "tree_status")
    return rows.select("slot", "members", "trees", reason.isNull().alias("ok"), reason.alias("reason"))


def depth_compare(external: DataFrame, runs: DataFrame, repeats: int) -> DataFrame:
    """Each depth of a direction against an external baseline and depth 0.

    Both inputs have direction, repeat, goodput (null: not valid) and maybe seconds, ``runs`` depth too.
    A set is complete if all ``repeats`` are there and valid; ratio, change and what
    got better need complete sets.  Seconds are those of valid repeats.
    """
    valid = lambda d: F.when(F.col("goodput").isNotNull(), F.col("seconds") if "seconds" in d.columns else F.lit(None).cast("double"))
    sums = lambda d, keys, name: d.groupBy(*keys).agg(F.count_distinct("repeat").alias(f"{name}_observed"), F.count("goodput").alias(f"{name}_valid"), F.round(median("goodput"), 6).alias(f"{name}_median"), F.round(median(valid(d)), 6).alias(f"{name}_seconds"))
    at = sums(runs, ["direction", "depth"], "depth")
    zero = at.where("depth = 0").select("direction", *(F.col(f"depth_{c}").alias(f"zero_{c}") for c in ("observed", "valid", "median", "seconds")))
    rows = at.where("depth <> 0").join(zero, "direction", "left").join(sums(external, ["direction"], "external"), "direction", "left")
    whole = lambda name: F.coalesce((F.col(f"{name}_observed") == repeats) & (F.col(f"{name}_valid") == repeats), F.lit(False))
    every, both = whole("depth") & whole("external") & whole("zero"), whole("depth") & whole("zero")
    detail = F.when(F.col("depth_observed") != repeats, "repeats").when(~whole("depth"), "valid").when(~whole("external"), "external").when(~whole("zero"), "depth_0").otherwise("")
    measured = [F.col(f"{n}_{c}") for n in ("depth", "zero", "external") for c in ("median", "seconds")]
    return rows.select("direction", "depth", "depth_observed", "depth_valid", *measured, F.when(every, F.round(F.col("depth_median") / F.col("external_median"), 6)).alias("ratio"), F.when(both, F.round(F.col("depth_median") / F.col("zero_median") - 1, 6)).alias("delta"), F.when(both, F.col("depth_median") > F.col("zero_median")).alias("goodput_improved"), F.when(both, F.col("depth_seconds") < F.col("zero_seconds")).alias("time_decreased"), F.when(every, "COMPLETE").otherwise("INCOMPLETE").alias("status"), detail.alias("detail"))


def best_passing(summary: DataFrame, key: str, config: str, value: str) -> DataFrame:
    """The configuration of the greatest value of each key among those without a failure; ties go to the first."""
    return summary.where("fails = 0").groupBy(key).agg(F.min_by(config, F.struct(-F.col(value), F.col(config))).alias(config), F.max(value).alias(value))


def referenced(rows: DataFrame, known: tuple[str, ...] = (), suffix: str = "_log") -> DataFrame:
    """Distinct artifact paths that rows name: columns in ``known`` and all that end in ``suffix``; absolute paths and those that leave their folder don't count."""
    names = [c for c in rows.columns if c in known or c.endswith(suffix)]
    path = F.trim("path")
    found = rows.select(*(F.col(c).cast("string").alias(c) for c in names)).unpivot([], names, "kind", "path").select(path.alias("path"))
    return found.where((F.col("path") != "") & ~F.col("path").startswith("/") & ~F.array_contains(F.split("path", "/"), "..")).distinct()


#: Percent that a candidate must gain, repeats at least, and percent of spread that is unstable.  Fixed values.
GAIN, REPEATS, VOLATILE = 10.0, 3, 25.0


def backend_gate(matrix: DataFrame, storage: DataFrame, key: list[str], rest: list[str], storage_key: list[str], required: list[tuple], candidate: str, baseline: str) -> DataFrame:
    """One decision on a backend: ``continue``, ``incomplete``, ``unstable`` or ``pause``.

    Both tables have backend, median, repeats, fails and spread_pct, ``matrix`` for each ``key`` and ``rest``, ``storage`` for each
    ``storage_key``; a candidate's gain is against the baseline of the same.  It goes on if its
    best gain is ``GAIN`` or more at every required key, storage gains somewhere, and
    no candidate row fails, is repeated too little or spreads too far.
    """
    def gains(rows: DataFrame, by: list[str]) -> DataFrame:
        base = rows.where(F.col("backend") == baseline).groupBy(*by).agg(F.max("median").alias("base"))
        mine = rows.where(F.col("backend") == candidate).join(base, by, "left")
        return mine.withColumn("gain", F.when(F.col("base") > 0, (F.col("median") - F.col("base")) / F.col("base") * 100))

    mine = gains(matrix, [*key, *rest])
    short = (F.col("repeats") < REPEATS) | (F.col("fails") > 0)
    best = mine.groupBy(*key).agg(F.max("gain").alias("gain"), F.bool_or(short).alias("incomplete"), F.bool_or(short | F.coalesce(F.col("spread_pct") > VOLATILE, F.lit(False))).alias("unstable"))
    wanted = F.struct(*key).isin(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(key, values, strict=True))) for values in required))
    facts = best.agg(F.count_if(wanted & (F.col("gain") >= GAIN)).alias("keys_gained"), F.coalesce(F.bool_or("incomplete"), F.lit(False)).alias("incomplete"), F.coalesce(F.bool_or("unstable"), F.lit(False)).alias("unstable"))
    stored_gain = gains(storage, storage_key).agg(F.coalesce(F.max("gain") >= GAIN, F.lit(False)).alias("storage_gain"))
    rows = facts.join(F.broadcast(stored_gain))  # a row each
    verdict = F.when((F.col("keys_gained") == len(required)) & F.col("storage_gain") & ~F.col("unstable"), "continue").when(F.col("incomplete"), "incomplete").when(F.col("unstable"), "unstable").otherwise("pause")
    return rows.select("keys_gained", "storage_gain", "incomplete", "unstable", verdict.alias("decision"))


def rollup(rows: DataFrame, source: str, default: Column) -> DataFrame:
    """Rows, failures and default configurations of each source's summary; a count of failures that is no number is one failure."""
    fails = F.coalesce(F.when(F.coalesce("fail_count", F.lit("")) == "", F.lit(0)).otherwise(F.col("fail_count").try_cast("long")), F.lit(1))
    sums = rows.groupBy(source).agg(F.count(F.lit(1)).alias("rows"), F.sum(fails).alias("fail_count"), F.count_if(default).alias("default_rows"))
    return sums.withColumn("status", F.when(F.col("fail_count") == 0, "pass").otherwise("fail"))


#: Share of the observer's threads below which nothing can be gained from them.  Fixed value.
ENVELOPE = 0.10


def observer_gate(report: DataFrame, envelopes: DataFrame, key: str) -> DataFrame:
    """What an observed run says of each experiment: nothing if observing it changed it, else by its greatest envelope fraction."""
    most = envelopes.groupBy(key).agg(F.round(F.max("fraction"), 6).alias("envelope_max"), F.round(median("fraction"), 6).alias("envelope_median"))
    sound = (F.abs("gain_pct") <= 5) & (F.col("a_cv") <= 0.05) & (F.col("b_cv") <= 0.05)
    verdict = F.when(~sound, "inconclusive").when(F.col("envelope_max") < ENVELOPE, "below_envelope").otherwise("accepted")
    return report.join(most, key, "left").select(key, "envelope_max", "envelope_median", verdict.alias("verdict"))
