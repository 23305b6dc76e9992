"""Queries of verdicts, reconciliations, roll-ups and the remaining gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftledger.functions.workers import dealt
from driftledger.operators import ranges, records, runs, verdicts

from .integrity_queries import _log_lines, _marked_lines, formats
from .record_queries import STAGES, _medians, _paired
from .stream_queries import totals as _short_totals
from .tables import Tables, sql

KEYS = ["system", "dataset", "direction"]
#: Keys of the summaries of single runs and of storage runs.  Fixed values.
PRIVATE_KEYS = ["mode", "direction", "bytes", "connections", "chunk_size", "buffer_size", "checksum_algorithm", "checksum_backend", "preallocate", "file_io_backend", "file_io_buffer_size", "file_io_queue_depth", "file_io_batch_size", "file_io_advice", "posix_write_strategy", "posix_write_strategy_effective", "manifest_flush_policy", "manifest_flush_interval_chunks", "commit_sync_policy", "final_verify_policy", "final_verify_policy_effective"]
STORAGE_KEYS = ["side", "operation", "bytes", "buffer_size", "preallocate", "file_io_backend", "file_io_buffer_size", "file_io_queue_depth", "file_io_batch_size", "file_io_advice", "posix_write_strategy", "posix_write_strategy_effective"]
PROBES = ["stage_read_seconds", "stage_write_seconds"]
PRESETS = [{"name": "lean", "streams": 1, "pipeline": 64, "handshakes": 1}, {"name": "wide", "streams": 8, "pipeline": 8, "handshakes": 4}, {"name": "plain", "streams": 2, "pipeline": 1, "handshakes": 2}]
RTT, BANDWIDTH = 0.02, 50_000.0
SENSITIVE, BUILT, BLOCKED = "web", "^build/|/build/", r"[05]\.txt$"


def _totals(t: Tables):
    return t.orders.select(F.col("o_orderkey").alias("file_id"), F.lit(7168).cast("long").alias("total"))


def _within(t: Tables):
    """Chunks within their files, dealt before the join: a repartition behind it by the same key would be left out."""
    return dealt(t.f2, "file_id").join(_short_totals(t), "file_id").where("begin + length <= total").select("file_id", "begin", "length")


def _stored(t: Tables):
    """Ranges as manifests hold them; each 9th file's are shifted."""
    return ranges.coalesce(t.f2v).withColumn("stop", F.col("stop") + F.when(F.col("file_id") % 9 == 0, 1).otherwise(0))


def _final(t: Tables):
    """Some manifests weren't flushed."""
    rows = ranges.coverage(t.f2v, _totals(t)).join(_totals(t), "file_id").withColumn("flushed", F.col("file_id") % 10 != 3)
    return verdicts.final_verify(rows, "verified_chunks", "crc32c")


def _drift_log(t: Tables):
    """Drift messages, some after others' prefixes and with spaces in their paths."""
    path = F.when(F.col("file_id") % 2 == 0, F.concat(F.lit("my dir/a "), "file_id", F.lit(": b.txt"))).otherwise(F.concat(F.lit("f/"), "file_id"))
    head = F.when(F.col("file_id") % 5 == 0, "restart failed: source changed: ").when(F.col("file_id") % 5 == 1, "").otherwise("source changed: ")
    text = F.concat(head, path, F.lit(" manifest_size="), "size", F.lit(" manifest_mtime="), "mtime_s", F.lit(" current_size="), F.col("size") + 1, F.lit(" current_mtime="), F.when(F.col("file_id") % 7 == 0, F.lit("?")).otherwise(F.col("mtime_s").cast("string")))
    return t.f1.select("transfer_id", F.when(F.col("file_id") % 3 == 0, text).otherwise(F.lit("source changed")).alias("message"))


def _goodput(t: Tables):
    text = F.when(F.col("repeat_index") % 13 == 0, "NaN").when(F.col("repeat_index") % 13 == 1, "Infinity").when(F.col("repeat_index") % 13 == 2, "-1").when(F.col("repeat_index") % 13 == 3, "n/a").otherwise(F.col("goodput").cast("string"))
    match, integrity = F.when(F.col("line") == 7, "False").otherwise("TRUE"), F.when(F.col("line") == 6, "fail").when(F.col("line") > 3, "pass").when(F.col("line") == 1, "")
    return t.f4.select("repeat_index", "line", "goodput", verdicts.valid_goodput(F.col("result"), match, integrity, text).alias("valid_goodput"))


def _best(t: Tables):
    """Configurations are a few hundred mixes of parameters, each with its own runs."""
    runs_of = t.f4.withColumn("config", F.col("repeat_index") % 997)
    summary = runs_of.groupBy("direction", "config").agg(F.round(runs.median("goodput"), 6).alias("median"), F.count_if(F.col("result").startswith("fail")).alias("fails"))
    return verdicts.best_passing(summary, "direction", "config", "median")


def _digests(t: Tables):
    return t.documents.select("doc_id", F.concat(F.lit("d/"), "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))


def _fresh(t: Tables):
    now = _digests(t).where("doc_id % 5 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 7 == 0, F.lit("x")).otherwise(F.col("sha256")))
    return verdicts.freshness(_digests(t), now)


def _log(t: Tables):
    rows = formats.transfer_log(_log_lines(t), "/raw/")
    seen = t.events.where("event_type <> 'view'").groupBy(F.concat(F.lit("u"), "user_id").alias("run")).agg((F.count(F.lit(1)) + (F.max("user_id") % 2)).alias("files"), F.sum(F.floor(F.col("value") * 1000)).alias("bytes"))
    return verdicts.log_coverage(rows, seen, 226)


def _reuse(t: Tables):
    """One decision over all datasets: the large one gains and no other loses much."""
    gain = F.col("gain_pct")
    return _paired(t).agg(F.bool_and(F.when(F.col("dataset") == "A", gain >= 10).otherwise(gain >= -5)).alias("go"), F.round(F.min("gain_pct"), 6).alias("least_gain")).select("least_gain", F.when(F.col("go"), "go").otherwise("no_go").alias("decision"))


def _backend(t: Tables):
    """Checksums and buffers stand for the keys of the matrix; storage is summed by its own."""
    checksum = F.when(F.col("preallocate"), "crc32c").otherwise("none").alias("checksum")
    facts = lambda d, *by: d.groupBy(F.col("file_io_backend").alias("backend"), *by).agg(F.count(F.lit(1)).alias("repeats"), F.count_if(F.col("result").startswith("fail")).alias("fails"), F.round(runs.median("goodput"), 6).alias("median"), F.round((F.max("goodput") - F.min("goodput")) / runs.median("goodput") * 100, 3).alias("spread_pct"))
    return verdicts.backend_gate(facts(t.f4k, "direction", checksum, "dataset"), facts(t.f4k, "side"), ["direction", "checksum"], ["dataset"], ["side"], [(d, c) for d in ("upload", "download") for c in ("crc32c", "none")], "ring", "posix")


def _share(t: Tables):
    ok = runs.quantiles(t.f4.where("result = 'pass'"), ["direction"], {"wait_s": F.col("wait_s"), "write_s": F.col("write_s"), "overall": F.col("wait_s") + F.col("write_s") + 0.05}, runs.MIDDLE)
    ok = ok.select("direction", *(F.col(f"{c}_median").alias(c) for c in ("wait_s", "write_s", "overall")))
    share = F.round(F.greatest("wait_s", "write_s") / F.col("overall"), 6)
    return ok.select("direction", share.alias("share"), (share >= 0.4).alias("qualifies"))


def _tree(t: Tables):
    return verdicts.tree_summary(t.f4k, KEYS, ["retries"], ["goodput", "elapsed"], "bottleneck")


def _older(t: Tables):
    """Medians of an older run of the same datasets: the odd lines alone."""
    return runs.medians(t.f4.where("line % 2 = 1").withColumnRenamed("system", "mode"), ["dataset", "mode"], "goodput")


def _reused(t: Tables):
    """Snapshots of files and their chunks before and after; some have another inode, some lack a chunk and hold another twice."""
    files = t.f1.select(F.col("dataset").alias("root"), "relative_path", "file_id", "size", F.lit(1).alias("device"), F.col("file_id").alias("inode"), (F.col("mtime_s") * 1_000_000_000).alias("mtime_ns"), (F.col("mtime_s") * 1_000_000_000 + 5).alias("ctime_ns"))
    after = files.withColumn("inode", F.col("inode") + F.when(F.col("file_id") % 401 == 7, 1).otherwise(0))
    chunks = ranges.plan_chunks(t.f1, 1024, 1).join(t.f1.select("file_id", F.col("dataset").alias("root"), "relative_path"), "file_id")
    # As many bytes as before, but not the second kilobyte.
    chunks = chunks.withColumn("begin", F.when((F.col("file_id") % 307 == 5) & (F.col("chunk_id") == 1), 0).otherwise(F.col("begin")))
    return verdicts.hash_reuse(files, after, chunks.select("root", "relative_path", "begin", "length"))


def _held_back(t: Tables):
    rows = t.f4.select("repeat_index", "line", (F.col("goodput") / 1000).alias("wire_gbps"), (F.col("wait_s") * 8).alias("send_pressure"), (F.col("write_s") * 7).alias("write_pressure"), (F.col("repeat_index") % 101).cast("double").alias("cpu"), (F.col("repeat_index") % 97 / 90).alias("ratio"), (F.col("line") % 2).alias("compressed_items"), (F.col("repeat_index") % 10 / 10).alias("queue_fill"))
    return rows.select("repeat_index", "line", verdicts.bottleneck(rows, 100.0).alias("bottleneck"))


def _pressure(t: Tables):
    """Each host's days of clicks as runs, and the counter samples inside them."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("run")
    spans = t.events.where("event_type = 'click'").groupBy((F.col("user_id") % 5).alias("host"), day).agg(F.min("ts").alias("begin"), F.max("ts").alias("stop"))
    return verdicts.samples_in_runs(t.counter.select("host", day, "ts", "name", "value"), spans)


def _steps(t: Tables):
    return verdicts.steps(t.events.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.concat(F.lit("s"), "event_id").alias("name"), F.when(F.col("event_type") == "error", "fail").otherwise("pass").alias("status")))


def _queues(t: Tables):
    rows = runs.counter_delta(t.hourly).withColumn("queue", F.regexp_extract(F.concat(F.lit("rx"), F.col("host"), F.lit("_"), F.col("name")), r"^rx(\d+)_", 1).cast("long"))
    kind = lambda n: F.coalesce(F.sum(F.when(F.col("name") == n, F.col("delta"))), F.lit(0)).alias(n)
    return rows.groupBy("queue").agg(kind("view"), kind("error")).where("view <> 0 OR error <> 0")


def _observed(t: Tables):
    rows = formats.marked_json(_marked_lines(t), "OBSERVED ", "id long, n long").withColumn("enabled", (F.col("id") % 7 != 0) | F.col("source").isin("u4", "u5"))
    return verdicts.observation_status(rows, t.events.select(F.concat(F.lit("u"), F.col("user_id") % 20 + F.when(F.col("user_id") % 10 == 3, 100000).otherwise(0)).alias("source")).distinct())


def _rollup(t: Tables):
    """Summary tables of datasets, some of whose counts are no numbers."""
    rows = runs.summary(t.f4, KEYS).withColumn("fail_count", F.when(F.col("fails") % 3 == 1, F.lit("n/a")).when(F.col("fails") == 0, F.lit("")).otherwise(F.col("fails").cast("string")))
    return verdicts.rollup(rows, "dataset", (F.col("system") == "F") & (F.col("direction") == 0))


def _named(t: Tables):
    return verdicts.referenced(t.f1.select(F.concat(F.lit("log/"), "dataset").alias("run_log"), F.when(F.col("file_id") % 4 == 0, F.concat(F.lit("/abs/"), "file_id")).when(F.col("file_id") % 4 == 1, F.concat(F.lit("a/../"), "file_id")).when(F.col("file_id") % 4 == 2, " ").otherwise(F.concat(F.lit(" c/"), "file_id", F.lit(" "))).alias("client_log"), F.col("relative_path").alias("evidence"), F.col("transfer_id").alias("other")), ("evidence",))


def _evidence(t: Tables):
    wire = F.when(F.col("user_id") % 6 == 0, F.lit(None)).when(F.col("user_id") % 6 == 1, -1).otherwise(F.floor(F.col("value") * 900 + 5)).cast("long")
    found = verdicts.evidence(wire, F.floor(F.col("value") * 1000), {"hash": F.col("event_id") % 4 != 0, "log": F.col("event_id") % 3 != 0})
    return t.events.select("event_id", *(c.alias(n) for c, n in zip(found, ("accounting", "evidence", "errors"))))


def _classes(t: Tables):
    return t.events.select("event_id", verdicts.result_class(F.when(F.col("event_type") == "error", 1).otherwise(0), F.col("event_id") % 50 == 0, F.col("event_id") % 20 != 3).alias("result"))


def _population(t: Tables):
    """Slots are sources; members are their documents, trees those of one language each."""
    slot = F.concat_ws("/", "source", "lang").alias("slot")
    done = F.when(F.col("doc_id") % 211 == 0, "failed").otherwise("completed")
    members = t.documents.select(slot, F.when(F.col("doc_id") % 199 == 0, "open").otherwise("committed").alias("state"), F.lit(1).alias("total_size"))
    trees = t.documents.select(slot, F.lit("m").alias("manifest_id"), F.col("doc_id").cast("string").alias("relative_path"), done.alias("status"))
    return verdicts.population(members, trees, 60, 1)


def _depths(t: Tables):
    by = ("direction", F.col("repeat_index").alias("repeat"))
    one = t.f4.groupBy("direction", "line", "system", "repeat_index").agg(F.max(F.when(F.col("result") == "pass", F.col("goodput"))).alias("goodput"), F.max("wait_s").alias("seconds"))
    return verdicts.depth_compare(one.where("system = 'F' AND line < 3").select(*by, "goodput", "seconds"), one.where("system = 'O'").select(*by, F.expr("line div 3").alias("depth"), "goodput", "seconds"), 100)


def _publish(t: Tables):
    targets = t.f1.select(F.col("relative_path").alias("path"), (F.col("file_id") % 2 == 0).alias("resume"), "file_id")
    return verdicts.publish_conflicts(targets.drop("file_id"), targets.where("file_id % 5 = 0"), targets.where("file_id % 3 = 0"))


#: Classes of artifacts by the ends and starts of paths, in order.
TYPES = [("ends", "0.txt", "gate"), ("starts", "web/", "doc"), ("ends", "5.txt", "log")]

QUERIES = {
    "artifact_type": lambda t: t.f1.select(F.col("relative_path").alias("path"), verdicts.artifact_type(F.col("relative_path"), TYPES).alias("artifact_type")),
    "publish_conflicts": _publish,
    "manifest_population_check": _population,
    "depth_compare": _depths,
    "result_classify": _classes,
    "evidence_classify": _evidence,
    "goodput_valid": _goodput,
    "compression_decide": lambda t: t.events.select("event_id", verdicts.compression_decision(F.col("event_id") % 100 / 100, F.col("event_id") % 7 / 2, F.col("event_id") % 101 * 1.0, F.col("event_id") % 11 / 10).alias("reason")),
    "bottleneck_classify": _held_back,
    "assign_least_loaded": lambda t: verdicts.least_loaded(t.f2.select("file_id", "begin", F.expr("begin div length").alias("index")), t.f5.withColumn("ready_bytes", F.expr("ready_bytes div 2000 * capacity")).withColumn("draining", F.col("capacity") % 11 == 0)).select("file_id", "begin", "link_id"),
    "hygiene_artifacts": lambda t: t.documents.select(F.concat("source", F.lit("/"), "doc_id", F.when(F.col("doc_id") % 9 == 0, ".so").otherwise(".txt")).alias("path"), F.concat(F.when(F.col("doc_id") % 7 == 0, F.lit(b"\x7fELF")).otherwise(F.lit(b"ab")), F.encode("text", "UTF-8"), F.when(F.col("doc_id") % 5 == 0, F.lit(b"\0")).otherwise(F.lit(b""))).alias("content")).select("path", verdicts.artifact_finding(F.col("path"), F.col("content"), "^build/|/build/", r"\.(so|o|a)$").alias("finding")).where("finding IS NOT NULL"),
    "changed_details": lambda t: verdicts.changed_details(_drift_log(t)),
    "artifact_path_validate": lambda t: t.f1.select(F.when(F.col("file_id") % 8 == 0, F.concat(F.lit("/"), "relative_path")).when(F.col("file_id") % 8 == 1, F.concat(F.lit("../"), "relative_path")).when(F.col("file_id") % 8 == 2, F.concat(F.lit("build/"), "relative_path")).otherwise(F.col("relative_path")).alias("path")).withColumn("reason", verdicts.artifact_reason(F.col("path"), SENSITIVE, BUILT, BLOCKED)),
    "ranges_reconcile": lambda t: verdicts.reconcile(_stored(t), t.f2v),
    "resume_stats": lambda t: verdicts.resume_stats(_short_totals(t), _within(t)),
    "final_verify_policy": _final,
    "hash_reuse_check": _reused,
    "artifact_freshness": _fresh,
    "referenced_artifacts": _named,
    "run_compare": lambda t: runs.run_ratios(_medians(t), _older(t), "dataset", "mode", "F", "O"),
    "plan_validate": lambda t: verdicts.plan_check(t.f2.where("file_id % 4 <> 1 OR chunk_id <> 2").select("file_id", "chunk_id").unionByName(t.f2.where("file_id % 5 = 1").select("file_id", "chunk_id")), t.f2.where("file_id % 6 <> 2"), ["file_id", "chunk_id"]),
    "log_coverage": _log,
    "pressure_correlate": _pressure,
    "scheduled_bind": lambda t: verdicts.bind(t.f2.where("file_id % 5 <> 3"), t.f2.where("file_id % 6 <> 2")),
    "preset_recommend": lambda t: verdicts.preset_costs(runs.profile(t.f1), PRESETS, RTT, BANDWIDTH),
    "summary_private": lambda t: verdicts.spread_summary(t.f4k, PRIVATE_KEYS, ["goodput", "elapsed", *STAGES], PROBES),
    "summary_storage": lambda t: verdicts.spread_summary(t.f4k, STORAGE_KEYS, ["goodput", "elapsed"]),
    "summary_tree": _tree,
    "stage_profile_fold": lambda t: verdicts.fold_stages(t.f3.select("event", F.col("bytes").alias("total"), F.col("elapsed_seconds").alias("peak"), F.lit(1).alias("schema")), "event"),
    "lane_totals": lambda t: t.stage.groupBy("lane").agg(F.count(F.lit(1)).alias("ranges"), F.sum(F.col("stop") - F.col("begin")).alias("total_us"), F.max(F.col("stop") - F.col("begin")).alias("peak_us"), *(F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("stop") - F.col("begin"))), F.lit(0)).alias(f"{s}_us") for s in ("click", "view")), F.max("stop").alias("high_watermark_us")),
    "observation_status": _observed,
    "manifest_save_stats": lambda t: t.f3.groupBy("transfer_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("result") == "ok").alias("successes"), F.sum("bytes").alias("bytes"), F.round(F.sum("elapsed_seconds"), 4).alias("seconds"), F.count_if(F.col("result") == "fail").alias("failures")),
    "steps_rollup": _steps,
    "matrix_rollup": _rollup,
    "counter_by_queue": _queues,
    "order_interleave_check": lambda t: verdicts.interleaved(t.acks.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).select((F.col("file_id") % 50).alias("experiment"), F.col("file_id").alias("seq"), F.when((F.col("file_id") % 100 < 50) == (F.col("file_id") % 50 < 49), "A").otherwise("B").alias("arm")), "ABBA"),
    "lease_recovery_ledger": lambda t: verdicts.recovery(t.lease.where("state = 'in_flight'").select("lease_id").distinct(), t.lease.where("state = 'completed' AND event_id % 97 = 5").select("lease_id")),
    "best_vs_baseline": lambda t: runs.baseline_delta(_medians(t), "dataset", "mode", "F").where("mode <> 'F' AND delta_pct IS NOT NULL").agg(F.max_by(F.struct("dataset", "mode", "delta_pct"), F.struct("delta_pct", "dataset")).alias("b")).select("b.*"),
    "gate_reuse": _reuse,
    "gate_backend": _backend,
    "gate_io_share": _share,
    "recommend_config": lambda t: verdicts.recommend(runs.summary(t.f4, ["dataset", "system"]).withColumnRenamed("system", "mode"), _medians(t), ["dataset"], "mode"),
}

_MERGED = "m0 AS (SELECT *, CASE WHEN max(stop) OVER (PARTITION BY file_id ORDER BY begin, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= begin THEN 0 ELSE 1 END AS isnew FROM f2v), m1 AS (SELECT *, sum(isnew) OVER (PARTITION BY file_id ORDER BY begin, stop ROWS UNBOUNDED PRECEDING) AS island FROM m0), merged AS (SELECT file_id, min(begin) AS begin, max(stop) AS stop FROM m1 GROUP BY file_id, island)"
_MED = "meds AS (SELECT dataset, system AS mode, round(quantile_cont(goodput, 0.5), 6) AS median FROM f4 GROUP BY 1, 2)"
_PAIR = "w AS (SELECT dataset, rep, first(seconds) FILTER (arm = 'F') AS a, first(seconds) FILTER (arm = 'O') AS b FROM f4p GROUP BY 1, 2), r AS (SELECT dataset, round(quantile_cont((a - b) / a * 100, 0.5), 6) AS gain_pct FROM w GROUP BY 1)"


def _stats(m: str) -> str:
    return f"min({m}) AS {m}_min, round(quantile_cont({m}, 0.5), 6) AS {m}_median, max({m}) AS {m}_max, quantile_disc({m}, 0.95) AS {m}_p95, round(CASE WHEN quantile_cont({m}, 0.5) <> 0 THEN (max({m}) - min({m})) / abs(quantile_cont({m}, 0.5)) * 100 WHEN max({m}) = min({m}) THEN 0 END, 3) AS {m}_spread"


_COUNTS = "count(*) AS repeats, count(*) FILTER (result = 'pass') AS passes, count(*) FILTER (result <> 'pass') AS fails"
_FLAGS = "coalesce(goodput_spread > 20, false) AS unstable, coalesce(goodput_max / nullif(goodput_min, 0) > 1.5, false) AS wide"
_MISMATCH = "(goodput_spread > 20 AND greatest(stage_read_seconds_spread, stage_write_seconds_spread) < 10) OR (goodput_spread < 10 AND greatest(stage_read_seconds_spread, stage_write_seconds_spread) > 30 AND elapsed_spread < 10) AS stage_mismatch"
_PRESET = " UNION ALL ".join(f"SELECT dataset, '{p['name']}' AS preset, {p['streams'] * RTT}::DOUBLE AS t_connect, {p['handshakes'] * RTT}::DOUBLE AS t_handshake, files * {RTT}::DOUBLE / {p['pipeline']} AS t_meta, bytes / {BANDWIDTH * p['streams']}::DOUBLE AS t_data FROM p" for p in PRESETS)

SQL = {
    "artifact_type": "SELECT relative_path AS path, CASE WHEN relative_path LIKE '%0.txt' THEN 'gate' WHEN relative_path LIKE 'web/%' THEN 'doc' WHEN relative_path LIKE '%5.txt' THEN 'log' ELSE 'other' END AS artifact_type FROM f1",
    "publish_conflicts": "SELECT relative_path AS path, CASE WHEN file_id % 5 = 0 THEN 'output_exists' WHEN file_id % 2 = 0 AND file_id % 3 <> 0 THEN 'manifest_required' WHEN file_id % 2 <> 0 AND file_id % 3 = 0 THEN 'manifest_exists' ELSE 'ok' END AS verdict FROM f1",
    "manifest_population_check": "WITH g AS (SELECT source || '/' || lang AS slot, count(*) AS n, bool_and(doc_id % 199 <> 0) AS good, bool_and(doc_id % 211 <> 0) AS done FROM documents GROUP BY 1), r AS (SELECT slot, n AS members, 1 AS trees, CASE WHEN n <> 60 THEN 'member_count' WHEN NOT good THEN 'member_state' WHEN NOT done THEN 'tree_status' END AS reason FROM g) SELECT slot, members, trees, reason IS NULL AS ok, reason FROM r",
    "depth_compare": "WITH o AS (SELECT direction, line, system, repeat_index, max(goodput) FILTER (result = 'pass') AS goodput, max(wait_s) AS secs FROM f4 GROUP BY 1, 2, 3, 4), e AS (SELECT direction, count(DISTINCT repeat_index) AS eo, count(goodput) AS ev, round(quantile_cont(goodput, 0.5), 6) AS em, round(quantile_cont(secs, 0.5) FILTER (goodput IS NOT NULL), 6) AS es FROM o WHERE system = 'F' AND line < 3 GROUP BY 1), d AS (SELECT direction, line // 3 AS depth, count(DISTINCT repeat_index) AS n, count(goodput) AS v, round(quantile_cont(goodput, 0.5), 6) AS m, round(quantile_cont(secs, 0.5) FILTER (goodput IS NOT NULL), 6) AS s FROM o WHERE system = 'O' GROUP BY 1, 2), j AS (SELECT d.*, z.m AS zm, z.s AS zs, em, es, d.n = 100 AND d.v = 100 AS a, coalesce(eo = 100 AND ev = 100, false) AS b, coalesce(z.n = 100 AND z.v = 100, false) AS c FROM d LEFT JOIN d z ON z.direction = d.direction AND z.depth = 0 LEFT JOIN e ON e.direction = d.direction WHERE d.depth <> 0) SELECT direction, depth, n AS depth_observed, v AS depth_valid, m AS depth_median, s AS depth_seconds, zm AS zero_median, zs AS zero_seconds, em AS external_median, es AS external_seconds, CASE WHEN a AND b AND c THEN round(m / em, 6) END AS ratio, CASE WHEN a AND c THEN round(m / zm - 1, 6) END AS delta, CASE WHEN a AND c THEN m > zm END AS goodput_improved, CASE WHEN a AND c THEN s < zs END AS time_decreased, CASE WHEN a AND b AND c THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS status, CASE WHEN n <> 100 THEN 'repeats' WHEN NOT a THEN 'valid' WHEN NOT b THEN 'external' WHEN NOT c THEN 'depth_0' ELSE '' END AS detail FROM j",
    "result_classify": "SELECT event_id, CASE WHEN event_id % 50 = 0 OR event_type = 'error' THEN 'fail_runtime' WHEN event_id % 20 = 3 THEN 'fail_correctness' ELSE 'pass' END AS result FROM events",
    "evidence_classify": "WITH e AS (SELECT event_id, CASE WHEN user_id % 6 = 0 THEN NULL WHEN user_id % 6 = 1 THEN -1 ELSE floor(value * 900 + 5) END AS wire, floor(value * 1000) AS payload, concat_ws('; ', CASE WHEN event_id % 4 = 0 THEN 'hash' END, CASE WHEN event_id % 3 = 0 THEN 'log' END) AS errors FROM events) SELECT event_id, CASE WHEN wire IS NULL THEN 'missing' WHEN wire < 0 THEN 'invalid' WHEN wire < payload THEN 'compressed' ELSE 'equal' END AS accounting, CASE WHEN errors = '' THEN 'complete' ELSE 'partial' END AS evidence, errors FROM e",
    "goodput_valid": "SELECT repeat_index, line, goodput, CASE WHEN repeat_index % 13 > 3 AND line NOT IN (6, 7) AND result = 'pass' THEN goodput END AS valid_goodput FROM f4",
    "compression_decide": "SELECT event_id, CASE WHEN event_id % 100 > 85 THEN 'poor_ratio' WHEN event_id % 7 < 2 THEN 'slow_compression' WHEN event_id % 101 > 85 THEN 'cpu_pressure' WHEN event_id % 11 < 5 THEN 'link_starvation' ELSE 'worthwhile' END AS reason FROM events",
    "bottleneck_classify": "SELECT repeat_index, line, CASE WHEN wait_s * 8 > 0.5 THEN 'network_or_receiver_backpressure' WHEN write_s * 7 > 0.5 THEN 'receiver_write' WHEN repeat_index % 101 > 85 THEN 'cpu' WHEN repeat_index % 97 / 90.0::DOUBLE < 0.95 AND line % 2 > 0 THEN 'compression' WHEN goodput / 1000 / 100 < 0.5 THEN CASE WHEN repeat_index % 10 < 5 THEN 'scheduler_supply' ELSE 'network_or_receiver_backpressure' END ELSE 'unknown_or_balanced' END AS bottleneck FROM f4",
    "assign_least_loaded": "WITH l AS (SELECT link_id, (ready_bytes // 2000) AS load FROM f5 WHERE healthy AND capacity % 11 <> 0), k AS (SELECT link_id, row_number() OVER (ORDER BY link_id) - 1 AS turn, count(*) OVER () AS n FROM l WHERE load = (SELECT min(load) FROM l)) SELECT file_id, begin, link_id FROM f2 JOIN k ON (begin // length) % n = turn",
    "hygiene_artifacts": "SELECT source || '/' || doc_id || CASE WHEN doc_id % 9 = 0 THEN '.so' ELSE '.txt' END AS path, CASE WHEN doc_id % 9 = 0 THEN 'binary_suffix' WHEN doc_id % 7 = 0 THEN 'elf' ELSE 'nul_bytes' END AS finding FROM documents WHERE doc_id % 9 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0 AND strlen(text) + 2 < 8192",
    "changed_details": "SELECT transfer_id, CASE WHEN file_id % 5 = 1 AND file_id % 2 = 0 THEN 'b.txt' WHEN file_id % 2 = 0 THEN 'b.txt' ELSE 'f/' || file_id END AS changed_path, size AS manifest_size, mtime_s AS manifest_mtime, size + 1 AS current_size, CASE WHEN file_id % 7 <> 0 THEN mtime_s END AS current_mtime FROM f1 WHERE file_id % 3 = 0",
    "artifact_path_validate": f"WITH p AS (SELECT CASE file_id % 8 WHEN 0 THEN '/' || relative_path WHEN 1 THEN '../' || relative_path WHEN 2 THEN 'build/' || relative_path ELSE relative_path END AS path FROM f1) SELECT path, CASE WHEN path LIKE '/%' THEN 'absolute' WHEN path LIKE '../%' THEN 'parent' WHEN regexp_matches(path, '{SENSITIVE}') THEN 'sensitive' WHEN regexp_matches(path, '{BUILT}') THEN 'build_output' WHEN regexp_matches(path, '{BLOCKED}') THEN 'blocked_suffix' END AS reason FROM p",
    "ranges_reconcile": "SELECT DISTINCT file_id, file_id % 9 <> 0 AS matches FROM f2v",
    "resume_stats": "WITH t AS (SELECT o_orderkey AS file_id, 7168 - 300 * (o_orderkey % 3) AS total FROM orders), n AS (SELECT file_id, total, unnest(range(7)) AS k FROM t), h AS (SELECT n.*, f2.file_id IS NOT NULL AND (k + 1) * 1024 <= total AS held, least(1024, total - k * 1024) AS bytes FROM n LEFT JOIN f2 ON f2.file_id = n.file_id AND f2.chunk_id = k), r AS (SELECT *, k - row_number() OVER (PARTITION BY file_id, held ORDER BY k) AS run FROM h) SELECT file_id, count(*) FILTER (held) AS loaded_chunks, coalesce(sum(bytes) FILTER (held), 0)::BIGINT AS verified_bytes, coalesce(sum(bytes) FILTER (held), 0)::BIGINT AS skipped_bytes, coalesce(sum(bytes) FILTER (NOT held), 0)::BIGINT AS missing_bytes, count(DISTINCT run) FILTER (NOT held) AS missing_ranges FROM r GROUP BY 1",
    "final_verify_policy": f"WITH {_MERGED}, o AS (SELECT file_id, bool_or(again) AS again FROM (SELECT file_id, coalesce(max(stop) OVER (PARTITION BY file_id ORDER BY begin, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > begin, false) AS again FROM f2v) GROUP BY 1), d AS (SELECT file_id, sum(stop - begin) AS done FROM merged GROUP BY 1) SELECT o_orderkey AS file_id, CASE WHEN done = 7168 AND NOT again AND o_orderkey % 10 <> 3 THEN 'verified_chunks' ELSE 'full' END AS effective_policy FROM orders LEFT JOIN d ON d.file_id = o_orderkey LEFT JOIN o ON o.file_id = o_orderkey",
    "hash_reuse_check": "SELECT dataset AS root, count(*) FILTER (file_id % 401 = 7 OR file_id % 307 = 5 AND size > 1024) = 0 AS reusable, CASE WHEN count(*) FILTER (file_id % 401 = 7) > 0 THEN 'changed' WHEN count(*) FILTER (file_id % 307 = 5 AND size > 1024) > 0 THEN 'not_covered' END AS reason FROM f1 GROUP BY 1",
    "artifact_freshness": "SELECT 'd/' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'missing' ELSE 'stale_hash' END AS reason FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0",
    "referenced_artifacts": "SELECT DISTINCT 'log/' || dataset AS path FROM f1 UNION SELECT relative_path FROM f1 UNION SELECT 'c/' || file_id FROM f1 WHERE file_id % 4 = 3",
    "run_compare": f"WITH {_MED}, older AS (SELECT dataset, round(quantile_cont(goodput, 0.5), 6) AS median FROM f4 WHERE system = 'O' AND line % 2 = 1 GROUP BY 1) SELECT a.dataset, round(b.median / a.median, 6) AS ratio, round(b.median / o.median, 6) AS older_ratio FROM meds a JOIN meds b ON a.dataset = b.dataset AND a.mode = 'F' AND b.mode = 'O' JOIN older o ON o.dataset = a.dataset",
    "plan_validate": "SELECT * FROM (SELECT file_id, chunk_id, CASE WHEN p = 0 THEN 'missing' WHEN file_id % 6 = 2 THEN 'extra' WHEN p > 1 THEN 'duplicate' END AS finding FROM (SELECT file_id, chunk_id, CASE WHEN file_id % 4 <> 1 OR chunk_id <> 2 THEN 1 ELSE 0 END + CASE WHEN file_id % 5 = 1 THEN 1 ELSE 0 END AS p FROM f2) WHERE p > 0 OR file_id % 6 <> 2) WHERE finding IS NOT NULL",
    "log_coverage": "SELECT DISTINCT 'u' || user_id AS run, user_id % 2 = 0 AS files_ok, true AS bytes_ok, true AS codes_ok FROM events WHERE event_type <> 'view'",
    "pressure_correlate": "WITH r AS (SELECT user_id % 5 AS host, strftime(ts, '%Y-%m-%d') AS run, min(ts) AS begin, max(ts) AS stop FROM events WHERE event_type = 'click' GROUP BY 1, 2) SELECT r.host, run, name, count(*) AS samples, max(value)::BIGINT AS peak FROM r JOIN counter c ON c.host = r.host AND c.ts BETWEEN r.begin AND r.stop GROUP BY 1, 2, 3",
    "scheduled_bind": "SELECT file_id, begin, length, CASE WHEN file_id % 5 = 3 THEN 'unplanned' WHEN file_id % 6 = 2 THEN 'unbound' ELSE 'bound' END AS status FROM f2 WHERE file_id % 5 <> 3 OR file_id % 6 <> 2",
    "preset_recommend": f"WITH p AS (SELECT dataset, count(*) AS files, sum(size)::BIGINT AS bytes FROM f1 GROUP BY 1), o AS ({_PRESET}), b AS (SELECT *, round(t_connect + t_handshake + t_meta + t_data, 9) AS t_job FROM o), c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY t_job, preset) = 1) SELECT dataset, t_job, preset, round(t_connect, 9) AS t_connect, round(t_handshake, 9) AS t_handshake, round(t_meta, 9) AS t_meta, round(t_data, 9) AS t_data, CASE greatest(t_connect, t_handshake, t_meta, t_data) WHEN t_connect THEN 'connect' WHEN t_handshake THEN 'handshake' WHEN t_meta THEN 'meta' ELSE 'data' END AS dominant FROM c",
    "summary_private": f"SELECT *, {_FLAGS}, {_MISMATCH} FROM (SELECT {', '.join(PRIVATE_KEYS)}, {_COUNTS}, {', '.join(map(_stats, ['goodput', 'elapsed', *STAGES]))} FROM f4k GROUP BY {', '.join(PRIVATE_KEYS)})",
    "summary_storage": f"SELECT *, {_FLAGS} FROM (SELECT {', '.join(STORAGE_KEYS)}, {_COUNTS}, {_stats('goodput')}, {_stats('elapsed')} FROM f4k GROUP BY {', '.join(STORAGE_KEYS)})",
    "summary_tree": "WITH c AS (SELECT system, dataset, direction, bottleneck, count(*) AS n FROM f4k GROUP BY 1, 2, 3, 4), m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY system, dataset, direction ORDER BY n DESC, bottleneck) = 1), s AS (SELECT system, dataset, direction, count(*) AS runs, count(*) FILTER (result = 'pass') AS passes, count(*) FILTER (result = 'fail_runtime') AS fails, count(*) FILTER (NOT hash_match) AS hash_mismatches, min(goodput) AS goodput_min, round(quantile_cont(goodput, 0.5), 6) AS goodput_median, max(goodput) AS goodput_max, min(elapsed) AS elapsed_min, round(quantile_cont(elapsed, 0.5), 6) AS elapsed_median, max(elapsed) AS elapsed_max, sum(retries)::BIGINT AS retries FROM f4k GROUP BY 1, 2, 3) SELECT s.*, m.bottleneck FROM s JOIN m USING (system, dataset, direction)",
    "stage_profile_fold": "SELECT event, count(*) AS ranges, sum(bytes)::BIGINT AS total, max(elapsed_seconds) AS peak, true AS schema_ok FROM f3 GROUP BY 1",
    "lane_totals": "SELECT lane, count(*) AS ranges, sum(stop - begin)::BIGINT AS total_us, max(stop - begin) AS peak_us, coalesce(sum(stop - begin) FILTER (stage = 'click'), 0)::BIGINT AS click_us, coalesce(sum(stop - begin) FILTER (stage = 'view'), 0)::BIGINT AS view_us, max(stop) AS high_watermark_us FROM stage GROUP BY 1",
    "observation_status": "WITH s AS (SELECT DISTINCT user_id % 20 + CASE WHEN user_id % 10 = 3 THEN 100000 ELSE 0 END AS k FROM events), c AS (SELECT user_id % 20 AS k, count(*) FILTER (event_id % 10 <> 0 AND (event_id % 7 <> 0 OR user_id % 20 IN (4, 5))) AS e, count(*) FILTER (event_id % 10 <> 0 AND event_id % 7 = 0 AND user_id % 20 NOT IN (4, 5)) AS d, count(*) FILTER (event_id % 10 = 0) AS m FROM events GROUP BY 1) SELECT 'u' || s.k AS source, coalesce(e, 0) AS enabled, coalesce(d, 0) AS disabled, coalesce(m, 0) AS malformed, CASE WHEN coalesce(e, 0) + coalesce(d, 0) = 0 THEN 'missing' WHEN m + d > 0 THEN 'partial' ELSE 'complete' END AS status FROM s LEFT JOIN c ON s.k = c.k",
    "manifest_save_stats": "SELECT transfer_id, count(*) AS attempts, count(*) FILTER (result = 'ok') AS successes, sum(bytes)::BIGINT AS bytes, round(sum(elapsed_seconds), 4) AS seconds, count(*) FILTER (result = 'fail') AS failures FROM f3 GROUP BY 1",
    "steps_rollup": "SELECT user_id AS run, count(*) AS total, count(*) FILTER (event_type <> 'error') AS passed, count(*) FILTER (event_type = 'error') AS failed, 's' || min(event_id) FILTER (event_type = 'error') AS first_failed FROM events GROUP BY 1",
    "matrix_rollup": "WITH s AS (SELECT system, dataset, direction, count(*) FILTER (result LIKE 'fail%') AS fails FROM f4 GROUP BY 1, 2, 3) SELECT dataset, count(*) AS rows, sum(CASE WHEN fails % 3 = 1 THEN 1 ELSE fails END)::BIGINT AS fail_count, count(*) FILTER (system = 'F' AND direction = 0) AS default_rows, CASE WHEN sum(fails) > 0 THEN 'fail' ELSE 'pass' END AS status FROM s GROUP BY 1",
    "counter_by_queue": "WITH d AS (SELECT host, name, (value - lag(value) OVER (PARTITION BY host, name ORDER BY ts))::BIGINT AS delta FROM hourly), g AS (SELECT host AS queue, coalesce(sum(delta) FILTER (name = 'view'), 0)::BIGINT AS view, coalesce(sum(delta) FILTER (name = 'error'), 0)::BIGINT AS error FROM d GROUP BY 1) SELECT * FROM g WHERE view <> 0 OR error <> 0",
    "order_interleave_check": "WITH r AS (SELECT DISTINCT file_id % 50 AS experiment, file_id AS seq, CASE WHEN (file_id % 100 < 50) = (file_id % 50 < 49) THEN 'A' ELSE 'B' END AS arm FROM acks), p AS (SELECT *, (row_number() OVER (PARTITION BY experiment ORDER BY seq) - 1) % 4 AS k FROM r) SELECT experiment, bool_and(arm = substr('ABBA', (k + 1)::INT, 1)) AS in_order FROM p GROUP BY 1",
    "lease_recovery_ledger": "WITH a AS (SELECT DISTINCT lease_id FROM lease WHERE state = 'in_flight'), v AS (SELECT lease_id, count(*) AS n FROM lease WHERE state = 'completed' AND event_id % 97 = 5 GROUP BY 1) SELECT coalesce(a.lease_id, v.lease_id) AS lease_id, coalesce(n, 0) AS verdict_count, a.lease_id IS NOT NULL AND coalesce(n, 0) = 1 AS ok FROM a FULL JOIN v ON a.lease_id = v.lease_id",
    "best_vs_baseline": f"WITH {_MED} SELECT m.dataset, m.mode, round((m.median - b.median) / b.median * 100, 6) AS delta_pct FROM meds m JOIN meds b ON m.dataset = b.dataset AND b.mode = 'F' WHERE m.mode <> 'F' AND b.median > 0 ORDER BY delta_pct DESC, m.dataset DESC LIMIT 1",
    "gate_reuse": f"WITH {_PAIR} SELECT min(gain_pct) AS least_gain, CASE WHEN bool_and(CASE WHEN dataset = 'A' THEN gain_pct >= 10 ELSE gain_pct >= -5 END) THEN 'go' ELSE 'no_go' END AS decision FROM r",
    "gate_backend": "WITH m AS (SELECT direction, preallocate, dataset, file_io_backend AS b, count(*) AS n, count(*) FILTER (result LIKE 'fail%') AS f, round(quantile_cont(goodput, 0.5), 6) AS med, round((max(goodput) - min(goodput)) / quantile_cont(goodput, 0.5) * 100, 3) AS spread FROM f4k GROUP BY 1, 2, 3, 4), st AS (SELECT side, file_io_backend AS b, round(quantile_cont(goodput, 0.5), 6) AS med FROM f4k GROUP BY 1, 2), g AS (SELECT c.direction, c.preallocate, max((c.med / p.med - 1) * 100) AS gain FROM m c JOIN m p ON p.direction = c.direction AND p.preallocate = c.preallocate AND p.dataset = c.dataset WHERE c.b = 'ring' AND p.b = 'posix' GROUP BY 1, 2), r AS (SELECT (SELECT count(*) FROM g WHERE gain >= 10) AS keys_gained, (SELECT coalesce(max(c.med / p.med - 1) >= 0.1, false) FROM st c JOIN st p ON p.side = c.side WHERE c.b = 'ring' AND p.b = 'posix') AS storage_gain, (SELECT bool_or(f > 0 OR n < 3) FROM m WHERE b = 'ring') AS incomplete, (SELECT bool_or(f > 0 OR n < 3 OR spread > 25) FROM m WHERE b = 'ring') AS unstable) SELECT *, CASE WHEN keys_gained = 4 AND storage_gain AND NOT unstable THEN 'continue' WHEN incomplete THEN 'incomplete' WHEN unstable THEN 'unstable' ELSE 'pause' END AS decision FROM r",
    "gate_io_share": "WITH g AS (SELECT direction, quantile_cont(wait_s, 0.5) AS a, quantile_cont(write_s, 0.5) AS b, quantile_cont(wait_s + write_s + 0.05, 0.5) AS o FROM f4 WHERE result = 'pass' GROUP BY 1) SELECT direction, round(greatest(a, b) / o, 6) AS share, round(greatest(a, b) / o, 6) >= 0.4 AS qualifies FROM g",
    "recommend_config": f"WITH {_MED}, b AS (SELECT dataset, arg_max(mode, (median, mode)) AS mode FROM meds GROUP BY 1), s AS (SELECT dataset, system AS mode, round((max(goodput) - min(goodput)) / round(quantile_cont(goodput, 0.5), 6) * 100, 3) AS spread_pct FROM f4 GROUP BY 1, 2) SELECT b.dataset, b.mode, spread_pct, CASE WHEN spread_pct <= 20 THEN 'opt_in' ELSE 'keep_default' END AS decision FROM b JOIN s ON b.dataset = s.dataset AND b.mode = s.mode",
}
SQL = {k: sql(v) for k, v in SQL.items()}
