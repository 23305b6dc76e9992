"""Queries over file, run, event and counter records."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftledger.operators import acks, integrity, records, runs, verdicts

from .stream_queries import ack_fold
from .tables import Tables, sql

KEYS = ["system", "dataset", "direction"]
#: Keys of the summaries and the stages whose medians they have.  Fixed values.
COMPARE_KEYS = ["system", "stage", "dataset", "direction", "file_parallelism", "per_file_connections", "control_pipeline_depth", "scheduler", "scheduler_policy", "file_io_backend", "queue_depth", "batch_size"]
MATRIX_KEYS = ["direction", "checksum_algorithm", "preallocate", "file_io_buffer_size", "file_io_advice", "final_verify_policy", "final_verify_policy_effective"]
STAGES = ["stage_read_seconds", "stage_write_seconds", "file_io_wait_seconds", "stage_read_calls", "stage_write_calls", "stage_read_avg_bytes_per_call", "stage_write_avg_bytes_per_call", "stage_manifest_flush_seconds", "stage_final_verify_seconds", "stage_rename_commit_seconds", "stage_overall_seconds"]
SIZE = 8 << 30
#: Names of phases by role: the events stand for phases.
ALIASES = {("sender", "view"): "source_read", ("sender", "click"): "network_send", ("receiver", "click"): "temp_write"}


def _medians(t: Tables):
    return runs.medians(t.f4.withColumnRenamed("system", "mode"), ["dataset", "mode"], "goodput")


def _paired(t: Tables):
    return runs.paired_gate(t.f4p, "dataset", "rep", "arm", ("F", "O"), "seconds", SIZE, ("read_s", "send_s"), "wall_s")


def _ordered(t: Tables):
    """The same with the order of the runs: A before B in odd pairs, B before A in even ones, but for one dataset."""
    second = (F.col("arm") == "O") == ((F.col("rep") % 2 == 1) | (F.col("dataset") == "N"))
    return runs.paired_gate(t.f4p.withColumn("seq", F.col("rep") * 2 + second.cast("int")), "dataset", "rep", "arm", ("F", "O"), "seconds", SIZE, ("read_s", "send_s"), "wall_s", "seq")


def _gated(rule, pairs=5, of=_paired):
    return lambda t: runs.gate(of(t), rule, pairs).select("dataset", "pairs", "improved_pairs", "gain_pct", "valid", "reason", "verdict")


def _acks(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("file_id"), (F.col("l_linenumber").cast("long") - 1).alias("chunk_id"), "l_partkey", "l_suppkey", "l_extendedprice").withColumn("begin", F.col("chunk_id") * 1024)
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("file_id").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "chunk_id")))


def _lines(t: Tables):
    return t.events.select(F.concat(F.lit("u"), "user_id").alias("source"), F.col("event_id").alias("line_no"), F.concat(F.lit("role id="), "event_id", F.lit(" type="), "event_type", F.lit(" n="), F.floor(F.col("value"))).alias("line"))


#: Rules on a report's columns, as SQL.
GATES = {
    "gate_m1": "b_gbps >= 0.001 AND a_cv <= 0.05 AND b_cv <= 0.05 AND improved_pairs >= 4 AND errors = 0",
    "gate_m2": "b_gbps >= 0.0015 AND b_cv <= 0.05 AND improved_pairs >= 4 AND errors = 0 AND parts_ok",
    "gate_overhead": "a_cv <= 0.05 AND b_cv <= 0.05 AND gain_pct <= -5 AND pairs - improved_pairs >= 4",
    "gate_regression": "gain_pct >= -5 AND b_cv <= 0.05",
    "gate_improvement": "gain_pct >= 20 AND a_cv <= 0.05 AND b_cv <= 0.05 AND improved_pairs = pairs AND b_p95 <= a_p95",
    "gate_cpu": "gain_pct >= 30 AND a_cv <= 0.05 AND b_cv <= 0.05 AND a_wall_cv <= 0.05 AND b_wall_cv <= 0.05",
}
#: Other forms of the improvement: the smaller one, and the negative control, which must not change.
FORMS = {"small": "gain_pct >= 10 AND a_cv <= 0.05 AND b_cv <= 0.05 AND improved_pairs = pairs AND b_p95 <= a_p95", "control": "abs(gain_pct) <= 5 AND a_cv <= 0.05 AND b_cv <= 0.05"}
#: Counts of a scheduler that its summary may tell.
SCHED = ["click", "error", "purchase", "signup", "view"]


def _improvement(t: Tables):
    rows = runs.gate(_paired(t), GATES["gate_improvement"], 5)
    return rows.select("dataset", "pairs", "improved_pairs", "gain_pct", "valid", "reason", "verdict", *(F.when(~F.col("valid"), "invalid").when(F.expr(rule), "go").otherwise("no_go").alias(n) for n, rule in FORMS.items()))


def _sidecars(t: Tables):
    """Both forms: by name, and only manifests that are valid and name their target."""
    files = t.f1.select("file_id", F.when(F.col("file_id") % 9 == 0, F.concat("relative_path", F.lit(".part.tmp"))).when(F.col("file_id") % 9 == 1, F.concat("relative_path", F.lit(".manifest"))).otherwise(F.col("relative_path")).alias("relative_path"))
    target = F.when(F.col("file_id") % 2 == 0, F.expr("substring(relative_path, 1, length(relative_path) - 9)")).otherwise("elsewhere")
    manifests = files.select("relative_path", target.alias("output_path"), (F.col("file_id") % 4 != 0).alias("is_valid"))
    loose = records.without_sidecars(files).withColumn("form", F.lit("by_name"))
    return loose.unionByName(records.without_owned_sidecars(files, manifests, ".manifest").withColumn("form", F.lit("strict")))


def _best(t: Tables):
    """Configurations are a few hundred mixes of parameters, each with its own runs."""
    mixed = t.f4.withColumn("config", F.col("repeat_index") % 997)
    fails = mixed.groupBy("direction", "config").agg(F.count_if(F.col("result").startswith("fail")).alias("fails"))
    return verdicts.best_passing(fails.join(runs.medians(mixed, ["direction", "config"], "goodput"), ["direction", "config"]), "direction", "config", "median")


QUERIES = {
    "scan_listing": lambda t: records.listing(t.f1).withColumn("folder", F.lit("")).unionByName(records.listing(t.f1, "web").withColumn("folder", F.lit("web"))),
    "scan_metric_lines": lambda t: records.metric_lines(_lines(t)).select("source", "line_no", *(F.col("metrics")[k].alias(f"metric_{k}") for k in ("id", "type", "n"))),
    "path_validate": lambda t: t.pages.select("page_id", "url", F.regexp_replace("url", "^https?://", "").alias("path")).union(t.pages.select("page_id", "url", "url")).select("page_id", "path", records.path_reason(F.col("path")).alias("reason")).withColumn("is_valid", F.col("reason").isNull()),
    "path_resolve": lambda t: t.f1.select("file_id", F.concat(F.element_at(F.array(F.lit("../"), F.lit("a/./"), F.lit("../../../"), F.lit("/x/../"), F.lit("")), (F.col("file_id") % 5 + 1).cast("int")), "relative_path").alias("p")).select("file_id", records.resolve("/home/u", F.col("p"))[0].alias("virtual_path"), records.resolve("/home/u", F.col("p"))[1].alias("escapes_root")),
    "sidecar_filter": _sidecars,
    "transfer_id_validate": lambda t: t.f1.select("file_id", F.when(F.col("file_id") % 6 == 0, F.concat("transfer_id", F.lit("/x"))).otherwise(F.col("transfer_id")).alias("transfer_id")).withColumn("is_valid", F.col("transfer_id").rlike("^[A-Za-z0-9._-]{1,128}$")),
    "normalize_results": lambda t: t.f1.select("file_id", F.concat(F.col("size").cast("string"), F.element_at(F.array(*map(F.lit, ("", "k", "kb", "MiB", "g"))), (F.col("file_id") % 5 + 1).cast("int"))).alias("token")).select("file_id", records.size_bytes(F.col("token")).alias("bytes"), F.lower(F.hex(F.col("file_id"))).alias("hex_id"), F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("file_id")), "yyyyMMddHHmmss").alias("stamp")),
    "error_classify": lambda t: t.f3.select("sequence", "message", records.error_code(F.col("message")).alias("error_code")),
    "message_redact": lambda t: t.f3.select("sequence", F.concat(F.lit("PASS "), "transfer_id", F.lit(" then "), "message").alias("m")).select("sequence", records.redact(F.col("m")).alias("message")),
    "throughput": lambda t: t.f3.select("sequence", F.round(F.when(F.col("elapsed_seconds") > 0, F.col("bytes") / F.col("elapsed_seconds")).otherwise(0.0), 3).alias("bytes_per_second"), F.round(F.when(F.col("elapsed_seconds") > 0, F.col("bytes") * 8 / F.col("elapsed_seconds") / 1e9).otherwise(0.0), 9).alias("gbps")),
    "link_bdp": lambda t: t.f5.withColumn("bdp", F.col("capacity") * 1e9 * 0.02 / 8).withColumn("target_queue", F.greatest(F.col("bdp") * 2, F.lit(4096.0))).select("link_id", "bdp", "target_queue", F.round(F.col("ready_bytes") / F.col("target_queue"), 9).alias("fill_ratio"), (F.col("ready_bytes") > 2 * F.col("target_queue")).alias("pause")),
    "hygiene_scan": lambda t: records.hygiene_scan(t.documents),
    "resume_preflight": lambda t: records.preflight(t.f1, t.drift),
    "resume_preflight_download": lambda t: records.download_preflight(t.f1, t.drift, t.f1.where("file_id % 10 <> 2")),
    "artifact_sync": lambda t: records.preflight(t.f1, t.drift).groupBy("verdict").agg(F.count(F.lit(1)).alias("files"), F.sum("manifest_size").alias("manifest_bytes"), F.sum("current_size").alias("current_bytes")),
    "set_missing_extra": lambda t: records.set_difference(t.f1, t.drift, "relative_path"),
    "set_union_sources": lambda t: t.f1.select("relative_path", "size", F.lit("manifest").alias("origin")).unionByName(t.drift.select("relative_path", "size", F.lit("current").alias("origin"))),
    "dup_paths": lambda t: t.f1.select(F.col("dataset").alias("manifest_id"), F.concat("dataset", F.lit("/"), (F.col("file_id") % 40).cast("string")).alias("path")).groupBy("manifest_id", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
    "file_sha256": lambda t: t.documents.select(F.col("doc_id").alias("file_id"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256")),
    "tree_hash_sha256": lambda t: integrity.tree_sha256(t.documents.select(F.col("source").alias("root"), F.concat("source", F.lit("/"), "doc_id").alias("relative_path"), F.octet_length("text").alias("size"), F.sha2("text", 256).alias("sha256"))),
    "chunk_conflicts": lambda t: acks.chunk_conflicts(t.clash),
    "manifest_status_counts": lambda t: t.f1.groupBy(F.col("dataset").alias("manifest_id")).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "changed")), F.bool_and(F.col("status") == "completed").alias("complete")),
    "summary_compare": lambda t: runs.summary(t.f4k, COMPARE_KEYS),
    "summary_matrix": lambda t: runs.passing_summary(t.f4k, MATRIX_KEYS, STAGES),
    "stage_describe": lambda t: runs.describe(t.f4, ["system", "dataset"], "goodput"),
    "stage_share": lambda t: runs.stage_share(t.f4, ["system", "dataset"], ["wait_s", "write_s"]),
    "phase_totals": lambda t: runs.phase_totals(t.f3.select(F.col("transfer_id").alias("run"), F.when(F.col("sequence") % 2 == 0, "sender").otherwise("receiver").alias("role"), F.col("event").alias("phase"), F.col("elapsed_seconds").alias("seconds"), "bytes"), ALIASES),
    "workload_profile": lambda t: runs.estimated(runs.profile(t.f1)),
    "regime_classify": lambda t: runs.profile(t.f1).select("dataset", runs.regime().alias("regime")),
    "event_summary": lambda t: runs.event_summary(t.f3, records.error_code(F.col("message"))),
    "sched_event_counts": lambda t: runs.sched_counts(t.f3.select(F.col("transfer_id").alias("run"), "event"), t.events.groupBy(F.concat(F.lit("t-"), "user_id").alias("run")).agg(F.max(F.when(F.col("user_id") % 3 == 0, 0).when(F.col("user_id") % 3 == 1, F.col("user_id") + 1000)).alias("click"), *(F.lit(0).alias(k) for k in SCHED[1:])), SCHED),
    "median_table": lambda t: t.f4p.groupBy("arm", "dataset").agg(F.count(F.lit(1)).alias("n"), F.round(runs.median("seconds"), 6).alias("median_s"), F.min("seconds").alias("min_s"), F.max("seconds").alias("max_s"), (F.count(F.lit(1)) == 7).alias("n_ok")),
    "baseline_delta": lambda t: runs.baseline_delta(_medians(t), "dataset", "mode", "F"),
    "mode_compare": lambda t: runs.mode_deltas(t.f4k.where("NOT (dataset = 'A' AND direction = 'upload' AND retries % 3 = 0)").withColumn("mode", F.element_at(F.array(F.lit("off"), F.lit("fixed"), F.lit("adaptive")), F.col("retries") % 3 + 1)), ["dataset", "direction"], "mode", "off", ["fixed", "adaptive"], ["goodput", "elapsed"]),
    "best_config": lambda t: _best(t),
    "top_slow": lambda t: t.f4.where("result = 'pass'").orderBy("goodput", "repeat_index", "line", "system", "dataset").limit(8).select("repeat_index", "line", "goodput"),
    "top_unstable": lambda t: runs.summary(t.f4, KEYS).where("unstable").orderBy(F.desc("spread_pct"), *KEYS).limit(24).select(*KEYS, "spread_pct"),
    "counter_delta": lambda t: runs.counter_delta(t.hourly.where("NOT (host = 3 AND name = 'click' AND value > 20000)"), "^signup$"),
    "append_watermark": lambda t: runs.append_watermark(_acks(t)),
    "lease_transitions": lambda t: runs.lease_transitions(t.lease_io),
    "queue_wait": lambda t: runs.queue_wait(t.lease),
    "gate_ab": _paired,
    "gate_observer": lambda t: verdicts.observer_gate(_paired(t), t.f4p.where("arm = 'O'").select("dataset", (F.col("rep") % 4 / F.when(F.col("dataset") == "A", 40).otherwise(20)).alias("fraction")), "dataset"),
    **{k: _gated(rule, 5, _ordered if k == "gate_m1" else _paired) for k, rule in GATES.items()},
    "gate_improvement": _improvement,
}

_MEDIANS = "meds AS (SELECT dataset, system AS mode, round(quantile_cont(goodput, 0.5), 6) AS median FROM f4 GROUP BY 1, 2)"
def _summary(keys: list[str], table: str) -> str:
    k = ", ".join(keys)
    return f"""s0 AS (SELECT {k}, count(*) AS repeats, count(*) FILTER (result = 'pass') AS passes, count(*) FILTER (result = 'blocked') AS blocked, count(*) FILTER (result LIKE 'fail%') AS fails, round(quantile_cont(goodput, 0.5), 6) AS median_goodput, min(goodput) AS min_goodput, max(goodput) AS max_goodput, arg_min(result, (repeat_index, line)) AS first FROM {table} GROUP BY {k}),
 s1 AS (SELECT *, CASE WHEN median_goodput > 0 THEN round((max_goodput - min_goodput) / median_goodput * 100, 3) ELSE 0.0 END AS spread_pct FROM s0),
 s AS (SELECT * EXCLUDE (first), spread_pct > 20 AS unstable, CASE WHEN fails > 0 THEN 'fail_runtime' WHEN blocked > 0 AND blocked = repeats THEN first WHEN spread_pct > 20 THEN 'inconclusive_unstable' WHEN passes = repeats THEN 'pass' WHEN blocked > 0 THEN 'partial_blocked' ELSE first END AS result FROM s1)"""


_SUMMARY = _summary(KEYS, "f4")
_PAIRED = """w AS (SELECT dataset, rep, first(seconds) FILTER (arm = 'F') AS a, first(seconds) FILTER (arm = 'O') AS b, first(wall_s) FILTER (arm = 'F') AS aw, first(wall_s) FILTER (arm = 'O') AS bw, sum(errors) AS e, min(digest) AS lo, max(digest) AS hi, bool_and(abs(read_s + send_s - seconds) <= 1e-6) AS p FROM f4p GROUP BY 1, 2), g AS (SELECT *, (a - b) / a * 100 AS gain FROM w),
 r AS (SELECT dataset, count(*) AS pairs, round(quantile_cont(a, 0.5), 6) AS a_median, round(quantile_cont(b, 0.5), 6) AS b_median, round(8589934592 * 8.0::DOUBLE / quantile_cont(a, 0.5) / 1e9, 6) AS a_gbps, round(8589934592 * 8.0::DOUBLE / quantile_cont(b, 0.5) / 1e9, 6) AS b_gbps, round(stddev_pop(a) / avg(a), 6) AS a_cv, round(stddev_pop(b) / avg(b), 6) AS b_cv, round(stddev_pop(aw) / avg(aw), 6) AS a_wall_cv, round(stddev_pop(bw) / avg(bw), 6) AS b_wall_cv, count(*) FILTER (gain > 0) AS improved_pairs, round(quantile_cont(gain, 0.5), 6) AS gain_pct, round(quantile_cont(a, 0.95), 6) AS a_p95, round(quantile_cont(b, 0.95), 6) AS b_p95, count(a) = count(*) AND count(b) = count(*) AND min(rep) = 1 AND max(rep) = count(*) AS reps_ok, min(lo) = max(hi) AS content_ok, sum(e)::BIGINT AS errors, bool_and(p) AS parts_ok FROM g GROUP BY 1)"""
_DRIFTED = "j AS (SELECT coalesce(a.relative_path, b.relative_path) AS path, CASE WHEN b.size IS NULL THEN 'missing' WHEN a.size IS NULL THEN 'extra' WHEN a.size <> b.size OR a.mtime_s <> b.mtime_s THEN 'changed' ELSE 'unchanged' END AS verdict, a.size AS manifest_size, b.size AS current_size, CASE WHEN b.size IS NULL THEN 'missing: ' || a.relative_path WHEN a.size IS NULL THEN 'extra: ' || b.relative_path WHEN a.size <> b.size OR a.mtime_s <> b.mtime_s THEN 'changed: ' || a.relative_path END AS message FROM f1 a FULL JOIN drift b ON a.relative_path = b.relative_path)"
_PROFILE = "SELECT dataset, count(*) AS files, sum(size)::BIGINT AS bytes, min(size) AS size_min, max(size) AS size_max, round(quantile_cont(size, 0.5), 6) AS size_p50, round(quantile_cont(size, 0.9), 6) AS size_p90, round(avg(size), 6) AS size_mean FROM f1 GROUP BY 1"
_STEPS = ", ".join(f"('{a}', '{b}')" for a, b in runs.LEASE_STEPS)
_LINE_OK = "NOT (" + " OR ".join(f"contains(lower(body), '{w}')" for w in records.STANDS_FOR) + " OR regexp_matches(body, '<[^<>]+>'))"

SQL = {
    "scan_listing": "SELECT split_part(relative_path, '/', 1) AS name, bool_or(contains(relative_path, '/')) AS is_dir, max(CASE WHEN contains(relative_path, '/') THEN 0 ELSE size END)::BIGINT AS size, max(mtime_s) AS mtime_s, '' AS folder FROM f1 GROUP BY 1 UNION ALL SELECT split_part(relative_path, '/', 2), true, 0, max(mtime_s), 'web' FROM f1 WHERE dataset = 'web' GROUP BY 1",
    "scan_metric_lines": "SELECT 'u' || user_id AS source, max(event_id) AS line_no, arg_max(event_id::VARCHAR, event_id) AS metric_id, arg_max(event_type, event_id) AS metric_type, arg_max(floor(value)::BIGINT::VARCHAR, event_id) AS metric_n FROM events GROUP BY 1",
    "path_validate": r"WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages UNION ALL SELECT page_id, url FROM pages), v AS (SELECT *, CASE WHEN coalesce(path, '') = '' THEN 'empty' WHEN regexp_matches(path, '^[/\\]') THEN 'not_relative' WHEN contains(path, '\') THEN 'backslash' WHEN regexp_matches(path, '[\x00-\x1f\x7f]') THEN 'control_character' WHEN regexp_matches(path, '^[A-Za-z]:') THEN 'drive_prefix' WHEN len(list_filter(string_split(path, '/'), lambda s: s IN ('', '.', '..'))) > 0 THEN 'bad_segment' END AS reason FROM p) SELECT *, reason IS NULL AS is_valid FROM v",
    "path_resolve": "SELECT file_id, CASE file_id % 5 WHEN 0 THEN '/home/' || relative_path WHEN 1 THEN '/home/u/a/' || relative_path WHEN 2 THEN '/' || relative_path WHEN 3 THEN '/' || relative_path ELSE '/home/u/' || relative_path END AS virtual_path, file_id % 5 = 2 AS escapes_root FROM f1",
    "sidecar_filter": "WITH s AS (SELECT file_id, relative_path || CASE file_id % 9 WHEN 0 THEN '.part.tmp' WHEN 1 THEN '.manifest' ELSE '' END AS relative_path FROM f1) SELECT *, 'by_name' AS form FROM s WHERE file_id % 9 <> 0 UNION ALL SELECT *, 'strict' FROM s WHERE NOT (file_id % 9 = 1 AND file_id % 4 = 2)",
    "transfer_id_validate": "SELECT file_id, CASE WHEN file_id % 6 = 0 THEN transfer_id || '/x' ELSE transfer_id END AS transfer_id, file_id % 6 <> 0 AS is_valid FROM f1",
    "normalize_results": "SELECT file_id, size * CASE file_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1000 WHEN 3 THEN 1048576 ELSE 1073741824 END AS bytes, lower(to_hex(file_id)) AS hex_id, strftime(make_timestamp((1700000000 + file_id) * 1000000), '%Y%m%d%H%M%S') AS stamp FROM f1",
    "error_classify": f"SELECT sequence, message, {records.error_sql('message')} AS error_code FROM f3",
    "message_redact": "SELECT sequence, 'PASS <redacted> then ' || message AS message FROM f3",
    "throughput": "SELECT sequence, round(CASE WHEN elapsed_seconds > 0 THEN bytes / elapsed_seconds ELSE 0 END, 3) AS bytes_per_second, round(CASE WHEN elapsed_seconds > 0 THEN bytes * 8 / elapsed_seconds / 1e9 ELSE 0 END, 9) AS gbps FROM f3",
    "link_bdp": "SELECT link_id, capacity * 1e9 * 0.02 / 8 AS bdp, greatest(capacity * 1e9 * 0.02 / 8 * 2, 4096.0) AS target_queue, round(ready_bytes / greatest(capacity * 1e9 * 0.02 / 8 * 2, 4096.0), 9) AS fill_ratio, ready_bytes > 2 * greatest(capacity * 1e9 * 0.02 / 8 * 2, 4096.0) AS pause FROM f5",
    "hygiene_scan": "WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS line_no, unnest(x) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), f AS (SELECT doc_id, line_no::INT AS line_no, unnest(list_filter([" + ", ".join("CASE WHEN regexp_matches(body, '{}') THEN '{}' END".format(p.replace("'", "''"), n) for n, p in records.HYGIENE) + f"], lambda x: x IS NOT NULL)) AS finding FROM l WHERE {_LINE_OK}) SELECT * FROM f",
    "resume_preflight": f"WITH {_DRIFTED} SELECT * FROM j",
    "resume_preflight_download": "SELECT m.relative_path AS path, CASE WHEN r.size IS NULL THEN 'remote_missing' WHEN r.size <> m.size OR r.mtime_s <> m.mtime_s THEN 'remote_changed' WHEN m.status = 'completed' AND m.file_id % 10 = 2 THEN 'local_missing' ELSE 'ok' END AS verdict FROM f1 m LEFT JOIN drift r ON m.relative_path = r.relative_path",
    "artifact_sync": f"WITH {_DRIFTED} SELECT verdict, count(*) AS files, sum(manifest_size)::BIGINT AS manifest_bytes, sum(current_size)::BIGINT AS current_bytes FROM j GROUP BY 1",
    "set_missing_extra": "SELECT relative_path, 'missing' AS side FROM (SELECT relative_path FROM f1 EXCEPT SELECT relative_path FROM drift) UNION ALL SELECT relative_path, 'extra' FROM (SELECT relative_path FROM drift EXCEPT SELECT relative_path FROM f1)",
    "set_union_sources": "SELECT relative_path, size, 'manifest' AS origin FROM f1 UNION ALL SELECT relative_path, size, 'current' FROM drift",
    "dup_paths": "SELECT dataset AS manifest_id, dataset || '/' || (file_id % 40) AS path, count(*) AS n FROM f1 GROUP BY 1, 2 HAVING count(*) > 1",
    "file_sha256": "SELECT doc_id AS file_id, strlen(text) AS size, sha256(text) AS sha256 FROM documents",
    "tree_hash_sha256": "SELECT source AS root, sha256(string_agg(source || '/' || doc_id || chr(0) || strlen(text) || chr(0) || sha256(text) || chr(0), '' ORDER BY source || '/' || doc_id)) AS tree_hash, count(*) AS file_count, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1",
    "chunk_conflicts": ack_fold("true", "file_id, chunk_id, begin, kind, count(*) AS acks", "AND kind <> 'accepted' GROUP BY 1, 2, 3, 4"),
    "manifest_status_counts": "SELECT dataset AS manifest_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'changed') AS changed, bool_and(status = 'completed') AS complete FROM f1 GROUP BY 1",
    "summary_compare": f"WITH {_summary(COMPARE_KEYS, 'f4k')} SELECT * FROM s",
    "summary_matrix": f"SELECT {', '.join(MATRIX_KEYS)}, count(*) AS repeats, count(*) FILTER (result = 'pass') AS passes, count(*) FILTER (result <> 'pass') AS fails, min(goodput) FILTER (result = 'pass') AS goodput_min, round(quantile_cont(goodput, 0.5) FILTER (result = 'pass'), 6) AS goodput_median, max(goodput) FILTER (result = 'pass') AS goodput_max, {', '.join(f"round(quantile_cont({c}, 0.5) FILTER (result = 'pass'), 6) AS {c}_median" for c in ('elapsed', *STAGES))} FROM f4k GROUP BY {', '.join(MATRIX_KEYS)}",
    "stage_describe": "SELECT system, dataset, count(goodput) AS count, round(sum(goodput), 4) AS sum, round(quantile_cont(goodput, 0.5), 6) AS p50, round(quantile_cont(goodput, 0.95), 6) AS p95, quantile_disc(goodput, 0.95) AS p95_rank, max(goodput) AS max FROM f4 GROUP BY 1, 2",
    "stage_share": "WITH x AS (SELECT system, dataset, sum(wait_s) AS wait_s, sum(write_s) AS write_s FROM f4 GROUP BY 1, 2), y AS (SELECT system, dataset, 'wait_s' AS stage, wait_s AS v, wait_s + write_s AS total, wait_s >= write_s AS d FROM x UNION ALL SELECT system, dataset, 'write_s', write_s, wait_s + write_s, write_s > wait_s FROM x) SELECT system, dataset, stage, round(v, 4) AS seconds, round(v / total, 6) AS share, d AS is_dominant FROM y",
    "phase_totals": "SELECT transfer_id AS run, CASE WHEN sequence % 2 = 0 THEN 'sender' ELSE 'receiver' END AS role, event AS phase, round(sum(elapsed_seconds), 4) AS seconds, sum(bytes)::BIGINT AS bytes, CASE WHEN sequence % 2 = 0 AND event = 'view' THEN 'source_read' WHEN sequence % 2 = 0 AND event = 'click' THEN 'network_send' WHEN sequence % 2 = 1 AND event = 'click' THEN 'temp_write' END AS alias FROM f3 GROUP BY 1, 2, 3, 6",
    "workload_profile": f"SELECT *, CASE WHEN bytes = 0 THEN 0 ELSE greatest(1, floor(bytes / files)) END::BIGINT AS estimated_min, CASE WHEN files <= 4 THEN bytes ELSE floor(bytes / files * 4) END::BIGINT AS estimated_max, round(bytes / files, 6) AS estimated_p50, round(greatest(bytes / files, CASE WHEN files <= 4 THEN bytes ELSE floor(bytes / files * 4) END), 6) AS estimated_p90 FROM ({_PROFILE})",
    "regime_classify": f"SELECT dataset, CASE WHEN files > 32 AND size_p50 < 65536 AND bytes < 5242880 THEN 'small_files' WHEN size_max >= 52428800 AND files <= 4 THEN 'large_objects' WHEN files > 10 AND size_p90 >= 1048576 THEN 'mixed' WHEN bytes >= 83886080 THEN 'bandwidth' ELSE 'general' END AS regime FROM ({_PROFILE})",
    "event_summary": f"SELECT error_code, count(*) AS events, min(sequence) AS first_sequence, arg_min(message, sequence) AS first_message FROM (SELECT *, {records.error_sql('message')} AS error_code FROM f3) GROUP BY 1",
    "sched_event_counts": "SELECT transfer_id AS run, CASE WHEN substr(transfer_id, 3)::BIGINT % 3 = 1 THEN substr(transfer_id, 3)::BIGINT + 1000 ELSE count(*) FILTER (event = 'click') END AS click, " + ", ".join(f"count(*) FILTER (event = '{e}') AS {e}" for e in SCHED[1:]) + " FROM f3 GROUP BY 1",
    "median_table": "SELECT arm, dataset, count(*) AS n, round(quantile_cont(seconds, 0.5), 6) AS median_s, min(seconds) AS min_s, max(seconds) AS max_s, count(*) = 7 AS n_ok FROM f4p GROUP BY 1, 2",
    "baseline_delta": f"WITH {_MEDIANS} SELECT m.dataset, m.mode, m.median, b.median AS baseline, CASE WHEN b.median > 0 THEN round((m.median - b.median) / b.median * 100, 6) END AS delta_pct FROM meds m LEFT JOIN meds b ON m.dataset = b.dataset AND b.mode = 'F'",
    "mode_compare": "WITH x AS (SELECT *, CASE retries % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'fixed' ELSE 'adaptive' END AS m FROM f4k WHERE NOT (dataset = 'A' AND direction = 'upload' AND retries % 3 = 0)), y AS (SELECT dataset, direction, " + ", ".join(f"round(quantile_cont({v}, 0.5) FILTER (m = '{m}'), 6) AS {m}_{v}" for m in ("off", "fixed", "adaptive") for v in ("goodput", "elapsed")) + " FROM x GROUP BY 1, 2) SELECT *, " + ", ".join(f"round({m}_{v} - off_{v}, 6) AS {m}_{v}_delta" for m in ("fixed", "adaptive") for v in ("goodput", "elapsed")) + " FROM y WHERE off_goodput IS NOT NULL AND coalesce(fixed_goodput, adaptive_goodput) IS NOT NULL",
    "best_config": "WITH s AS (SELECT direction, repeat_index % 997 AS config, round(quantile_cont(goodput, 0.5), 6) AS median FROM f4 GROUP BY 1, 2 HAVING count(*) FILTER (result LIKE 'fail%') = 0) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY direction ORDER BY median DESC, config) = 1",
    "top_slow": "SELECT repeat_index, line, goodput FROM f4 WHERE result = 'pass' ORDER BY goodput, repeat_index, line, system, dataset LIMIT 8",
    "top_unstable": f"WITH {_SUMMARY} SELECT system, dataset, direction, spread_pct FROM s WHERE unstable ORDER BY spread_pct DESC, system, dataset, direction LIMIT 24",
    "counter_delta": "WITH c AS (SELECT * FROM hourly WHERE NOT (host = 3 AND name = 'click' AND value > 20000) AND name <> 'signup'), d AS (SELECT *, (value - lag(value) OVER (PARTITION BY host, name ORDER BY ts))::BIGINT AS delta FROM c), n AS (SELECT host, ts, lead(ts) OVER (PARTITION BY host ORDER BY ts) AS following FROM (SELECT DISTINCT host, ts FROM c)) SELECT host, name, epoch_us(ts::TIMESTAMP) AS ts, delta, delta < 0 AS regressed FROM d WHERE delta IS NOT NULL UNION ALL SELECT c.host, c.name, epoch_us(following::TIMESTAMP), NULL, true FROM c JOIN n ON n.host = c.host AND n.ts = c.ts WHERE following IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c x WHERE x.host = c.host AND x.name = c.name AND x.ts = following)",
    "append_watermark": "WITH a AS (SELECT l_orderkey AS file_id, l_linenumber::BIGINT - 1 AS chunk_id, (l_linenumber::BIGINT - 1) * 1024 AS begin, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice, l_linenumber) AS seq FROM lineitem), b AS (SELECT *, max(begin) OVER w AS max_offset, max(chunk_id) OVER w AS max_chunk_id FROM a WINDOW w AS (PARTITION BY file_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT file_id, seq, max_offset, max_chunk_id, coalesce(begin > max_offset AND chunk_id > max_chunk_id, true) AS fast_path, greatest(coalesce(max_chunk_id, -1), chunk_id) + 1 AS next_id FROM b",
    "lease_transitions": f"""WITH a AS (SELECT *, count(*) FILTER (state = 'claimed') OVER w AS attempt FROM lease_io WINDOW w AS (PARTITION BY lease_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
        b AS (SELECT *, sum(io) OVER (PARTITION BY lease_id, attempt ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS balance FROM a),
        c AS (SELECT *, min(balance) OVER (PARTITION BY lease_id, attempt ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS least, lag(balance) OVER (PARTITION BY lease_id ORDER BY ts, event_id) AS was FROM b),
        d AS (SELECT *, lag(state) OVER (PARTITION BY lease_id ORDER BY ts, event_id) AS "from" FROM c WHERE state IS NOT NULL),
        e AS (SELECT lease_id, event_id, "from", state AS "to", balance, CASE state WHEN 'claimed' THEN coalesce(was, 0) <> 0 WHEN 'commit_pending' THEN balance <> 0 OR least < 0 WHEN 'completed' THEN balance <> 0 OR least < 0 ELSE false END AS undrained FROM d WHERE "from" IS NOT NULL)
        SELECT *, ("from", "to") IN ({_STEPS}) AND NOT undrained AS legal FROM e""",
    "queue_wait": "WITH c AS (SELECT lease_id, min(ts) AS start FROM lease WHERE state = 'claimed' GROUP BY 1), w AS (SELECT l.lease_id, min(epoch_us(l.ts::TIMESTAMP) - epoch_us(c.start::TIMESTAMP)) AS us FROM lease l JOIN c ON l.lease_id = c.lease_id WHERE l.state = 'in_flight' AND l.ts >= c.start GROUP BY 1) SELECT count(*) AS leases, round(quantile_cont(us, 0.5), 3) AS p50_us, round(quantile_cont(us, 0.95), 3) AS p95_us, max(us) AS max_us FROM w",
    "gate_ab": f"WITH {_PAIRED} SELECT * FROM r",
    "gate_observer": f"WITH {_PAIRED}, e AS (SELECT dataset, round(max(rep % 4 / CASE WHEN dataset = 'A' THEN 40.0 ELSE 20.0 END), 6) AS envelope_max, round(quantile_cont(rep % 4 / CASE WHEN dataset = 'A' THEN 40.0::DOUBLE ELSE 20.0::DOUBLE END, 0.5), 6) AS envelope_median FROM f4p WHERE arm = 'O' GROUP BY 1) SELECT dataset, envelope_max, envelope_median, CASE WHEN a_cv > 0.05 OR b_cv > 0.05 OR abs(gain_pct) > 5 THEN 'inconclusive' WHEN envelope_max < 0.1 THEN 'below_envelope' ELSE 'accepted' END AS verdict FROM r LEFT JOIN e USING (dataset)",
    **{k: f"WITH {_PAIRED}, v AS (SELECT *, CASE WHEN {first}pairs < 5 THEN 'pairs' WHEN NOT reps_ok THEN 'reps' WHEN NOT content_ok THEN 'content' WHEN NOT parts_ok THEN 'parts' END AS reason FROM r) SELECT dataset, pairs, improved_pairs, gain_pct, reason IS NULL AS valid, reason, CASE WHEN reason IS NOT NULL THEN 'invalid' WHEN {rule} THEN 'go' ELSE 'no_go' END AS verdict{more} FROM v" for k, rule in GATES.items() for first in ["dataset = 'N' AND pairs > 1 THEN 'order' WHEN " if k == 'gate_m1' else ''] for more in ["".join(f", CASE WHEN reason IS NOT NULL THEN 'invalid' WHEN {f} THEN 'go' ELSE 'no_go' END AS {n}" for n, f in FORMS.items()) if k == "gate_improvement" else ""]},
}
SQL = {k: sql(v) for k, v in SQL.items()}
