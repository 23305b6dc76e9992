"""The engine's tables, derived from the given ones, in Spark and as SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Failure messages, one of each error class, and two that succeed.  Fixed values.
MESSAGES = [
    "", "please login first", "530 login incorrect", "tls is required here", "data channel tls required", "ssl handshake broke",
    "data ssl alert", "path escapes root", "manifest is corrupt", "checksum mismatch in chunk", "source changed during transfer",
    "remote sync incomplete", "unexpected frame type", "value must be positive", "cannot open socket", "something else",
]

#: SQL of each table that both systems run.
_COMMON = {
    "f3": "SELECT event_id AS sequence, ts, 't-' || user_id AS transfer_id, event_type AS event, CASE WHEN event_type = 'error' THEN 'fail' ELSE 'ok' END AS result, CAST(floor(value * 1000) AS BIGINT) AS bytes, value / 100 AS elapsed_seconds, CASE event_id % 16 {cases} END AS message FROM events",
    "f2": "SELECT DISTINCT l_orderkey AS file_id, CAST(l_linenumber AS BIGINT) - 1 AS chunk_id, (CAST(l_linenumber AS BIGINT) - 1) * 1024 AS begin, CAST(1024 AS BIGINT) AS length FROM lineitem",
    "f2v": "SELECT DISTINCT l_orderkey AS file_id, (CAST(l_linenumber AS BIGINT) - 1) * 1024 AS begin, least((CAST(l_linenumber AS BIGINT) - 1) * 1024 + 1024 + 256 * (CAST(l_quantity AS INT) % 3), 7168) AS stop FROM lineitem",
    "acks": "SELECT l_orderkey AS file_id, CAST(l_linenumber AS BIGINT) - 1 AS chunk_id, (CAST(l_linenumber AS BIGINT) - 1) * 1024 AS begin, CAST(1024 AS BIGINT) AS length, CAST(round(l_extendedprice * 100) AS BIGINT) AS crc FROM lineitem",
    "clash": "SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ts, chunk_id, begin, length, crc) AS seq FROM (SELECT l_orderkey AS file_id, l_shipdate AS ts, CAST(l_linenumber AS BIGINT) - 1 + CASE WHEN l_partkey % 19 = 0 THEN 1 ELSE 0 END AS chunk_id, (CAST(l_linenumber AS BIGINT) - 1) * 1024 + CASE WHEN l_suppkey % 13 = 0 THEN 512 ELSE 0 END AS begin, CAST(1024 AS BIGINT) AS length, l_partkey % 3 AS crc FROM lineitem)",
    "f4": "SELECT l_linestatus AS system, l_returnflag AS dataset, CAST(l_linenumber AS INT) % 2 AS direction, l_orderkey AS repeat_index, CAST(l_linenumber AS INT) AS line, CAST(l_extendedprice AS DOUBLE) AS goodput, CAST(l_discount AS DOUBLE) AS wait_s, CAST(l_tax AS DOUBLE) AS write_s, CASE WHEN l_quantity = 50 THEN 'fail_runtime' WHEN l_quantity = 49 THEN 'blocked' ELSE 'pass' END AS result FROM lineitem",
    "f4p": "SELECT l_linenumber AS rep, l_linestatus AS arm, l_returnflag AS dataset, round(avg(CAST(l_extendedprice AS DOUBLE)), 2) AS seconds, round(avg(CAST(l_extendedprice AS DOUBLE)), 2) * 0.25 AS read_s, round(avg(CAST(l_extendedprice AS DOUBLE)), 2) * 0.75 AS send_s, round(avg(CAST(l_quantity AS DOUBLE)), 2) AS wall_s, sum(CASE WHEN l_quantity = 50 AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS errors, CASE WHEN l_linenumber = 7 AND l_returnflag = 'N' THEN 'other' ELSE 'same' END AS digest FROM lineitem GROUP BY 1, 2, 3",
    "f4k": "SELECT l_linestatus AS system, CASE CAST(l_linenumber AS INT) % 2 WHEN 0 THEN 'upload' ELSE 'download' END AS direction, l_returnflag AS dataset, CASE l_suppkey % 2 WHEN 0 THEN 'base' ELSE 'tuned' END AS stage, 1 + l_partkey % 2 AS file_parallelism, 4 AS per_file_connections, 8 AS control_pipeline_depth, CASE l_partkey % 2 WHEN 0 THEN 'global' ELSE 'fixed' END AS scheduler, 'fair' AS scheduler_policy, CASE l_suppkey % 2 WHEN 0 THEN 'posix' ELSE 'ring' END AS file_io_backend, 32 AS queue_depth, 16 AS batch_size, l_linestatus AS mode, l_returnflag AS side, 'write' AS operation, 1048576 AS bytes, 4 AS connections, 1024 AS chunk_size, 65536 AS buffer_size, 'crc32c' AS checksum_algorithm, 'table' AS checksum_backend, l_partkey % 2 = 0 AS preallocate, 262144 AS file_io_buffer_size, 32 AS file_io_queue_depth, 16 AS file_io_batch_size, 'none' AS file_io_advice, 'direct' AS posix_write_strategy, 'direct' AS posix_write_strategy_effective, 'chunks' AS manifest_flush_policy, 64 AS manifest_flush_interval_chunks, 'end' AS commit_sync_policy, 'verified_chunks' AS final_verify_policy, CASE l_suppkey % 2 WHEN 0 THEN 'verified_chunks' ELSE 'full' END AS final_verify_policy_effective, l_orderkey AS repeat_index, CAST(l_linenumber AS INT) AS line, CAST(l_extendedprice AS DOUBLE) AS goodput, CAST(l_quantity AS DOUBLE) AS elapsed, CAST(l_tax AS DOUBLE) AS stage_read_seconds, CAST(l_discount AS DOUBLE) AS stage_write_seconds, CAST(l_discount AS DOUBLE) + CAST(l_tax AS DOUBLE) AS file_io_wait_seconds, CAST(l_quantity AS DOUBLE) * 2 AS stage_read_calls, CAST(l_quantity AS DOUBLE) * 3 AS stage_write_calls, CAST(l_extendedprice AS DOUBLE) / 2 AS stage_read_avg_bytes_per_call, CAST(l_extendedprice AS DOUBLE) / 4 AS stage_write_avg_bytes_per_call, CAST(l_tax AS DOUBLE) / 2 AS stage_manifest_flush_seconds, CAST(l_discount AS DOUBLE) / 2 AS stage_final_verify_seconds, CAST(l_tax AS DOUBLE) / 4 AS stage_rename_commit_seconds, CAST(l_quantity AS DOUBLE) + 1 AS stage_overall_seconds, l_suppkey % 7 <> 0 AS hash_match, CASE l_partkey % 3 WHEN 0 THEN 'cpu' WHEN 1 THEN 'receiver_write' ELSE 'balanced' END AS bottleneck, CAST(l_linenumber AS INT) AS retries, CASE WHEN l_quantity = 50 THEN 'fail_runtime' WHEN l_quantity = 49 THEN 'blocked' ELSE 'pass' END AS result FROM lineitem",
    "f5": "SELECT s_name AS link_id, 1 + s_nationkey AS capacity, CAST(floor(abs(s_acctbal)) AS BIGINT) AS ready_bytes, s_suppkey % 5 <> 0 AS healthy FROM supplier",
}
_COMMON["f3"] = _COMMON["f3"].format(cases=" ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MESSAGES)))
#: Those whose functions have other names in DuckDB.
_SPARK = {
    "f1": "SELECT doc_id AS file_id, concat('doc-', doc_id) AS transfer_id, source AS dataset, concat(source, '/', lang, '/', doc_id, '.txt') AS relative_path, CAST(octet_length(text) AS BIGINT) AS size, 1700000000 + doc_id AS mtime_s, CASE doc_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'transferring' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'changed' END AS status FROM documents",
    "stage": "SELECT user_id AS lane, event_type AS stage, unix_micros(CAST(ts AS TIMESTAMP)) AS begin, unix_micros(CAST(ts AS TIMESTAMP)) + CAST(floor(value * 60000000) AS BIGINT) AS stop FROM events",
}
_DUCK = {
    "f1": _SPARK["f1"].replace("octet_length", "strlen"),
    "stage": "SELECT user_id AS lane, event_type AS stage, epoch_us(CAST(ts AS TIMESTAMP)) AS begin, epoch_us(CAST(ts AS TIMESTAMP)) + CAST(floor(value * 60000000) AS BIGINT) AS stop FROM events",
}
_DRIFT = "SELECT relative_path, size + CASE WHEN file_id % 11 = 0 THEN 1 ELSE 0 END AS size, mtime_s + CASE WHEN file_id % 13 = 0 THEN 60 ELSE 0 END AS mtime_s FROM f1 WHERE file_id % 7 <> 0 UNION ALL SELECT concat('extra/', file_id), size, mtime_s FROM f1 WHERE file_id % 17 = 0"
#: Snapshots by the hour: what each counter of a host was last in it.
_HOURLY = "SELECT user_id % 5 AS host, event_type AS name, date_trunc('HOUR', ts) AS ts, {last}(CAST(floor(value * 100) AS BIGINT) + event_id, {at}) AS value FROM events GROUP BY 1, 2, 3"
_COUNTER = "SELECT user_id % 5 AS host, event_type AS name, ts, event_id, CASE WHEN event_id % 50 = 0 THEN CAST(floor(value) AS BIGINT) ELSE sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id % 5, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END AS value FROM events"
_LEASE = "SELECT user_id AS lease_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'claimed' WHEN 'view' THEN 'in_flight' WHEN 'click' THEN 'commit_pending' WHEN 'purchase' THEN 'completed' ELSE 'reclaimable' END AS state FROM events"
#: Leases with the IO between their steps: what a flight starts, an event of the same lease finishes.
_LEASE_IO = "SELECT user_id AS lease_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'claimed' WHEN 'view' THEN CASE WHEN event_id % 3 <> 0 THEN 'in_flight' END WHEN 'click' THEN 'commit_pending' WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'completed' END ELSE 'reclaimable' END AS state, CAST(CASE WHEN event_type = 'view' AND event_id % 4 <> 0 THEN 10 WHEN event_type = 'purchase' AND event_id % 2 <> 0 THEN -10 ELSE 0 END AS BIGINT) AS io FROM events"
SPARK = _COMMON | _SPARK | {"drift": _DRIFT, "counter": _COUNTER, "lease": _LEASE, "lease_io": _LEASE_IO, "hourly": _HOURLY.format(last="max_by", at="struct(ts, event_id)")}
DUCK = _COMMON | _DUCK | {"drift": _DRIFT, "counter": _COUNTER, "lease": _LEASE, "lease_io": _LEASE_IO, "hourly": _HOURLY.format(last="arg_max", at="(ts, event_id)")}
BASE = ("documents", "pages", "lineitem", "events", "supplier", "orders", "conversations")


class Tables:
    """Attribute access to the engine's tables over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in SPARK:
            raise AttributeError(name)
        text = SPARK[name]
        used = {n: getattr(self, n) for n in (*BASE, "f1") if n != name and f" {n}" in text}
        return self.spark.sql(_braced(text, used), **used)


def _braced(text: str, used: dict) -> str:
    for n in used:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}")
    return text


def sql(body: str) -> str:
    """``body`` with the tables that it names before it, as DuckDB runs it."""
    words = set(re.findall(r"\b\w+\b", body))
    names = [n for n in DUCK if n in words or n == "f1" and "drift" in words]
    names.sort(key=lambda n: n != "f1")
    ctes = ", ".join(f"{n} AS ({DUCK[n]})" for n in names)
    body = body.strip()
    if not ctes:
        return body
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.startswith("WITH ") else f"WITH {ctes} {body}"
