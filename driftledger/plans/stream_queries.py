"""Streams over the given tables, run until all files are taken, and their batch twins in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftledger.functions.workers import dealt
from driftledger.operators import records
from driftledger.streaming import flows, ordered

from .tables import MESSAGES, Tables, sql

CHUNK, TOTAL = 1024, 7168
HOUR = 3_600_000_000
#: A lease's time, a manifest's longest delay and its changes at most, and counters that should not rise.
LEASE, DELAY, CHANGES, ERRORS = 12 * HOUR, 12 * HOUR, 6, ("error",)
STATES = {"signup": "claimed", "view": "in_flight", "click": "commit_pending", "purchase": "completed"}


def _events(t: Tables) -> DataFrame:
    rows = flows.table_stream(t.spark, t.sf_dir, "events")
    state = F.lit("reclaimable")
    for event, name in STATES.items():
        state = F.when(F.col("event_type") == event, name).otherwise(state)
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % 16 + 1).cast("int"))
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("direction"), F.concat(F.lit("l"), F.col("user_id") % 8).alias("link"), F.concat(F.lit("t-"), "user_id").alias("transfer_id"), F.floor(F.col("value") * 1000).cast("long").alias("bytes"), F.floor("value").cast("long").alias("value"), message.alias("message"), state.alias("state"), F.col("user_id").alias("lease_id"))


def _acks(t: Tables) -> DataFrame:
    """Acknowledgements with a time; some under another id or at another offset."""
    line = F.col("l_linenumber").cast("long") - 1
    return flows.table_stream(t.spark, t.sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_shipdate").alias("ts"), (line + F.when(F.col("l_partkey") % 19 == 0, 1).otherwise(0)).alias("chunk_id"), (line * CHUNK + F.when(F.col("l_suppkey") % 13 == 0, 512).otherwise(0)).alias("begin"), F.lit(CHUNK).cast("long").alias("length"), (F.col("l_partkey") % 3).alias("crc"))


def _dedupe(t: Tables) -> DataFrame:
    found = flows.drained(ordered.in_time_order(_acks(t), ["file_id"], ["chunk_id", "begin", "length", "crc"], ordered.ack_steps(), ordered.ACK_OUT, "1 day"), "acks")
    return dealt(found, "file_id").groupBy("file_id", "chunk_id", "begin", "crc", "kind").agg(F.count(F.lit(1)).alias("acks"))


def _ranges(t: Tables) -> DataFrame:
    begin = (F.col("l_linenumber").cast("long") - 1) * CHUNK
    stop = F.least(begin + CHUNK + 256 * (F.col("l_quantity").cast("int") % 3), F.lit(TOTAL)).cast("long")
    return flows.table_stream(t.spark, t.sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), begin.alias("begin"), stop.alias("stop"))


def links(rows: DataFrame) -> DataFrame:
    """Link states of events, batch or stream."""
    return rows.select(F.col("user_id").alias("link_id"), "ts", "event_id", (F.col("value") % 5 / 2).alias("fill"), (F.col("value") % 11 / 12).alias("pressure"), F.floor(F.col("event_id") / 500).cast("long").alias("retries"))


def _counts(t: Tables) -> DataFrame:
    rows = flows.drained(_events(t), "event-counts", lambda b: flows.event_counts(b, records.error_code(F.col("message"))))
    return rows.groupBy("error_code").agg(F.sum("count").alias("count"))


def _throughput(t: Tables) -> DataFrame:
    return flows.closed_windows(flows.drained(_events(t), "throughput", lambda b: flows.throughput(b, "6 hours", "3 hours")), HOUR)


def _manifests(t: Tables) -> DataFrame:
    """Every published snapshot of each manifest; events stand for changes of status."""
    status = F.when(F.col("state") == "completed", "completed").when(F.col("state") == "reclaimable", "failed").when(F.col("state") == "commit_pending", "changed").otherwise("other")
    rows = _events(t).select((F.col("user_id") % 40).alias("manifest_id"), "ts", "event_id", status.alias("status"))
    return flows.drained(ordered.in_time_order(rows, ["manifest_id"], ["event_id", "status"], ordered.publication_steps(CHANGES, DELAY), ordered.MANIFEST_OUT, "1 hour"), "manifests").drop("batch")


def _leases(t: Tables) -> DataFrame:
    rows = ordered.in_time_order(_events(t), ["lease_id"], ["event_id", "state"], ordered.lease_steps(LEASE), ordered.LEASE_OUT, "1 hour")
    return flows.drained(rows, "leases").drop("batch").withColumn("expired", F.col("kind") == "expired")


def _alerts(t: Tables) -> DataFrame:
    rows = _events(t).select((F.col("user_id") % 5).alias("host"), F.col("direction").alias("name"), "ts", "event_id", "value")
    return flows.drained(ordered.in_time_order(rows, ["host", "name"], ["event_id", "value"], ordered.alert_steps(ERRORS), ordered.ALERT_OUT, "1 hour"), "alerts").drop("batch")


def totals(t: Tables) -> DataFrame:
    """Sizes of files; the last chunk of two in three is short."""
    return t.orders.select(F.col("o_orderkey").alias("file_id"), (TOTAL - 300 * (F.col("o_orderkey") % 3)).cast("long").alias("total"))


def _progress(t: Tables) -> DataFrame:
    """What the last batch that touched a file said of it; files without ranges have none."""
    rows = flows.drained(ordered.progress(_ranges(t).join(totals(t), "file_id")), "progress", mode="update")
    last = rows.groupBy("file_id").agg(F.max_by(F.struct("bytes", "ranges", "complete"), "batch").alias("last"))
    none = F.struct(F.lit(0).cast("long").alias("bytes"), F.lit(0).alias("ranges"), (F.col("total") == 0).alias("complete"))
    return totals(t).join(last, "file_id", "left").select("file_id", F.coalesce("last", none).alias("p")).select("file_id", "p.*")


def _sessions(t: Tables) -> DataFrame:
    rows = flows.merged_spans(flows.drained(_events(t), "sessions", lambda b: flows.spans(b, "transfer_id", "6 hours")), "transfer_id", HOUR)
    return rows.select("transfer_id", "start_us", "end_us", "events", "bytes", "late_events")


QUERIES = {
    "stream_event_counts": _counts,
    "stream_throughput": _throughput,
    "stream_chunk_dedupe": _dedupe,
    "stream_progress": _progress,
    "stream_lease": _leases,
    "stream_ramp": lambda t: flows.ramp_alerts(flows.drained(links(_events(t)), "ramp")),
    "stream_manifest_coalesce": _manifests,
    "stream_counter_alert": _alerts,
    "stream_transfer_sessions": _sessions,
}


def _spans(key: str, columns: str, names: str, hours: int) -> str:
    """Spans without a pause; those that the watermark, an hour behind the newest event, has passed."""
    return f"""WITH e AS (SELECT *, user_id AS lease_id, 't-' || user_id AS transfer_id, floor(value * 1000)::BIGINT AS bytes, epoch_us(ts::TIMESTAMP) AS us, {_STATE} AS state FROM events),
        n AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY {key} ORDER BY us, event_id) <= {hours}::BIGINT * 3600000000 THEN 0 ELSE 1 END AS isnew FROM e),
        i AS (SELECT *, sum(isnew) OVER (PARTITION BY {key} ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM n),
        g AS (SELECT {key}, min(us) AS start_us, max(us) + {hours}::BIGINT * 3600000000 AS stop_us, count(*) AS events, {columns} FROM i GROUP BY {key}, island)
        SELECT {names}, 0 AS late_events FROM g WHERE stop_us <= (SELECT max(us) FROM e) - 3600000000"""


_STATE = "CASE event_type WHEN 'signup' THEN 'claimed' WHEN 'view' THEN 'in_flight' WHEN 'click' THEN 'commit_pending' WHEN 'purchase' THEN 'completed' ELSE 'reclaimable' END"
#: Where the watermark ends up, an hour behind the newest event, in whole milliseconds.
_MARK = "(max(us) // 1000 - 3600000) * 1000"


def ack_fold(where: str, columns: str, then: str) -> str:
    """Acknowledgements one after the other against a list of those accepted before."""
    kind = "CASE WHEN len(list_filter(acc, lambda a: a.c = o.chunk_id AND a.b = o.begin AND a.l = o.length AND a.r = o.crc)) > 0 THEN 'duplicate' WHEN len(list_filter(acc, lambda a: a.c = o.chunk_id OR a.b = o.begin)) > 0 THEN 'conflict' WHEN len(list_filter(acc, lambda a: a.b < o.begin + o.length AND a.b + a.l > o.begin)) > 0 THEN 'overlap' ELSE 'accepted' END"
    return f"""WITH RECURSIVE o AS (SELECT * FROM clash WHERE {where}),
        s AS (SELECT file_id, 0::BIGINT AS seq, 0::BIGINT AS chunk_id, 0::BIGINT AS begin, 0::BIGINT AS length, 0::BIGINT AS crc, '' AS kind, [{{'c': 0::BIGINT, 'b': 0::BIGINT, 'l': 0::BIGINT, 'r': 0::BIGINT}}][:0] AS acc FROM o WHERE seq = 1
          UNION ALL SELECT file_id, seq, chunk_id, begin, length, crc, kind, CASE WHEN kind = 'accepted' THEN list_append(acc, {{'c': chunk_id, 'b': begin, 'l': length, 'r': crc}}) ELSE acc END
          FROM (SELECT o.file_id, o.seq, o.chunk_id, o.begin, o.length, o.crc, s.acc, {kind} AS kind FROM s JOIN o ON o.file_id = s.file_id AND o.seq = s.seq + 1))
        SELECT {columns} FROM s WHERE seq > 0 {then}"""


SQL = {
    "stream_event_counts": f"SELECT {records.error_sql('message')} AS error_code, count(*) AS count FROM f3 GROUP BY 1",
    "stream_throughput": """WITH e AS (SELECT epoch_us(ts::TIMESTAMP) AS us, 'l' || (user_id % 8) AS link, event_type AS direction, floor(value * 1000)::BIGINT AS bytes FROM events),
        w AS (SELECT *, (us // 10800000000 - back) * 10800000000 AS start_us FROM e, (VALUES (0), (1)) v(back)),
        g AS (SELECT start_us, link, direction, sum(bytes)::BIGINT AS bytes FROM w GROUP BY 1, 2, 3)
        SELECT *, round(bytes * 8.0::DOUBLE / 21600000000 / 1000, 9) AS gbps, 0 AS late_events FROM g WHERE start_us + 21600000000 <= (SELECT max(us) FROM e) - 3600000000""",
    "stream_chunk_dedupe": ack_fold("ts < (SELECT max(ts) FROM clash) - INTERVAL 1 DAY", "file_id, chunk_id, begin, crc, kind, count(*) AS acks", "GROUP BY 1, 2, 3, 4, 5"),
    "stream_progress": "WITH t AS (SELECT o_orderkey AS file_id, 7168 - 300 * (o_orderkey % 3) AS total FROM orders), r AS (SELECT f2v.file_id, begin, least(stop, total) AS stop, total FROM f2v JOIN t ON f2v.file_id = t.file_id AND begin < total), p AS (SELECT file_id, begin AS pos, 1 AS d FROM r UNION ALL SELECT file_id, stop, -1 FROM r), o AS (SELECT file_id, pos, sum(sum(d)) OVER (PARTITION BY file_id ORDER BY pos) AS open, lead(pos) OVER (PARTITION BY file_id ORDER BY pos) AS until FROM p GROUP BY file_id, pos), g AS (SELECT file_id, sum(until - pos) FILTER (open > 0) AS bytes, count(*) FILTER (open = 0) AS ranges FROM o GROUP BY 1) SELECT t.file_id, coalesce(bytes, 0)::BIGINT AS bytes, coalesce(ranges, 0)::INT AS ranges, coalesce(bytes, 0) = total AS complete FROM t LEFT JOIN g ON t.file_id = g.file_id",
    "stream_ramp": """WITH RECURSIVE o AS (SELECT user_id AS link_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, floor(value)::BIGINT % 5 / 2.0 AS fill, floor(value)::BIGINT % 11 / 12.0 AS pressure, event_id // 500 AS retries FROM events),
        s AS (SELECT link_id, 0::BIGINT AS event_id, 0::BIGINT AS n, 0::BIGINT AS seen, 0 AS lows, '' AS action, '' AS reason FROM o WHERE n = 1
          UNION ALL SELECT o.link_id, o.event_id, o.n, o.retries, CASE WHEN o.fill >= 2 OR o.pressure >= 0.75 OR o.retries > seen OR o.fill >= 0.5 OR lows = 1 THEN 0 ELSE 1 END,
            CASE WHEN o.fill >= 2 OR o.pressure >= 0.75 OR o.retries > seen THEN 'down' WHEN o.fill < 0.5 AND lows = 1 THEN 'up' ELSE 'hold' END,
            CASE WHEN o.fill >= 2 THEN 'high_watermark' WHEN o.pressure >= 0.75 THEN 'send_pressure' WHEN o.retries > seen THEN 'retry_pressure' WHEN o.fill < 0.5 AND lows = 1 THEN 'low_watermark' ELSE 'balanced' END
          FROM s JOIN o ON o.link_id = s.link_id AND o.n = s.n + 1)
        SELECT link_id, event_id, action, reason FROM s WHERE n > 0""",
    "stream_lease": f"""WITH RECURSIVE e AS (SELECT user_id AS lease_id, epoch_us(ts::TIMESTAMP) AS us, event_id, {_STATE} AS ev FROM events), m AS (SELECT {_MARK} AS mark FROM e),
        o AS (SELECT *, row_number() OVER (PARTITION BY lease_id ORDER BY us, event_id) AS n FROM e WHERE us < (SELECT mark FROM m)),
        s AS (SELECT DISTINCT lease_id, 0::BIGINT AS n, 0::BIGINT AS attempt, false AS held, '' AS st, 0::BIGINT AS deadline, 0::BIGINT AS events, 0::BIGINT AS us, '' AS ev, false AS lapsed, 0::BIGINT AS was_attempt, 0::BIGINT AS was_deadline, 0::BIGINT AS was_events, '' AS kind FROM e
          UNION ALL SELECT lease_id, on_, CASE WHEN kind = 'open' THEN attempt + 1 ELSE attempt END, kind IN ('open', 'step', 'io', 'illegal'), CASE WHEN kind IN ('open', 'step', 'io') THEN oev ELSE st END, CASE WHEN kind IN ('open', 'io') THEN ous + {LEASE} ELSE deadline END, CASE WHEN kind = 'open' THEN 1 WHEN kind IN ('step', 'io') THEN events + 1 ELSE events END, ous, oev, lapsed_now, attempt, deadline, events, kind
          FROM (SELECT *, CASE WHEN NOT live THEN CASE WHEN oev = 'claimed' THEN 'open' ELSE 'late' END WHEN oev = 'reclaimable' THEN 'reclaimed' WHEN st || '>' || oev IN ('claimed>in_flight', 'in_flight>commit_pending') THEN 'step' WHEN st = 'in_flight' AND oev = 'in_flight' THEN 'io' WHEN st = 'commit_pending' AND oev = 'completed' THEN 'completed' ELSE 'illegal' END AS kind
            FROM (SELECT s.lease_id, s.attempt, s.st, s.deadline, s.events, o.n AS on_, o.us AS ous, o.ev AS oev, s.held AND o.us < s.deadline AS live, s.held AND o.us >= s.deadline AS lapsed_now FROM s JOIN o ON o.lease_id = s.lease_id AND o.n = s.n + 1))),
        z AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lease_id ORDER BY n DESC) = 1),
        r AS (SELECT lease_id, was_attempt AS attempt, 'expired' AS kind, 'reclaimable' AS state, was_deadline AS at_us, was_deadline AS deadline_us, was_events AS events FROM s WHERE lapsed
          UNION ALL SELECT lease_id, attempt, kind, ev, us, deadline, events FROM s WHERE kind IN ('late', 'reclaimed', 'completed', 'illegal')
          UNION ALL SELECT lease_id, attempt, 'expired', 'reclaimable', deadline, deadline, events FROM z WHERE held AND deadline < (SELECT mark FROM m))
        SELECT *, kind = 'expired' AS expired FROM r""",
    "stream_manifest_coalesce": f"""WITH RECURSIVE e AS (SELECT user_id % 40 AS manifest_id, epoch_us(ts::TIMESTAMP) AS us, event_id, {_STATE} AS ev FROM events), m AS (SELECT {_MARK} AS mark FROM e),
        o AS (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY us, event_id) AS n, sum((ev = 'completed')::INT) OVER w AS completed, sum((ev = 'reclaimable')::INT) OVER w AS failed, sum((ev = 'commit_pending')::INT) OVER w AS changed FROM e WHERE us < (SELECT mark FROM m) WINDOW w AS (PARTITION BY manifest_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)),
        s AS (SELECT DISTINCT manifest_id, 0::BIGINT AS n, 0::BIGINT AS us, 0::BIGINT AS kept, 0::BIGINT AS dirty, false AS by_delay, false AS by_count, 0::BIGINT AS was, 0::BIGINT AS before, 0::BIGINT AS was_dirty FROM e
          UNION ALL SELECT manifest_id, on_, ous, CASE WHEN on_ - base >= {CHANGES} THEN on_ ELSE base END, CASE WHEN n = base THEN ous ELSE dirty END, lapsed, on_ - base >= {CHANGES}, base, kept, dirty
          FROM (SELECT *, CASE WHEN lapsed THEN n ELSE kept END AS base FROM (SELECT s.manifest_id, s.n, s.kept, s.dirty, o.n AS on_, o.us AS ous, s.n > s.kept AND o.us >= s.dirty + {DELAY} AS lapsed FROM s JOIN o ON o.manifest_id = s.manifest_id AND o.n = s.n + 1))),
        z AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY manifest_id ORDER BY n DESC) = 1),
        r AS (SELECT manifest_id, was_dirty + {DELAY} AS at_us, 'delay' AS reason, n - 1 AS generation, before AS persisted_generation FROM s WHERE by_delay
          UNION ALL SELECT manifest_id, us, 'threshold', n, was FROM s WHERE by_count
          UNION ALL SELECT manifest_id, dirty + {DELAY}, 'delay', n, kept FROM z WHERE n > kept AND dirty + {DELAY} < (SELECT mark FROM m))
        SELECT r.*, completed::BIGINT AS completed, failed::BIGINT AS failed, changed::BIGINT AS changed FROM r JOIN o ON o.manifest_id = r.manifest_id AND o.n = r.generation""",
    "stream_counter_alert": f"WITH e AS (SELECT *, epoch_us(ts::TIMESTAMP) AS us FROM events), d AS (SELECT user_id % 5 AS host, event_type AS name, event_id, us, (floor(value) - lag(floor(value)) OVER (PARTITION BY user_id % 5, event_type ORDER BY us, event_id))::BIGINT AS delta FROM e) SELECT host, name, event_id, delta, CASE WHEN delta < 0 THEN 'regression' ELSE 'error' END AS kind FROM d WHERE us < (SELECT {_MARK} FROM e) AND (delta < 0 OR delta > 0 AND name = 'error')",
    "stream_transfer_sessions": _spans("transfer_id", "sum(bytes)::BIGINT AS bytes", "transfer_id, start_us, stop_us AS end_us, events, bytes", 6),
}
SQL = {k: sql(v) for k, v in SQL.items()}
