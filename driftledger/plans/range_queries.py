"""Queries of the range algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftledger.operators import ranges

from .tables import Tables, sql

CHUNK, TOTAL = 1024, 7168
PLAN = {"chunk": 1024, "channels": 4, "rtt": 0.01, "bandwidth": 100_000.0, "disk": 200_000.0, "least": 1500, "overhead": 500}


def _stops(t: Tables):
    return t.f2.select("file_id", "begin", (F.col("begin") + F.col("length")).alias("stop"))


def _totals(t: Tables):
    return t.orders.select(F.col("o_orderkey").alias("file_id"), F.lit(TOTAL).cast("long").alias("total"))


def _plan(t: Tables):
    return _totals(t).withColumn("chunk_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))


QUERIES = {
    "plan_chunks": lambda t: ranges.plan_chunks(t.f1, CHUNK, 4),
    "plan_ranges_adaptive": lambda t: ranges.plan_ranges(t.f1, **PLAN),
    "plan_ranges_unified": lambda t: ranges.plan_ranges(t.f1, **PLAN, striped_only=False).select("file_id", "range_id", "begin", "length", "channel"),
    "plan_work_items": lambda t: ranges.plan_work_items(t.f1, 600, 2048),
    "assign_round_robin": lambda t: ranges.assign_round_robin(ranges.plan_ranges(t.f1, **PLAN), 3).select("file_id", "range_id", "worker"),
    "interleave_weighted": lambda t: ranges.interleave_weighted(t.f1.select(F.col("dataset").alias("task_id"), F.col("file_id").alias("item"), (F.length("dataset") - 3).alias("weight"))),
    "ranges_validate": lambda t: ranges.validate(t.f2, 6000),
    "ranges_overlap": lambda t: ranges.overlaps(t.f2v),
    "ranges_coalesce": lambda t: ranges.coalesce(t.f2v),
    "ranges_missing": lambda t: ranges.missing(t.f2v, _totals(t)),
    "coverage_check": lambda t: ranges.coverage(t.f2v, _totals(t)),
    "exact_cover": lambda t: ranges.exact_cover(_stops(t).withColumn("channel", F.expr("begin div 1024 % 3")), _totals(t).withColumn("expected", F.when(F.col("file_id") % 5 == 0, 4).otherwise(3))),
    "id_runs": lambda t: ranges.id_runs(_plan(t), t.f2, CHUNK),
    "progress_snapshot": lambda t: ranges.progress(_totals(t), t.f2, CHUNK),
    "interval_union_seconds": lambda t: ranges.union_seconds(t.stage, ["lane", "stage"]),
    "work_profile": lambda t: ranges.union_seconds(t.stage, ["lane"]),
    "interval_overlap": lambda t: ranges.overlap_seconds(t.stage.where("stage = 'view'"), t.stage.where("stage = 'click'"), "lane"),
}

_RANGES = """SELECT file_id, size, size > {th} AS striped,
    CASE WHEN size > {th} THEN ((greatest(1500, (size + 7) // 8) + 1023) // 1024) * 1024 ELSE 1024 END AS rs FROM f1""".format(th=6000)
_SO_FAR = "max(stop) OVER (PARTITION BY file_id ORDER BY begin, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_MERGED = "m0 AS (SELECT *, CASE WHEN {so} >= begin THEN 0 ELSE 1 END AS isnew FROM {src}), m1 AS (SELECT *, sum(isnew) OVER (PARTITION BY file_id ORDER BY begin, stop ROWS UNBOUNDED PRECEDING) AS island FROM m0), merged AS (SELECT file_id, min(begin) AS begin, max(stop) AS stop FROM m1 GROUP BY file_id, island)"
_MERGED_V = _MERGED.format(so=_SO_FAR, src="f2v")
_TOTALS = "totals AS (SELECT o_orderkey AS file_id, 7168::BIGINT AS total FROM orders)"


def _union(keys: list[str]) -> str:
    merged = _MERGED.format(so=_SO_FAR, src="src")
    packed = "{" + ", ".join(f"'{k}': {k}" for k in keys) + "}"
    names = ", ".join(f"s.file_id.{k} AS {k}" for k in keys)
    return f"WITH src0 AS (SELECT {packed} AS file_id, begin, stop FROM stage), src AS (SELECT * FROM src0 WHERE stop >= begin), {merged}, u AS (SELECT file_id, sum(stop - begin) AS u FROM merged GROUP BY 1), s AS (SELECT file_id, count(*) AS calls, sum(CASE WHEN stop >= begin THEN stop - begin ELSE 0 END)::BIGINT AS sum_us, count(*) FILTER (stop < begin) AS invalid FROM src0 GROUP BY 1) SELECT {names}, calls, sum_us, coalesce(u, 0)::BIGINT AS union_us, invalid FROM s LEFT JOIN u ON s.file_id = u.file_id"


SQL = {
    "plan_chunks": "SELECT file_id, k AS chunk_id, k * 1024 AS begin, least(1024, size - k * 1024) AS length, k % 4 AS stream FROM (SELECT file_id, size, unnest(range((size + 1023) // 1024)) AS k FROM f1)",
    "plan_ranges_adaptive": f"SELECT file_id, striped, rs AS range_size, k + 1 AS range_id, k * rs AS begin, least(rs, size - k * rs) AS length, k % 4 AS channel FROM (SELECT *, unnest(range((size + rs - 1) // rs)) AS k FROM ({_RANGES}) WHERE striped)",
    "plan_ranges_unified": f"SELECT file_id, k + 1 AS range_id, k * rs AS begin, least(rs, size - k * rs) AS length, k % 4 AS channel FROM (SELECT *, unnest(range((size + rs - 1) // rs)) AS k FROM ({_RANGES}))",
    "plan_work_items": "SELECT file_id, k AS item, k * 2048 AS begin, CASE WHEN k = n - 1 THEN size - k * 2048 ELSE 2048 END AS length, CASE WHEN status = 'pending' THEN 0 ELSE 1 END AS retry, k = 0 AS dispatchable FROM (SELECT *, unnest(range(n)) AS k FROM (SELECT *, CASE WHEN size <= 2048 THEN 1 WHEN size - ((size + 2047) // 2048 - 1) * 2048 < 600 THEN (size + 2047) // 2048 - 1 ELSE (size + 2047) // 2048 END AS n FROM f1 WHERE status NOT IN ('completed', 'changed')))",
    "assign_round_robin": f"SELECT file_id, k + 1 AS range_id, k % 3 AS worker FROM (SELECT *, unnest(range((size + rs - 1) // rs)) AS k FROM ({_RANGES}) WHERE striped)",
    "interleave_weighted": "SELECT task_id, item, row_number() OVER (ORDER BY r, task_id, item) AS dispatch_no FROM (SELECT dataset AS task_id, file_id AS item, (row_number() OVER (PARTITION BY dataset ORDER BY file_id) - 1) // greatest(length(dataset) - 3, 1) AS r FROM f1)",
    "ranges_validate": "SELECT *, length > 0 AND length <= 6000 - begin AS is_valid FROM f2",
    "ranges_overlap": f"SELECT * FROM (SELECT file_id, begin, stop, {_SO_FAR} AS previous_stop FROM f2v) WHERE previous_stop > begin",
    "ranges_coalesce": f"WITH {_MERGED_V} SELECT * FROM merged",
    "ranges_missing": f"WITH {_MERGED_V}, {_TOTALS}, a AS (SELECT t.file_id, total, coalesce(begin, total) AS begin, coalesce(stop, total) AS stop FROM totals t LEFT JOIN merged m ON t.file_id = m.file_id) SELECT * FROM (SELECT file_id, lag(stop, 1, 0) OVER (PARTITION BY file_id ORDER BY begin) AS begin, begin AS stop FROM a UNION ALL SELECT file_id, max(stop), total FROM a GROUP BY file_id, total) WHERE begin < stop",
    "coverage_check": f"WITH {_MERGED_V}, {_TOTALS}, g AS (SELECT *, coalesce({_SO_FAR} > begin, false) AS again FROM f2v), facts AS (SELECT file_id, max(stop) AS last, min(begin) AS first, bool_or(again) AS again FROM g GROUP BY 1), done AS (SELECT file_id, sum(stop - begin)::BIGINT AS done FROM merged GROUP BY 1) SELECT t.file_id, CASE WHEN last > total OR first < 0 THEN 'out_of_bounds' WHEN again THEN 'duplicate' WHEN coalesce(done, 0) < total THEN 'missing' WHEN total = 0 THEN 'empty' ELSE 'complete' END AS status, coalesce(done, 0) AS bytes_completed FROM totals t LEFT JOIN facts f ON t.file_id = f.file_id LEFT JOIN done d ON t.file_id = d.file_id",
    "exact_cover": f"WITH {_TOTALS}, a AS (SELECT file_id, begin, begin + length AS stop, begin = lag(begin + length, 1, 0) OVER (PARTITION BY file_id ORDER BY begin, length) AS ok FROM f2), facts AS (SELECT file_id, bool_and(ok) AS ok, max(stop) AS last, count(*) AS n, count(DISTINCT begin // 1024 % 3) AS ch FROM a GROUP BY 1) SELECT t.file_id, coalesce(ok AND last = total AND t.file_id % 5 <> 0, false) AS is_exact, coalesce(n, 0) AS ranges, coalesce(ch, 0) AS channels FROM totals t LEFT JOIN facts f ON t.file_id = f.file_id",
    "id_runs": "WITH p AS (SELECT o_orderkey AS file_id, unnest(range(7)) AS chunk_id FROM orders), l AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM f2 WHERE f2.file_id = p.file_id AND f2.chunk_id = p.chunk_id)), r AS (SELECT *, chunk_id - row_number() OVER (PARTITION BY file_id ORDER BY chunk_id) AS run FROM l) SELECT file_id, min(chunk_id) AS first_id, max(chunk_id) AS last_id, min(chunk_id) * 1024 AS begin, least((max(chunk_id) + 1) * 1024, 7168) AS stop FROM r GROUP BY file_id, run",
    "progress_snapshot": f"WITH {_TOTALS}, d AS (SELECT file_id, count(DISTINCT chunk_id) AS v, sum(length)::BIGINT AS b FROM f2 GROUP BY 1) SELECT t.file_id, CASE WHEN coalesce(v, 0) = 7 THEN 'complete' ELSE 'partial' END AS state, 7::BIGINT AS total_chunks, coalesce(v, 0) AS verified, 7 - coalesce(v, 0) AS missing, coalesce(b, 0) AS bytes, round(coalesce(v, 0) / 7.0::DOUBLE, 6) AS ratio FROM totals t LEFT JOIN d ON t.file_id = d.file_id",
    "interval_union_seconds": _union(["lane", "stage"]),
    "work_profile": _union(["lane"]),
    "interval_overlap": f"""WITH sa AS (SELECT lane AS file_id, begin, stop FROM stage WHERE stage = 'view'), sb AS (SELECT lane AS file_id, begin, stop FROM stage WHERE stage = 'click'),
        {_MERGED.format(so=_SO_FAR, src='sa').replace('m0', 'a0').replace('m1', 'a1').replace('merged', 'ma')}, {_MERGED.format(so=_SO_FAR, src='sb').replace('m0', 'b0').replace('m1', 'b1').replace('merged', 'mb')},
        o AS (SELECT ma.file_id, sum(least(ma.stop, mb.stop) - greatest(ma.begin, mb.begin)) AS o FROM ma JOIN mb ON ma.file_id = mb.file_id AND ma.begin < mb.stop AND mb.begin < ma.stop GROUP BY 1),
        wa AS (SELECT file_id, sum(stop - begin) AS w FROM ma GROUP BY 1), wb AS (SELECT file_id, sum(stop - begin) AS h FROM mb GROUP BY 1)
        SELECT coalesce(wa.file_id, wb.file_id) AS lane, coalesce(w, 0)::BIGINT AS wait_us, coalesce(h, 0)::BIGINT AS hold_us, coalesce(o, 0)::BIGINT AS overlap_us FROM wa FULL JOIN wb ON wa.file_id = wb.file_id LEFT JOIN o ON o.file_id = coalesce(wa.file_id, wb.file_id)""",
}
SQL = {k: sql(v) for k, v in SQL.items()}
