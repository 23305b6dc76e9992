"""Stored tables and how they go."""

from pathlib import Path
from random import Random

import pytest
from pyspark.sql import functions as F

from driftledger.functions import workers
from driftledger.operators import ranges, verdicts
from driftledger.plans import registry


def test_release_removes_stored_tables(spark):
    table = workers.stored(spark.range(5), "some")
    root = Path(workers.shared_root(spark).removeprefix("file:"))
    assert table.count() == 5 and any(root.iterdir())
    workers.release(spark)
    assert root.is_dir() and not any(root.iterdir())
    assert workers.stored(spark.range(3), "some").count() == 3


@pytest.mark.parametrize("step", ["coalesce", "missing", "resume_stats", "reconcile"])
def test_ranges_of_files_keep_their_number_of_tasks(spark, step):
    """Adaptive execution would put all of these few bytes into one task, and very many rows of few bytes as well."""
    spans = spark.range(4000).selectExpr("id div 4 AS file_id", "id % 4 * 20 AS begin", "id % 4 * 20 + 10 AS stop", "10L AS length")
    totals = spark.range(1000).selectExpr("id AS file_id", "100L AS total")
    found = {"coalesce": lambda: ranges.coalesce(spans), "missing": lambda: ranges.missing(spans, totals), "resume_stats": lambda: verdicts.resume_stats(totals, spans), "reconcile": lambda: verdicts.reconcile(spans, spans)}[step]()
    told = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(told) >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(r["count"] for r in told) == {"coalesce": 4000, "missing": 4000}.get(step, 1000)


@pytest.mark.parametrize("step, sorts", [("coalesce", 1), ("reconcile", 3)])
def test_ranges_of_files_are_held_by_sorts_alone(spark, capsys, step, sorts):
    """Tables of a task's files and ranges and lists of them took most of its memory, and were sorted again."""
    spans = spark.range(4000).selectExpr("id div 4 AS file_id", "id % 4 * 20 AS begin", "id % 4 * 20 + 10 AS stop")
    found = {"coalesce": lambda: ranges.coalesce(spans), "reconcile": lambda: verdicts.reconcile(ranges.coalesce(spans), spans)}[step]()
    found.explain()
    plan = capsys.readouterr().out
    assert "Aggregate" not in plan and plan.count("- Sort [") == sorts


def _merged(rows):
    """By the definition, a range at a time; rows without a begin or stop come first."""
    low = lambda x: (x is not None, x or 0)
    found, past = [], None
    for begin, stop in sorted(rows, key=lambda r: (low(r[0]), low(r[1]))):
        if None in (past, begin) or past < begin:
            found.append([begin, stop])
        else:
            found[-1] = [begin if found[-1][0] is None else found[-1][0], max((x for x in (found[-1][1], stop) if x is not None), default=None)]
        past = max((x for x in (past, stop) if x is not None), default=None)
    return sorted(map(tuple, found), key=str)


def test_odd_ranges_are_merged_and_reconciled_by_the_definition(spark):
    """Nulls, negative lengths, repeated ranges and files of one side alone, against a plain loop."""
    random = Random(7)
    one = lambda: (random.choice([None, *range(12)]), random.choice([None, *range(14)])) if random.random() < 0.3 else (b := random.randrange(30), b + random.randrange(5))
    chunks = {k: [one() for _ in range(random.randrange(1, 9))] for k in range(400)}
    kept = {k: (_merged(chunks[k]) if k in chunks else [one()]) for k in range(20, 420)}
    for k in range(20, 420):
        if k % 4 == 0:  # one more, one less or another
            kept[k] = [kept[k] + kept[k][:1], kept[k][1:] or [(99, 100)], kept[k][1:] + [(kept[k][0][0], 77)]][k // 4 % 3]
            random.shuffle(kept[k])
    frame = lambda d: spark.createDataFrame([(k, *r) for k, rows in d.items() for r in rows], "file_id long, begin long, stop long")
    found = {}
    for r in ranges.coalesce(frame(chunks)).collect():
        found.setdefault(r.file_id, []).append((r.begin, r.stop))
    assert {k: sorted(v, key=str) for k, v in found.items()} == {k: _merged(v) for k, v in chunks.items()}
    told = verdicts.reconcile(frame(kept), frame(chunks)).collect()
    assert len(told) == 420
    assert {r.file_id: r.matches for r in told} == {k: k in chunks and k in kept and sorted(kept[k], key=str) == _merged(chunks[k]) for k in range(420)}
    assert 200 < sum(r.matches for r in told) < 400


def test_chunks_of_resumed_files_keep_their_number_of_tasks(spark):
    """As the query joins them with their files' sizes before they are merged; a join of tables too large to send to all."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        found = registry.QUERIES["resume_stats"](spark, "/root/testdata/sf0.001")
        assert len({r.part for r in found.withColumn("part", F.spark_partition_id()).collect()}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_counted_acknowledgements_keep_their_number_of_tasks(spark):
    """A file's acknowledgements pack to a few bytes, so tasks sized by bytes would count very many."""
    found = registry.QUERIES["stream_chunk_dedupe"](spark, "/root/testdata/sf0.001")
    assert len(found.groupBy(F.spark_partition_id()).count().collect()) == int(spark.conf.get("spark.sql.shuffle.partitions"))
