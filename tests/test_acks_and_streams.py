"""Acknowledgements and keyed streams: known answers, folds over all rows, and files in any order."""

import random

import pytest
from pyspark.sql import functions as F

from driftledger.operators import acks
from driftledger.streaming import flows, ordered

ACKS = "file_id long, seq long, chunk_id long, begin long, length long, crc long"


@pytest.mark.parametrize(
    ("rows", "kinds"),
    [
        ([(0, 0, 10, 1), (0, 0, 10, 1)], ["accepted", "duplicate"]),
        ([(0, 0, 10, 1), (0, 0, 10, 2)], ["accepted", "conflict"]),
        ([(0, 0, 10, 1), (0, 10, 10, 1)], ["accepted", "conflict"]),  # one id at two offsets
        ([(0, 0, 10, 1), (1, 0, 10, 1)], ["accepted", "conflict"]),  # one offset under two ids
        ([(0, 0, 10, 1), (1, 5, 10, 1)], ["accepted", "overlap"]),
        ([(0, 0, 10, 1), (1, 10, 10, 1), (2, 19, 1, 1), (3, 20, 5, 1)], ["accepted", "accepted", "overlap", "accepted"]),
        # What isn't accepted counts for nothing later: chunk 2 may have what chunk 1 failed to get.
        ([(0, 0, 10, 1), (0, 20, 10, 1), (2, 20, 10, 1), (2, 20, 10, 1)], ["accepted", "conflict", "accepted", "duplicate"]),
    ],
)
def test_first_accepted_wins(spark, rows, kinds):
    table = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], ACKS)
    assert [r.kind for r in acks.ack_kinds(table).orderBy("seq").collect()] == kinds
    step = ordered.ack_steps()
    memory, out, _ = step((1,), None, [[i, *r] for i, r in enumerate(rows)], 10**9)
    assert [r[-1] for r in out] == kinds


@pytest.mark.parametrize("stretch", [64, 1])
def test_acks_in_rounds_equal_a_fold(spark, monkeypatch, stretch):
    monkeypatch.setattr(acks, "STRETCH", stretch)
    rng = random.Random(5)
    rows = [(f, seq, rng.randrange(12), rng.randrange(30) * 5, rng.choice([5, 5, 10, 20]), rng.randrange(2)) for f in range(20) for seq in range(rng.randrange(40))]
    found = {(r.file_id, r.seq): r.kind for r in acks.ack_kinds(spark.createDataFrame(rows, ACKS)).collect()}
    want = {}
    for f in range(20):
        own = sorted(r[1:] for r in rows if r[0] == f)
        for r, o in zip(own, ordered.ack_steps()((f,), None, [list(r) for r in own], 0)[1], strict=True):
            want[f, r[0]] = o[-1]
    assert found == want and set(want.values()) == {"accepted", "duplicate", "conflict", "overlap"}
    assert acks.ack_kinds(spark.createDataFrame([], ACKS)).count() == 0


@pytest.mark.parametrize(("few", "check_ids"), [(0, True), (15, True), (64, True), (0, False), (64, False)])
def test_acks_in_lists_and_in_rounds_equal_a_fold(spark, monkeypatch, few, check_ids):
    """Files of few acknowledgements are decided in one pass, others in rounds; where all are small no round is stored."""
    monkeypatch.setattr(acks, "FEW", few)
    seen, own = [], acks.stored
    monkeypatch.setattr(acks, "stored", lambda rows, name: seen.append(name) or own(rows, name))
    rng = random.Random(11)
    rows = [(f, seq, rng.randrange(12), rng.randrange(30) * 5, rng.choice([5, 5, 10, 20]), rng.randrange(2)) for f in range(20) for seq in range(rng.randrange(40))]
    rows += [(f, 100 + i, *r[2:]) for f in range(20) for i, r in enumerate(r for r in rows if r[0] == f and r[1] % 4 == 0)]
    found = {(r.file_id, r.seq): r.kind for r in acks.ack_kinds(spark.createDataFrame(rows, ACKS), check_ids).collect()}
    want, taken = {}, {}
    for f, seq, c, b, n, crc in rows:
        held = taken.setdefault(f, [])
        kind = "duplicate" if (c, b, n, crc) in held else "conflict" if any(b == x[1] or check_ids and c == x[0] for x in held) else "overlap" if any(x[1] < b + n and b < x[1] + x[2] for x in held) else "accepted"
        want[f, seq] = kind
        held += [(c, b, n, crc)] if kind == "accepted" else []
    assert found == want and set(want.values()) == {"accepted", "duplicate", "conflict", "overlap"}
    assert ("told" in seen) == (few < 64)


SECOND = 1_000_000


def lease(*rows, until):
    """Kinds, times in seconds and states of a lease of 10 seconds, all rows taken at once."""
    memory, out, wake = ordered.lease_steps(10 * SECOND)((7,), None, [[t * SECOND, i, s] for i, (t, s) in enumerate(rows)], until * SECOND)
    return [(r[2], r[4] // SECOND, r[3]) for r in out], None if wake is None else wake // SECOND


def test_lease_expires_and_a_late_completion_does_not_revive_it():
    assert lease((0, "claimed"), until=10) == ([], 10)
    assert lease((0, "claimed"), until=11) == ([("expired", 10, "reclaimable")], None)
    assert lease((0, "claimed"), (1, "in_flight"), (9, "in_flight"), until=19) == ([], 19)  # drained IO puts it off
    assert lease((0, "claimed"), (1, "in_flight"), (2, "commit_pending"), (3, "completed"), until=30) == ([("completed", 3, "completed")], None)
    rows = [(0, "claimed"), (1, "in_flight"), (2, "commit_pending"), (12, "completed"), (13, "claimed"), (14, "completed")]
    assert lease(*rows, until=20) == ([("expired", 10, "reclaimable"), ("late", 12, "completed"), ("illegal", 14, "completed")], 23)


def test_manifests_are_published_by_number_and_by_delay():
    step = ordered.publication_steps(3, 10 * SECOND)
    rows = [[t * SECOND, t, "completed"] for t in (0, 1, 2, 3, 30)]
    held, out, wake = step((1,), None, rows, 35 * SECOND)
    assert [(r[1] // SECOND, r[2], r[3], r[4]) for r in out] == [(2, "threshold", 3, 0), (13, "delay", 4, 3)] and wake == 40 * SECOND
    assert step((1,), held, [], 41 * SECOND)[1] == [(1, 40 * SECOND, "delay", 5, 4, 5, 0, 0)]


def test_counter_alerts():
    step = ordered.alert_steps(("drops",))
    assert step((1, "drops"), None, [[0, 1, 5], [1, 2, 7], [2, 3, 6]], 0) == (6, [(1, "drops", 2, 2, "error"), (1, "drops", 3, -1, "regression")], None)
    assert step((1, "other"), 6, [[0, 1, 9]], 0)[:2] == (9, [])


def in_files(spark, rows, path, files, late):
    """``rows`` (time in milliseconds first) in files by time, each row up to ``late`` seconds too late, files shuffled within that."""
    rng = random.Random(len(rows))
    order = sorted(rows, key=lambda r: r[0] + rng.random() * late * 1000)
    schema = "ts timestamp, " + "key long, event_id long, value long, state string"
    size = -(-len(order) // files)
    for k in range(files):
        part = order[k * size : (k + 1) * size]
        rng.shuffle(part)
        frame = spark.createDataFrame(part, "ms long, key long, event_id long, value long, state string")
        frame.select(F.timestamp_millis("ms").alias("ts"), "key", "event_id", "value", "state").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 7).parquet(path)


def test_streams_of_shuffled_files_equal_one_pass(spark, tmp_path):
    rng = random.Random(1)
    states = ["claimed", "in_flight", "in_flight", "commit_pending", "completed", "reclaimable"]
    rows = [(rng.randrange(4_000_000), rng.randrange(6), k, rng.randrange(50), rng.choice(states)) for k in range(800)]
    stream = in_files(spark, rows, f"{tmp_path}/in", 40, 100)
    # Whole milliseconds of the newest time less the delay.
    mark = (max(r[0] for r in rows) - 200_000) * 1000
    cases = [
        (ordered.lease_steps(100 * SECOND), ordered.LEASE_OUT, ["event_id", "state"], lambda r: r[4]),
        (ordered.publication_steps(5, 50 * SECOND), ordered.MANIFEST_OUT, ["event_id", "state"], lambda r: r[4]),
    ]
    for step, out, columns, last in cases:
        found = flows.drained(ordered.in_time_order(stream.withColumnRenamed("key", "k"), ["k"], columns, step, out, "200 seconds"), "shuffled").drop("batch").collect()
        want = []
        for key in range(6):
            own = sorted([r[0] * 1000, r[2], last(r)] for r in rows if r[1] == key)
            want += step((key,), None, [r for r in own if r[0] < mark], mark)[1]
        assert sorted(map(tuple, found)) == sorted(want) and want


def test_progress_of_shuffled_files_equals_merged_ranges(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f, 1000, b, min(1200, b + rng.randrange(1, 90))) for f in range(30) for b in (rng.randrange(1000) for _ in range(60))]
    rows += [(99, 50, 0, 20), (99, 50, 20, 70), (98, 50, 60, 70)]
    rng.shuffle(rows)
    schema = "file_id long, total long, begin long, stop long"
    spark.createDataFrame(rows, schema).repartition(40).write.parquet(f"{tmp_path}/in")
    out = flows.drained(ordered.progress(spark.readStream.schema(schema).option("maxFilesPerTrigger", 6).parquet(f"{tmp_path}/in")), "progress", mode="update").collect()
    last = {}
    for r in sorted(out, key=lambda r: r.batch):
        last[r.file_id] = (r.bytes, r.ranges, r.complete)
    want = {}
    for f, total in {(r[0], r[1]) for r in rows}:
        spans = ordered.merged([(b, min(s, total)) for g, _, b, s in rows if g == f and b < total])
        want[f] = (sum(s - b for b, s in spans), len(spans), spans == [(0, total)])
    assert last == want
    done = [r.file_id for r in out if r.completed_now]
    assert len(done) == len(set(done)) and set(done) == {f for f, w in want.items() if w[2]} and 99 in done


def test_a_key_of_many_rows_is_taken_in_slices(spark, tmp_path):
    """What waits isn't Python values: a step sees no more than a slice of a large key at once, in order, and remembers what was before."""
    n = 40_000

    def counted(key, seen, rows, watermark):
        return (seen or 0) + len(rows), [(key[0], len(rows), (seen or 0) + len(rows), rows[0][1], rows[-1][1])] if rows else [], None

    for k, frame in enumerate((spark.range(n, 0, -1), spark.range(n + 500_000, n + 500_001))):
        frame.select(F.timestamp_millis("id").alias("ts"), F.lit(1).cast("long").alias("k"), "id").coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    stream = spark.readStream.schema("ts timestamp, k long, id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = "k long, rows long, seen long, first long, last long"
    found = sorted(map(tuple, flows.drained(ordered.in_time_order(stream, ["k"], ["id"], counted, out, "1 second"), "sliced").drop("batch").collect()), key=lambda r: r[2])
    assert found[-1][2] == n and max(r[1] for r in found) <= 16384
    assert [r[3] for r in found] == [1, *(r[4] + 1 for r in found[:-1])]
