"""Branches of verdicts that the given tables don't reach."""

import pytest
from pyspark.sql import functions as F

from driftledger.operators import integrity, profiles, ranges, runs, verdicts


def test_depths(spark):
    rows = [("up", d, r, 10.0 * (d + 1) + r) for d in (0, 1, 2) for r in (0, 1, 2) if (d, r) != (2, 1)] + [("down", 1, r, None if r == 2 else 5.0) for r in (0, 1, 2)]
    runs = spark.createDataFrame(rows, "direction string, depth int, repeat int, goodput double")
    external = spark.createDataFrame([("up", r, 42.0) for r in (0, 1, 2)], "direction string, repeat int, goodput double")
    got = {(r.direction, r.depth): (r.status, r.detail, r.ratio, r.delta) for r in verdicts.depth_compare(external, runs, 3).collect()}
    assert got == {("up", 1): ("COMPLETE", "", 0.5, round(21 / 11 - 1, 6)), ("up", 2): ("INCOMPLETE", "repeats", None, None), ("down", 1): ("INCOMPLETE", "valid", None, None)}


def test_population(spark):
    members = spark.createDataFrame([(s, "open" if s == "b" else "committed", 4) for s in "abcde" for _ in range(3 if s == "c" else 2)], "slot string, state string, total_size long")
    trees = spark.createDataFrame([(s, "m", p, "failed" if s == "d" else "completed") for s in "abcd" for p in ("x", "y")], "slot string, manifest_id string, relative_path string, status string")
    assert {r.slot: r.reason for r in verdicts.population(members, trees, 2, 4).collect()} == {"a": None, "b": "member_state", "c": "member_count", "d": "tree_status", "e": "tree_count"}


def test_hash_reuse(spark):
    schema = "root string, relative_path string, size long, mtime_s long"
    before = spark.createDataFrame([(r, p, 1, 1) for r in "abcd" for p in ("x", "y")], schema)
    now = spark.createDataFrame([("a", "x", 1, 1), ("a", "y", 1, 1), ("b", "x", 1, 1), ("c", "x", 1, 1), ("c", "y", 2, 1), ("d", "x", 1, 1), ("d", "y", 1, 1), ("d", "y", 1, 1), ("e", "x", 1, 1)], schema)
    assert {r.root: r.reason for r in verdicts.hash_reuse(before, now).collect()} == {"a": None, "b": "removed", "c": "changed", "d": "repeated", "e": "added"}


def test_least_loaded_takes_turns_and_skips_unhealthy(spark):
    links = spark.createDataFrame([("a", 200, 1, True), ("b", 100, 1, True), ("c", 200, 2, True), ("d", 0, 1, False)], "link_id string, ready_bytes long, capacity long, healthy boolean")
    items = spark.createDataFrame([(i,) for i in range(4)], "index long")
    assert {r["index"]: r.link_id for r in verdicts.least_loaded(items, links).collect()} == {0: "b", 1: "c", 2: "b", 3: "c"}
    assert verdicts.least_loaded(items, links.where("NOT healthy")).count() == 0


def test_presets_break_ties_by_name(spark):
    presets = [{"name": n, "streams": 1, "pipeline": 1, "handshakes": 1} for n in ("b", "a")]
    row = verdicts.preset_costs(spark.createDataFrame([("d", 4, 100)], "dataset string, files long, bytes long"), presets, 1.0, 1000.0).first()
    assert (row.preset, row.dominant, row.t_job) == ("a", "meta", 6.1)


def test_plan_and_order(spark):
    planned, expected = (spark.createDataFrame([(c,) for c in t], "case string") for t in ("aabx", "abc"))
    assert {r.case: r.finding for r in verdicts.plan_check(planned, expected, ["case"]).collect()} == {"a": "duplicate", "c": "missing", "x": "extra"}
    runs = spark.createDataFrame([(e, i, arm) for e, arms in (("ok", "ABBAA"), ("no", "ABAB")) for i, arm in enumerate(arms)], "experiment string, seq int, arm string")
    assert {r.experiment: r.in_order for r in verdicts.interleaved(runs, "ABBA").collect()} == {"ok": True, "no": False}


def test_hash_reuse_wants_chunks_that_cover(spark):
    files = spark.createDataFrame([(r, "x", n) for r, n in (("a", 20), ("b", 20), ("c", 20), ("d", 0), ("e", 20))], "root string, relative_path string, size long")
    chunks = [("a", "x", 0, 10), ("a", "x", 10, 10), ("b", "x", 0, 10), ("b", "x", 0, 10), ("c", "x", 0, 10), ("c", "x", 12, 8), ("e", "x", 0, 20), ("e", "gone", 0, 5)]
    found = verdicts.hash_reuse(files, files, spark.createDataFrame(chunks, "root string, relative_path string, begin long, length long"))
    assert {r.root: (r.reusable, r.reason) for r in found.collect()} == {"a": (True, None), "b": (False, "not_covered"), "c": (False, "not_covered"), "d": (True, None), "e": (False, "left_over")}


def test_changed_details_of_paths_with_spaces_and_prefixes(spark):
    tail = " manifest_size=1 manifest_mtime=2 current_size=3 current_mtime=x"
    rows = [(1, "source changed: my dir/a b.txt" + tail), (2, "restart failed: source changed: f" + tail), (3, "f" + tail + " current_size=9"), (4, "source changed: f")]
    found = verdicts.changed_details(spark.createDataFrame(rows, "transfer_id long, message string")).collect()
    assert {r.transfer_id: (r.changed_path, r.manifest_size, r.manifest_mtime, r.current_size, r.current_mtime) for r in found} == {1: ("my dir/a b.txt", 1, 2, 3, None), 2: ("f", 1, 2, 3, None), 3: ("f", 1, 2, 9, None)}


def test_goodput_that_counts(spark):
    rows = [("pass", "true", None, "5"), ("pass", "True", "pass", "5"), ("pass", "true", "", "5"), ("fail", "true", "pass", "5"), ("pass", "false", "pass", "5"), ("pass", None, "pass", "5"), ("pass", "true", "fail", "5"), *(("pass", "true", "pass", v) for v in ("NaN", "Infinity", "-Infinity", "0", "-1", "", "x", None))]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, result string, match string, integrity string, value string")
    c = F.col
    found = table.select("i", verdicts.valid_goodput(c("result"), c("match"), c("integrity"), c("value")).alias("v")).orderBy("i").collect()
    assert [r.v for r in found] == [5.0] * 3 + [None] * 12


def test_best_passing_leaves_failures_out(spark):
    rows = spark.createDataFrame([("up", "a", 9.0, 1), ("up", "b", 5.0, 0), ("up", "c", 5.0, 0), ("down", "a", 1.0, 2)], "direction string, config string, median double, fails long")
    assert [tuple(r) for r in verdicts.best_passing(rows, "direction", "config", "median").collect()] == [("up", "b", 5.0)]


def test_counters_that_are_missing_between_snapshots(spark):
    at = lambda h: f"2024-01-01 {h:02}:00:00"
    rows = [(1, n, at(h), v) for h, seen in enumerate(("ab", "ab", "a", "abc", "ab")) for n, v in zip(seen, (h, 10 - h, 1), strict=False)]
    found = runs.counter_delta(spark.createDataFrame(rows, "host int, name string, ts string, value long").withColumn("ts", F.to_timestamp("ts")))
    hour = lambda us: (us // 3_600_000_000) % 24
    assert sorted((hour(r.ts), r.name) for r in found.collect() if r.delta is None and r.regressed) == [(2, "b"), (4, "c")]
    assert sorted((hour(r.ts), r.name, r.delta) for r in found.collect() if r.delta is not None) == [(1, "a", 1), (1, "b", -1), (2, "a", 1), (3, "a", 1), (3, "b", -2), (4, "a", 1), (4, "b", -1)]
    assert found.where("name = 'b' AND delta IS NOT NULL AND NOT regressed").count() == 0


def test_a_chunk_recorded_twice_is_kept_if_one_is_right(spark):
    files = spark.createDataFrame([(1, bytearray(b"x" * 30))], "file_id long, content binary")
    crcs = {r.chunk_id: r.crc for r in integrity.crc32c_chunks(files, 10).collect()}
    chunks = [(1, 0, crcs[0]), (1, 0, crcs[0] ^ 1), (1, 1, crcs[1] ^ 1), (1, 2, crcs[2]), (1, 2, crcs[2])]
    r = integrity.chunk_verify(files, spark.createDataFrame(chunks, "file_id long, chunk_id long, crc long"), 10).first()
    assert (r.kept, r.removed_corrupt, r.missing, r.verified_bytes, r.kept_ranges, r.missing_ranges) == (2, 2, 0, 20, 2, 1)


def test_exact_cover_wants_its_channels(spark):
    rows = spark.createDataFrame([(f, b, b + 5, c) for f, cs in ((1, "ab"), (2, "aa"), (3, "ab")) for b, c in zip((0, 5), cs, strict=True)], "file_id long, begin long, stop long, channel string")
    totals = spark.createDataFrame([(1, 10, 2), (2, 10, 2), (3, 11, 2), (4, 0, 0)], "file_id long, total long, expected int")
    assert {r.file_id: (r.is_exact, r.channels) for r in ranges.exact_cover(rows, totals).collect()} == {1: (True, 2), 2: (False, 1), 3: (False, 2), 4: (True, 0)}


BACKEND = "direction string, checksum string, dataset string, backend string, median double, repeats long, fails long, spread_pct double"


@pytest.mark.parametrize(
    ("change", "decision"),
    [({}, "continue"), ({"median": 10.9}, "pause"), ({"repeats": 2}, "incomplete"), ({"fails": 1}, "incomplete"), ({"spread_pct": 25.1}, "unstable"), ({"storage": 10.5}, "pause")],
)
def test_backend_gate(spark, change, decision):
    keys = [(d, c) for d in ("up", "down") for c in ("crc", "none")]
    rows = []
    for k, (d, c) in enumerate(keys):
        own = {"median": 12.0, "repeats": 3, "fails": 0, "spread_pct": 5.0} | ({x: v for x, v in change.items() if x != "storage"} if k == 2 else {})
        rows += [(d, c, "x", "ring", *own.values()), (d, c, "x", "posix", 10.0, 1, 3, 90.0)]
    storage = spark.createDataFrame([("w", "ring", change.get("storage", 11.0)), ("w", "posix", 10.0)], "operation string, backend string, median double")
    found = verdicts.backend_gate(spark.createDataFrame(rows, BACKEND), storage, ["direction", "checksum"], ["dataset"], ["operation"], keys, "ring", "posix").first()
    assert found.decision == decision


def test_order_of_arms_is_a_precondition(spark):
    rows = [(e, p, arm, 10.0 - (arm == "B"), 0, "d", s) for e, turn in (("ok", 0), ("no", 1)) for p in (1, 2) for arm, s in zip("AB" if (p % 2 == 1) != (turn and p == 2) else "BA", (2 * p, 2 * p + 1), strict=True)]
    table = spark.createDataFrame(rows, "experiment string, pair int, arm string, seconds double, errors int, digest string, seq int")
    report = runs.paired_gate(table, "experiment", "pair", "arm", ("A", "B"), "seconds", 1, seq="seq")
    assert {r.experiment: r.reason for r in runs.gate(report, "true", 2).collect()} == {"ok": None, "no": "order"}


def test_modes_schedules_and_rollups(spark):
    table = spark.createDataFrame([("k", "off", 1.0), ("k", "fixed", 3.0), ("k", "fixed", 5.0), ("m", "fixed", 1.0), ("n", "off", 1.0)], "k string, mode string, v double")
    assert [tuple(r) for r in runs.mode_deltas(table, ["k"], "mode", "off", ["fixed", "adaptive"], ["v"]).collect()] == [("k", 1.0, 4.0, None, 3.0, None)]
    events = spark.createDataFrame([("r", "retry"), ("r", "retry"), ("r", "ramp"), ("s", "retry")], "run string, event string")
    told = spark.createDataFrame([("r", 7, 0), ("t", 3, 0)], "run string, retry int, ramp int")
    assert {tuple(r) for r in runs.sched_counts(events, told, ["retry", "ramp"]).collect()} == {("r", 7, 1), ("s", 1, 0), ("t", 3, 0)}
    rows = spark.createDataFrame([("a", "2", 1), ("a", "?", 0), ("a", "", 0), ("b", "0", 1), ("b", None, 0)], "source string, fail_count string, usual int")
    assert {tuple(r) for r in verdicts.rollup(rows, "source", F.col("usual") == 1).collect()} == {("a", 3, 3, 1, "fail"), ("b", 2, 0, 1, "pass")}


def test_observer_and_observations(spark):
    report = spark.createDataFrame([("a", 1.0, 0.01, 0.01), ("b", 1.0, 0.01, 0.01), ("c", 9.0, 0.01, 0.01)], "e string, gain_pct double, a_cv double, b_cv double")
    parts = spark.createDataFrame([("a", 0.05), ("a", 0.09), ("b", 0.2), ("c", 0.01)], "e string, fraction double")
    assert {r.e: r.verdict for r in verdicts.observer_gate(report, parts, "e").collect()} == {"a": "below_envelope", "b": "accepted", "c": "inconclusive"}
    rows = spark.createDataFrame([("a", True, True), ("b", True, True), ("b", True, False), ("c", False, None), ("d", True, None)], "source string, parsed boolean, enabled boolean")
    sources = spark.createDataFrame([(x,) for x in "abcde"], "source string")
    assert {r.source: r.status for r in verdicts.observation_status(rows, sources).collect()} == {"a": "complete", "b": "partial", "c": "missing", "d": "partial", "e": "missing"}


def test_host_and_cpu_changes(spark):
    zero = dict.fromkeys(profiles.TICKS, 0)
    row = lambda at, pid, cpu, **k: {"run": 1, "ts": f"2024-01-01 00:00:0{at}", "event_id": at, "pid": pid, "cpu": cpu, **zero, "tx_bytes": 0, "rx_bytes": 0, "cpu_ticks": 0, "read_bytes": 0, "write_bytes": 0, "fds": 0, "rss": 0} | k
    rows = [row(0, 1, 0, user=10, idle=10), row(1, 2, 1, cpu_ticks=5, rss=9), row(3, 2, 1, cpu_ticks=7, softirq=3, idle=1), row(4, 1, 0, user=16, idle=12, iowait=1, softirq=1, tx_bytes=10**9, cpu_ticks=4, fds=3)]
    table = spark.createDataFrame(rows).withColumn("ts", F.to_timestamp("ts"))
    host = profiles.host_metrics(table).first()
    assert (host.tx_delta, host.tx_gbps, host.cpu_lower_bound, host.peak_fds, host.peak_rss) == (10**9, 2.0, 6, 3, 9)
    assert (host.busy_fraction, host.iowait_fraction) == (0.7, 0.1)
    assert [(r.cpu, r.busy_fraction, r.softirq_fraction) for r in profiles.cpu_delta(table).orderBy("rank").collect()] == [(1, 0.75, 0.75), (0, 0.7, 0.1)]


def test_referenced_logs(spark):
    rows = spark.createDataFrame([("a.log", "/abs", "../x", "n", " e "), ("a.log", "", None, "m", "f")], "run_log string, abs_log string, up_log string, name string, evidence string")
    assert sorted(r.path for r in verdicts.referenced(rows, ("evidence",)).collect()) == ["a.log", "e", "f"]


def test_final_policy_wants_a_flushed_manifest(spark):
    rows = spark.createDataFrame([(1, "complete", 5, 5, True), (2, "complete", 5, 5, False), (3, "complete", 5, 5, None), (4, "missing", 4, 5, True)], "file_id long, status string, bytes_completed long, total long, flushed boolean")
    assert {r.file_id: r.effective_policy for r in verdicts.final_verify(rows, "verified_chunks", "crc32c").collect()} == {1: "verified_chunks", 2: "full", 3: "full", 4: "full"}


def test_resume_facts_of_ranges_beyond_the_total(spark):
    totals = spark.createDataFrame([(1, 100), (2, 100), (3, 0), (4, 100)], "file_id long, total long")
    chunks = spark.createDataFrame([(1, 10, 20), (1, 30, 10), (1, 90, 30), (2, 0, 100)], "file_id long, begin long, length long")
    assert {tuple(r) for r in verdicts.resume_stats(totals, chunks).collect()} == {(1, 3, 60, 60, 60, 2), (2, 1, 100, 100, 0, 0), (3, 0, 0, 0, 0, 0), (4, 0, 0, 0, 100, 1)}
