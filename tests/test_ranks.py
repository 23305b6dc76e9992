"""Ranks and quantiles by ranges against Spark's own and plain sorting."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from driftledger.operators import ranges, ranks, runs


@pytest.fixture(scope="module")
def measured(spark):
    """A group of almost all rows, a few small ones, one of nulls alone and one whose key is null; an outlier stretches the range."""
    rng = random.Random(3)
    rows = [("hot", 1, rng.random() * 1000, float(rng.randrange(5))) for _ in range(20_000)] + [("hot", 1, 1e15, None)]
    rows += [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), round(rng.gauss(0, 5), 1), None if rng.random() < 0.3 else 7.0) for _ in range(300)]
    rows += [("none", 1, None, None), ("one", 1, 3.0, -0.5)]
    return spark.createDataFrame(rows, "k string, j int, x double, y double").repartition(6)


def test_quantiles_equal_spark(measured):
    wanted = {"median": ("linear", 0.5), "p95": ("linear", 0.95), "rank": ("disc", 0.95), "least": ("disc", 0.0), "most": ("linear", 1.0)}
    found = ranks.quantiles(measured, ["k", "j"], {"x": F.col("x"), "y": F.col("y")}, wanted)
    own = lambda c: [F.percentile(c, F.lit(0.5)), F.percentile(c, F.lit(0.95)), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {c})"), F.min(c), F.max(c)]
    want = measured.groupBy("k", "j").agg(*own("x"), *own("y"))
    key = lambda r: (str(r[0]), str(r[1]))
    got, want = (sorted((tuple(r) for r in d.collect()), key=key) for d in (found, want))
    # A group without any value has no row here, nulls there.
    want = [r for r in want if any(x is not None for x in r[2:])]
    assert [key(r) for r in got] == [key(r) for r in want]
    assert all(a == b or abs(a - b) < 1e-9 * max(1, abs(b)) for g, w in zip(got, want, strict=True) for a, b in zip(g[2:], w[2:], strict=True) if (a is None) == (b is None) or pytest.fail(f"{g} {w}") if b is not None)
    sums = ranks.with_quantiles(measured.groupBy("k", "j").agg(F.count("x").alias("n")), measured, ["k", "j"], {"x": F.col("x")}, {"median": ("linear", 0.5)})
    assert {(r.k, r.j): (r.n, r.x_median) for r in sums.collect()}["none", 1] == (0, None) and sums.count() == len(want) + 1
    assert ranks.quantiles(measured.limit(0), ["k"], {"x": F.col("x")}, wanted).count() == 0


def test_what_is_counted_is_as_wide_as_two_numbers(measured, monkeypatch):
    """However many keys: a row for each value of each row goes through the count."""
    seen, own = [], ranks.placed
    monkeypatch.setattr(ranks, "placed", lambda rows, *rest: seen.append(rows.dtypes) or own(rows, *rest))
    wide = measured.withColumns({f"k{i}": F.col("k") for i in range(20)})
    keys = ["k", "j", *(f"k{i}" for i in range(20))]
    found = {tuple(r) for r in ranks.quantiles(wide, keys, {"y": F.col("y"), "x": F.col("x")}, {"least": ("disc", 0.0)}).select("k", "j", "x_least", "y_least").collect()}
    assert found == {tuple(r) for r in measured.groupBy("k", "j").agg(F.min("x"), F.min("y")).where("k IS NULL OR k <> 'none'").collect()}
    assert [t for _, t in seen[0]] == ["bigint", "double", "bigint"]


def test_few_groups_count_only_values_of_bins_that_hold_a_rank(measured, monkeypatch):
    """Before, each different value of a group was counted and put in order."""
    seen, own = [], ranks.placed
    monkeypatch.setattr(ranks, "placed", lambda rows, *rest: seen.append(rows.count()) or own(rows, *rest))
    found = {r.k: r.x_median for r in ranks.quantiles(measured, ["k"], {"x": F.col("x")}, {"median": ("linear", 0.5)}).collect()}
    assert found == {r.k: r.m for r in measured.groupBy("k").agg(F.percentile("x", F.lit(0.5)).alias("m")).where("m IS NOT NULL").collect()}
    assert seen[0] < measured.select("k", "x").distinct().count() / 20


@pytest.mark.parametrize("few", [0, 100])
def test_quantiles_of_odd_numbers(spark, monkeypatch, few):
    """Both ways, with and without bins: signs, zeros, the least and the greatest doubles, infinities and NaN."""
    monkeypatch.setattr(ranks, "FEW", few)
    big = sys.float_info.max
    rows = [("odd", x) for x in (-float("inf"), -big, -1.5, -1.25, -1e-300, -0.0, 0.0, 5e-324, 1e-300, 1.0, 1.0, 1.0000001, big, float("inf"), float("nan"))]
    rows += [("below", -1.0 - i / 100) for i in range(500)] + [("one", -3.0), ("same", 7.0), ("same", 7.0)]
    table = spark.createDataFrame(rows, "k string, x double").repartition(3)
    shares = [0.0, 0.1, 0.2, 0.37, 0.5, 0.66, 0.8, 0.9, 0.93, 1.0]
    found = ranks.quantiles(table, ["k"], {"x": F.col("x")}, {f"q{i}": ("disc", s) for i, s in enumerate(shares)})
    want = table.groupBy("k").agg(*(F.expr(f"percentile_disc({s}D) WITHIN GROUP (ORDER BY x)") for s in shares))
    plain = lambda d: sorted(repr([r[0], *(x + 0.0 for x in r[1:])]) for r in d.collect())  # noqa: E731, -0.0 is 0.0
    assert plain(found) == plain(want)


def test_places_are_spread_over_ranges(measured, spark):
    rows = measured.where("x IS NOT NULL").select(F.coalesce("k", F.lit("-")).alias("k"), "x").withColumn("id", F.monotonically_increasing_id())
    found = ranks.placed(rows, "k", ["x", "id"]).collect()
    for k in {r.k for r in found}:
        own = sorted((r.x, r.id, r.before) for r in found if r.k == k)
        assert [b for _, _, b in own] == list(range(len(own)))
        assert {r.whole for r in found if r.k == k} == {len(own)}


def test_interleaving_of_a_large_task(spark):
    rng = random.Random(1)
    items = [(t, i, w) for t, n, w in (("x", 5000, 7), ("y", 40, 1), ("z", 3, 0)) for i in rng.sample(range(10**6), n)]
    found = {(r.task_id, r["item"]): r.dispatch_no for r in ranges.interleave_weighted(spark.createDataFrame(items, "task_id string, item long, weight int").repartition(5)).collect()}
    order = []
    for t, w in (("x", 7), ("y", 1), ("z", 1)):
        own = sorted(i for u, i, _ in items if u == t)
        order += [(k // w, t, i) for k, i in enumerate(own)]
    assert found == {(t, i): n for n, (_, t, i) in enumerate(sorted(order), 1)}


def test_leases_must_drain_their_io(spark):
    events = [("claimed", 0), ("in_flight", 0), (None, 10), (None, -10), ("commit_pending", 0), ("completed", 0)]
    rows = [(1, i, s, io) for i, (s, io) in enumerate(events)]
    rows += [(2, i, s, io) for i, (s, io) in enumerate([("claimed", 0), ("in_flight", 5), ("commit_pending", 0), (None, -5), ("completed", 0)])]
    rows += [(3, i, s, io) for i, (s, io) in enumerate([("claimed", 0), ("in_flight", 5), ("reclaimable", 0), ("claimed", 0), ("in_flight", 0), ("commit_pending", 0)])]
    rows += [(4, i, s, io) for i, (s, io) in enumerate([("claimed", 0), ("in_flight", -5), (None, 5), ("commit_pending", 0)])]
    table = spark.createDataFrame([(k, i, i, s, io) for k, i, s, io in rows], "lease_id long, ts long, event_id long, state string, io long")
    found = {}
    for r in runs.lease_transitions(table).orderBy("lease_id", "event_id").collect():
        found.setdefault(r.lease_id, []).append((r.to, r.legal))
    assert found == {
        1: [("in_flight", True), ("commit_pending", True), ("completed", True)],
        2: [("in_flight", True), ("commit_pending", False), ("completed", True)],
        3: [("in_flight", True), ("reclaimable", True), ("claimed", False), ("in_flight", True), ("commit_pending", True)],
        4: [("in_flight", True), ("commit_pending", False)],
    }
    assert [r.legal for r in runs.lease_transitions(table.drop("io").where("lease_id = 3 AND state IS NOT NULL")).orderBy("event_id").collect()] == [True, True, True, True, True]
