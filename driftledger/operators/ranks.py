"""Ranks and exact quantiles of groups of any size: ordered in ranges, never a group in one task."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from driftledger.functions.workers import stored

#: Up to so many groups, bins are counted before values.
FEW = 10_000
#: Bins of values from one power of two to the next.
BINS = 64


def placed(rows: DataFrame, group: str | None, order: list[str], weight: str | None = None) -> DataFrame:
    """``rows`` with ``before``: the weight (default 1 a row) of those of their group that come earlier in ``order``, and ``whole``, the group's.

    Rows are dealt to ranges of group and order, so a group of very many is in many
    ranges.  What each range holds of a group is summed first; a row adds what is before it in its range.
    Rows alike in ``order`` may come either way.
    """
    keys = [group] if group else []
    w = F.col(weight) if weight else F.lit(1).cast("long")
    ranged = stored(rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*keys, "__part").agg(F.sum(w).alias("__sum"), F.min(F.struct(*order)).alias("__first"))
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    # A row for each range that holds a part of the group.
    starts = sums.select(*keys, "__part", F.coalesce(F.sum("__sum").over(by.orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"), F.sum("__sum").over(by).alias("whole"))
    inside = F.coalesce(F.sum(w).over(Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("__inside", inside).join(starts, [*keys, "__part"]).withColumn("before", F.col("__inside") + F.col("__start")).drop("__part", "__inside", "__start")


def quantiles(rows: DataFrame, keys: list[str], values: dict[str, Column], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact quantiles of each group: ``keys`` and ``{value}_{name}`` for each value and each wanted ``name``.

    ``wanted`` says the kind, ``linear`` (between the two nearest ranks) or ``disc`` (the value of the
    least rank that covers the share), and the share.  Null values don't count; a group without any has nulls.
    Null keys are a group of their own.
    """
    if not keys:
        return _by_number(rows.select(F.lit(0).cast("long").alias("__id"), _measured(values)), 1, values, wanted).drop("__id")
    groups, n = _with_ids(rows.select(*keys).distinct())
    found = _by_number(_numbered(rows, groups, keys, values), n, values, wanted)
    return groups.join(found, "__id").drop("__id")


def with_quantiles(sums: DataFrame, rows: DataFrame, keys: list[str], values: dict[str, Column], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """``sums``, a row for each group of ``rows``, with the groups' quantiles; null keys meet."""
    groups, n = _with_ids(sums)
    found = _by_number(_numbered(rows, groups, keys, values), n, values, wanted)
    return groups.join(found, "__id", "left").drop("__id")


def _with_ids(groups: DataFrame) -> tuple[DataFrame, int]:
    """``groups`` with ``__id``, and how many they are; those of few groups are numbers from 0 without gaps."""
    groups = stored(groups.withColumn("__id", F.monotonically_increasing_id()), "groups")
    n = groups.count()
    return stored(groups.coalesce(1).withColumn("__id", F.monotonically_increasing_id()), "groups") if n <= FEW else groups, n


def _measured(values: dict[str, Column]) -> Column:
    return F.array(*(v.cast("double") for v in values.values())).alias("__m")


def _numbered(rows: DataFrame, groups: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """``__id`` of each row's group and its values, so that what is counted later is numbers, however many keys there are."""
    group = F.struct(*keys).alias("__g")
    return rows.select(group, _measured(values)).join(groups.select(group, "__id"), "__g").select("__id", "__m")


def _ranks(wanted: dict[str, tuple[str, float]]) -> dict[str, tuple[Column, Column, Column]]:
    """Of each wanted quantile the ranks on both sides of it and the part of the way between them, by ``whole``."""
    found, last = {}, F.col("whole") - 1
    for name, (kind, share) in wanted.items():
        place = last * F.lit(float(share)) if kind == "linear" else F.greatest(F.ceil(F.col("whole") * F.lit(float(share))) - 1, F.lit(0))
        found[name] = (F.floor(place), F.ceil(place), place - F.floor(place))
    return found


def _bin(x: Column) -> Column:
    """A number that doesn't fall as ``x`` grows: the power of two that it is, in steps of 1 / ``BINS``; NaN is in the last."""
    power = F.floor(F.log2(F.least(F.abs(x), F.lit(sys.float_info.max))) * BINS).cast("int") + 2048 * BINS
    return F.when(x < 0, -power).when(x > 0, power).otherwise(0)


def _counted(long: DataFrame, few: bool, ranks: list[Column]) -> DataFrame:
    """``of``, ``x``, its rows ``n``, those ``before`` it and ``whole``: of all values, or of few groups only the bins that hold one of ``ranks``.

    Few groups have very many rows and values each, so bins are counted first, and
    rows of other bins are never shuffled.  What is left is ordered in ranges in both cases, however much a bin holds.
    """
    n = F.count(F.lit(1)).alias("n")
    if not few:
        return placed(long.groupBy("of", "x").agg(n), "of", ["x"], "n")
    # Two numbers of 32 bits are one key of the join.
    long = long.select(F.col("of").cast("int"), "x", _bin(F.col("x")).alias("bin"))
    by = Window.partitionBy("of")
    earlier = F.coalesce(F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = long.groupBy("of", "bin").agg(n).withColumns({"before": earlier, "whole": F.sum("n").over(by)})
    held = bins.where(F.exists(F.array(*ranks), lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("n"))))
    held = F.broadcast(stored(held.select("of", "bin", (F.col("before") - earlier).alias("left_out"), "whole"), "bins"))
    counts = long.join(held.select("of", "bin"), ["of", "bin"], "left_semi").groupBy(F.col("of").cast("long").alias("of"), "x").agg(n)
    ranked = placed(counts, "of", ["x"], "n").drop("whole").withColumn("bin", _bin(F.col("x")))
    return ranked.join(held, ["of", "bin"]).withColumn("before", F.col("before") + F.col("left_out"))


def _by_number(rows: DataFrame, groups: int, values: dict[str, Column], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Quantiles of groups ``__id``; a group and one of its values are one number ``of``.  Equal values are counted before they are ordered."""
    n, ranks = len(values), _ranks(wanted)
    long = rows.select("__id", F.posexplode("__m").alias("k", "x")).where("x IS NOT NULL").select((F.col("__id") * n + F.col("k")).alias("of"), "x")
    ranked = _counted(long, groups <= FEW, [r.cast("long") for low, high, _ in ranks.values() for r in (low, high)])
    at = lambda rank: F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col("x")))
    each = ranked.groupBy("of").agg(*(c.alias(f"{m}_{side}") for m, (low, high, part) in ranks.items() for side, c in (("low", at(low)), ("high", at(high)), ("part", F.max(part)))))
    told = {m: F.col(f"{m}_low") + F.col(f"{m}_part") * (F.col(f"{m}_high") - F.col(f"{m}_low")) if kind == "linear" else F.col(f"{m}_low") for m, (kind, _) in wanted.items()}
    each = each.select(F.expr(f"of div {n}").alias("__id"), (F.col("of") % n).alias("k"), *(c.alias(m) for m, c in told.items()))
    return each.groupBy("__id").agg(*(F.max(F.when(F.col("k") == k, F.col(m))).alias(f"{v}_{m}") for k, v in enumerate(values) for m in wanted))
