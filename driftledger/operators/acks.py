"""Acknowledgements of chunks: the first that is accepted wins, by offset, id and range.

What is accepted depends on what was accepted before, but only among acknowledgements that
share an offset or an id or overlap.  A file of few is a list, and one pass over it decides.
All other files go in rounds: an acknowledgement that comes before all it could clash
with is accepted, and what clashes with it is decided.  Each round is a few windows over
offsets, ids and short stretches of a file; none holds a whole file, and the rounds are
as many as the longest chain of clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from driftledger.functions.workers import stored

#: Width of the stretches that a file's acknowledgements are compared in, as a multiple of the longest.
STRETCH = 64
#: Up to so many acknowledgements of a file are a list in one row.
FEW = 64
#: What is told of an acknowledgement, the least first: of several accepted ones that it meets the greatest counts.  Fixed values.
KINDS = ["accepted", "overlap", "conflict", "duplicate"]


def _in_stretches(rows: DataFrame, longest: int) -> DataFrame:
    """``rows`` once in each stretch of their file that holds an offset within ``longest`` of theirs; ``home`` is their own."""
    width = STRETCH * longest
    cell = lambda c: F.floor(c / width)
    cells = F.sequence(cell(F.col("begin") - longest), cell(F.col("begin") + longest))
    return rows.withColumn("cell", F.explode(cells)).withColumn("home", F.col("cell") == cell(F.col("begin")))


def _least_nearby(rows: DataFrame, longest: int) -> DataFrame:
    """``rows`` with ``least``: the first ``seq`` among those whose offset is nearer than the longest range."""
    near = Window.partitionBy("file_id", "cell").orderBy("begin").rangeBetween(-(longest - 1), longest - 1)
    return _in_stretches(rows, longest).withColumn("least", F.min("seq").over(near)).where("home").drop("cell", "home")


def _told_in_lists(acks: DataFrame, check_ids: bool) -> DataFrame:
    """``acks`` with ``kind``, decided one after the other: each file is a list in one row."""
    names = acks.columns
    lists = acks.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(*names[1:]))).alias("rows"))

    def told(so_far: Column, x: Column) -> Column:
        def against(worst: Column, a: Column) -> Column:
            same = a["begin"] == x["begin"]
            alike = same & a["chunk_id"].eqNullSafe(x["chunk_id"]) & a["length"].eqNullSafe(x["length"]) & a["crc"].eqNullSafe(x["crc"])
            clash = same | (a["chunk_id"] == x["chunk_id"]) if check_ids else same
            over = (a["begin"] < x["begin"] + x["length"]) & (a["begin"] + a["length"] > x["begin"])
            return F.when(a["kind"] != 0, worst).when(alike, 3).when(clash, F.greatest(worst, F.lit(2))).when(over, F.greatest(worst, F.lit(1))).otherwise(worst)

        return F.concat(so_far, F.array(F.struct(*(x[c].alias(c) for c in names[1:]), F.aggregate(so_far, F.lit(0), against).alias("kind"))))

    kinds = F.array(*map(F.lit, KINDS))
    empty = F.array().cast(f"array<struct<{', '.join(f'{c}: bigint' for c in names[1:])}, kind: int>>")
    return lists.select("file_id", F.inline(F.aggregate("rows", empty, told))).withColumn("kind", F.get(kinds, F.col("kind")))


def ack_kinds(acks: DataFrame, check_ids: bool = True) -> DataFrame:
    """``acks`` with ``kind``: ``accepted``, ``duplicate``, ``conflict`` or ``overlap``.

    ``acks`` has file_id, chunk_id, begin, length (above 0), crc and ``seq``, a number that orders a
    file's acknowledgements.  One with the offset of an accepted one, or its id if
    ``check_ids``, is its duplicate if all agree, else a conflict; one that overlaps an
    accepted range otherwise is an overlap.
    """
    names = ["file_id", "seq", "chunk_id", "begin", "length", "crc"]
    rows = stored(acks.select(*(F.col(c).cast("long").alias(c) for c in names)), "acks")
    large = stored(rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW).select("file_id"), "large")
    listed = _told_in_lists(rows.join(large, "file_id", "left_anti"), check_ids)
    open_ = rows.join(large, "file_id", "left_semi")
    if large.isEmpty():
        return listed
    open_ = stored(open_, "open")
    longest = open_.agg(F.max("length")).first()[0] or 1
    done: DataFrame | None = None
    while not open_.isEmpty():
        first = lambda *by: F.min("seq").over(Window.partitionBy("file_id", *by))
        leading = open_.withColumns({"ahead": F.col("seq") == first("begin"), "lead": F.col("seq") == first("chunk_id") if check_ids else F.lit(True)})
        # Those behind another of their offset can't be accepted yet, and needn't keep any other from it.
        heads = _least_nearby(leading.where("ahead"), longest)
        accepted = stored(heads.where("lead AND least = seq").select(*names), "accepted")
        left = open_.join(accepted.select("file_id", "seq"), ["file_id", "seq"], "left_anti")
        same = accepted.select("file_id", "begin", F.struct("chunk_id", "length", "crc").alias("there"))
        ids = accepted.select("file_id", "chunk_id").distinct().withColumn("taken", F.lit(True))
        met = left.join(same, ["file_id", "begin"], "left")
        met = met.join(ids, ["file_id", "chunk_id"], "left") if check_ids else met.withColumn("taken", F.lit(None).cast("boolean"))
        decided = F.when(F.col("there") == F.struct("chunk_id", "length", "crc"), "duplicate").when(F.col("there").isNotNull() | F.col("taken"), "conflict").when(F.col("crossed"), "overlap")
        told = stored(_crossed(met, accepted, longest).select(*names, decided.alias("kind")), "told")
        part = accepted.withColumn("kind", F.lit("accepted")).unionByName(told.where("kind IS NOT NULL"))
        done = part if done is None else done.unionByName(part)
        open_ = told.where("kind IS NULL").drop("kind")
    return listed if done is None else listed.unionByName(_by_identity(done, check_ids))


def _by_identity(done: DataFrame, check_ids: bool) -> DataFrame:
    """``done`` with overlaps that also clash by offset or id as conflicts, in whichever round the other was accepted."""
    accepted, over = done.where("kind = 'accepted'"), done.where("kind = 'overlap'")
    for name in ("begin", "chunk_id")[: 2 if check_ids else 1]:
        other = accepted.select("file_id", name, F.col("seq").alias(f"by_{name}"))
        over = over.join(other, ["file_id", name], "left")
    earlier = F.least(*(F.coalesce(F.col(c), F.col("seq") + 1) for c in over.columns if c.startswith("by_")), F.col("seq") + 1) < F.col("seq")
    return done.where("kind <> 'overlap'").unionByName(over.withColumn("kind", F.when(earlier, "conflict").otherwise("overlap")).select(done.columns))


def _crossed(rows: DataFrame, accepted: DataFrame, longest: int) -> DataFrame:
    """``rows`` with ``crossed``: whether an accepted range overlaps theirs; those don't overlap one another, so the nearest on each side tell."""
    names = rows.columns
    both = rows.withColumn("range", F.lit(None).cast("struct<b: long, e: long>")).unionByName(accepted.select("file_id", "begin", F.struct(F.col("begin").alias("b"), (F.col("begin") + F.col("length")).alias("e")).alias("range")), allowMissingColumns=True)
    by = Window.partitionBy("file_id", "cell").orderBy("begin")
    before: Column = F.last("range", ignorenulls=True).over(by.rangeBetween(Window.unboundedPreceding, 0))
    after: Column = F.first("range", ignorenulls=True).over(by.rangeBetween(1, Window.unboundedFollowing))
    seen = _in_stretches(both, longest).withColumns({"before": before, "after": after}).where("home AND range IS NULL")
    crossed = (F.col("before.e") > F.col("begin")) | (F.col("after.b") < F.col("begin") + F.col("length"))
    return seen.select(*names, F.coalesce(crossed, F.lit(False)).alias("crossed"))


def chunk_conflicts(acks: DataFrame) -> DataFrame:
    """How many acknowledgements of a chunk weren't accepted, by kind: ``duplicate``, ``conflict``, ``overlap``."""
    return ack_kinds(acks).where("kind <> 'accepted'").groupBy("file_id", "chunk_id", "begin", "kind").agg(F.count(F.lit(1)).alias("acks"))
