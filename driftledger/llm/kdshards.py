"""Shards of equal bytes as the leaves of a k-d tree, with DataFrame functions only.

Equal texts are one point with their bytes as its weight.  The few heavy ones are dealt
first, the largest to the emptiest shard; the tree splits all others so that each leaf
fills its shard up to the level that all reach.  Each level splits all
its nodes at once: the widest dimension of each node, then its weighted median,
found by histograms that narrow the range until a bin's weight is negligible.
What reaches the driver is the histograms of one level, at most
``MOST_LEAVES * BINS`` rows; what it decides goes back as literal arrays that a
point's node number indexes, so no level needs a join or a shuffle of points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .shared import prepare, small, stored

#: Leaves of a tree at most; the literal arrays have so many entries.
MOST_LEAVES = 4096
BINS = 512
#: Share of a leaf's bytes by which a split may miss its median.
TOLERANCE = 0.002
#: Equal texts of a greater share of a shard's bytes are dealt to shards, whole, before the tree is built.
HEAVY = 0.02
#: Rows that are numbered in one task, about.
SLOT_ROWS = 50_000
ATOM_MAX = (1 << 62) - 1


def _by_node(values: list, kind: str) -> Column:
    """The value of each row's ``__node``, as a literal array's element."""
    return F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("__node"))


def _pick(dims: list[str], dim: Column) -> Column:
    """The coordinate of the dimension whose number is ``dim``; the last number is the atom."""
    out = F.col("atom")
    for k, name in enumerate(dims):
        out = F.when(dim == k, F.col(name)).otherwise(out)
    return out


def ranked(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``{name}_code``: the place of each string among the distinct ones in their order; null counts as empty.

    Distinct strings are ordered in ranges, whose sizes alone reach the driver.
    """
    value = F.coalesce(F.col(name).cast("string"), F.lit(""))
    distinct = rows.select(value.alias("value")).distinct().repartitionByRange("value").withColumn("part", F.spark_partition_id())
    distinct = stored(distinct, "names")
    # A range's strings are all less than the next one's, whatever its number.
    parts = sorted(distinct.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("value").cast("binary").alias("least")).collect(), key=lambda r: bytes(r["least"]))
    before, base = 0, F.lit(0).cast("long")
    offsets = []
    for r in parts:
        offsets.append((r["part"], before))
        before += r["n"]
    base = F.element_at(F.create_map(*(F.lit(x) for pair in offsets for x in pair)), F.col("part")).cast("long") if offsets else base
    place = F.row_number().over(Window.partitionBy("part").orderBy("value"))
    codes = distinct.select(F.col("value").alias("__value"), (base + place - 1).cast("long").alias(f"{name}_code"))
    return rows.withColumn("__value", value).join(small(codes), "__value").drop("__value")


def filled(shares: list[int], weight: int) -> list[float]:
    """How much of ``weight`` each share takes so that all that take any end at one level; none is above it but those that were."""
    order, level, taken = sorted(shares), 0.0, 0
    for k, x in enumerate(order, 1):
        taken += x
        level = (weight + taken) / k
        if k == len(order) or level <= order[k]:
            break
    return [max(0.0, level - x) for x in shares]


class Search:
    """A node's weighted median: the dimension and the range that still holds it."""

    def __init__(self, dim: int, lo: int, hi: int, want: float) -> None:
        self.dim, self.lo, self.hi, self.want = dim, lo, hi, want
        self.below, self.fixed = 0, None  # weight below the range; dimension and coordinate that all left points share

    def narrow(self, bins: list, slack: float, atoms: tuple[int, int], n_dims: int) -> tuple[int, int, int] | None:
        """Take one round's histogram; the cut (dimension, coordinate, atom) once it is near enough."""
        for r in sorted(bins, key=lambda r: r["least"]):
            if self.below + r["w"] > self.want:
                break
            self.below += r["w"]
        else:
            return (*self.fixed, self.hi) if self.fixed else (self.dim, self.hi, 0)
        over = self.below + r["w"] - self.want
        one = r["least"] == r["most"]
        if self.want - self.below <= slack or over <= slack or (self.fixed and one):
            x = r["least"] if self.want - self.below <= over else r["most"] + 1  # the bin's nearer side
            return (*self.fixed, x) if self.fixed else (self.dim, x, 0)
        if one:  # very many points share the median's coordinate: go on among their atoms
            self.fixed, self.dim, self.lo, self.hi = (self.dim, r["least"]), n_dims, atoms[0], atoms[1] + 1
        else:
            self.lo, self.hi = r["least"], r["most"] + 1
        return None


def kd_leaves(points: DataFrame, dims: list[str], leaves: int, tolerance: float = TOLERANCE, targets: list[float] | None = None) -> DataFrame:
    """``points`` with ``leaf``, 0 to ``leaves`` - 1; they need ``weight``, ``atom`` and whole-number ``dims``.

    Points of one ``atom`` must have the same coordinates; they go to one leaf.  Order
    within a dimension is by coordinate, then atom.  The dimension that is widest,
    as a share of its width over all points, is split; ties go to the first.  A node
    of k leaves gives its left part k // 2 of them and, of its weight, the share of their
    ``targets`` (all alike if not given).
    """
    if not 1 <= leaves <= MOST_LEAVES:
        raise ValueError(f"1 to {MOST_LEAVES} leaves")
    extent = points.agg(F.sum("weight").alias("w"), *(f(d).alias(f"{n}{k}") for k, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    span = [max(1, (extent[f"hi{k}"] or 0) - (extent[f"lo{k}"] or 0)) for k in range(len(dims))]
    slack = tolerance * (extent["w"] or 0) / leaves
    targets = targets if targets and sum(targets) > 0 else [1.0] * leaves
    state, level = points.withColumn("__node", F.lit(0)), [(0, leaves)]  # of each node: its first leaf, its leaves
    while any(n > 1 for _, n in level):
        state = stored(state, "tree-level")  # each level reads the one before, not all of them
        extents = state.groupBy("__node").agg(F.sum("weight").alias("w"), *(f(d).alias(f"{n}{k}") for k, d in enumerate([*dims, "atom"]) for n, f in (("lo", F.min), ("hi", F.max))))
        stats = {r["__node"]: r for r in extents.collect()}
        cuts: list[tuple[int, int, int]] = [(-1, 0, 0)] * len(level)  # what sorts below goes left
        search: dict[int, Search] = {}
        for node, (lo_leaf, n) in enumerate(level):
            if n > 1 and node in stats:
                s = stats[node]
                dim = max(range(len(dims)), key=lambda k: ((s[f"hi{k}"] - s[f"lo{k}"]) / span[k], -k))
                search[node] = Search(dim, s[f"lo{dim}"], s[f"hi{dim}"] + 1, s["w"] * sum(targets[lo_leaf : lo_leaf + n // 2]) / max(sum(targets[lo_leaf : lo_leaf + n]), 1e-9))
        while search:
            of = lambda f, other: [f(search[k]) if k in search else other for k in range(len(level))]  # noqa: E731, B023
            dim, lo, hi = _by_node(of(lambda s: s.dim, -1), "int"), _by_node(of(lambda s: s.lo, 0), "long"), _by_node(of(lambda s: s.hi, 0), "long")
            step = _by_node(of(lambda s: max(1, -(-(s.hi - s.lo) // BINS)), 1), "long")
            fixed_dim, fixed = _by_node(of(lambda s: s.fixed[0] if s.fixed else -1, -1), "int"), _by_node(of(lambda s: s.fixed[1] if s.fixed else 0, 0), "long")
            at = state.where(dim >= 0).withColumn("__x", _pick(dims, dim)).where((F.col("__x") >= lo) & (F.col("__x") < hi) & ((fixed_dim < 0) | (_pick(dims, fixed_dim) == fixed)))
            bins = at.groupBy("__node", ((F.col("__x") - lo) / step).cast("long").alias("bin")).agg(F.sum("weight").alias("w"), F.min("__x").alias("least"), F.max("__x").alias("most"))
            found: dict[int, list] = {}
            for r in bins.collect():
                found.setdefault(r["__node"], []).append(r)
            for node, s in list(search.items()):
                atoms = stats[node][f"lo{len(dims)}"], stats[node][f"hi{len(dims)}"]
                if cut := s.narrow(found.get(node, []), slack, atoms, len(dims)):
                    cuts[node] = cut
                    del search[node]
        first, after = [], []
        for lo_leaf, n in level:
            first.append(len(after))
            after += [(lo_leaf, n // 2), (lo_leaf + n // 2, n - n // 2)] if n > 1 else [(lo_leaf, 1)]
        dim, cut, atom = _by_node([c[0] for c in cuts], "int"), _by_node([c[1] for c in cuts], "long"), _by_node([c[2] for c in cuts], "long")
        x = _pick(dims, dim)
        right = (dim >= 0) & ((x > cut) | ((x == cut) & (F.col("atom") >= atom)))
        state, level = state.withColumn("__node", _by_node(first, "int") + right.cast("int")), after
    return state.withColumn("leaf", _by_node([lo for lo, _ in level], "int")).drop("__node")


def deal(weights: list[int], shards: int) -> tuple[list[int], list[int]]:
    """The shard of each weight, the heaviest first, each to the emptiest; and what the shards then hold."""
    held, out = [0] * shards, [0] * len(weights)
    for k in sorted(range(len(weights)), key=lambda k: (-weights[k], k)):
        out[k] = min(range(shards), key=lambda s: (held[s], s))
        held[out[k]] += weights[k]
    return out, held


def shard_documents(docs: DataFrame, shards: int = 8, heavy: float = HEAVY) -> DataFrame:
    """All rows of ``docs`` in ``shards`` shards of near equal bytes (law ``bytes``).

    ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.  ``size`` is the
    text's UTF-8 bytes (null: none) plus 1; ``text_crc32`` is 0 for null and empty
    texts.  Dimensions are the size and, where ``docs`` has them, ``lang`` and
    ``source`` in their strings' order; equal texts take the least of theirs.
    Equal texts share a shard, however many they are, unless they alone hold more bytes than
    a shard may: no law of near equal bytes has them whole, so their rows are dealt by ``doc_id`` into as
    many parts as they fill shards.  Texts of over ``heavy`` of a shard's bytes
    are dealt before the tree is built; the parameter changes no law.
    ``slot`` numbers a shard's rows from 0 without
    gaps.  Repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    text = F.coalesce("text", F.lit("")).cast("binary")
    meta = [c for c in ("lang", "source") if c in docs.columns]
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), *meta)
    rows = stored(rows, "shard-rows")
    for c in meta:
        rows = ranked(rows, c)
    n, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    share = max(1.0, (total or 0) / shards)
    groups = rows.groupBy("h", "size", "text_crc32").agg(F.sum("size").alias("w"))
    # Groups of more bytes than a shard: fewer than there are shards, so they are literals of the plan.
    over = [(r["h"], r["size"], r["text_crc32"], -int(-r["w"] // share)) for r in groups.where(F.col("w") > share).collect()]
    parts = F.lit(0)
    for h, size, crc, k in over:
        parts = F.when((F.col("h") == h) & (F.col("size") == size) & (F.col("text_crc32") == crc), F.pmod(F.xxhash64("doc_id"), F.lit(k))).otherwise(parts)
    atom = F.xxhash64("h", "size", "text_crc32", parts.cast("long")).bitwiseAND(F.lit(ATOM_MAX))
    keyed = stored(rows.withColumn("atom", atom).drop("h", *meta), "shard-keys")
    dims = ["size", *(f"{c}_code" for c in meta)]
    points = stored(keyed.groupBy("atom").agg(F.sum("size").alias("weight"), *(F.min(d).alias(d) for d in dims)), "shard-points")
    # At most shards / heavy points.
    large = [(r["atom"], r["weight"]) for r in points.where(F.col("weight") > heavy * share).select("atom", "weight").orderBy("atom").collect()]
    where, held = deal([w for _, w in large], shards)
    dealt = docs.sparkSession.createDataFrame([(a, s) for (a, _), s in zip(large, where, strict=True)], "atom long, shard int")
    light = (total or 0) - sum(held)
    rest = points.join(F.broadcast(dealt), "atom", "left_anti")
    leaves_of = kd_leaves(rest, dims, shards, targets=filled(held, light)).select("atom", F.col("leaf").alias("shard"))
    of_atom = stored(leaves_of.unionByName(dealt), "atom-shards")
    buckets = max(16, -(-(n or 0) // SLOT_ROWS))
    leaves = keyed.join(of_atom, "atom").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "atom", "size"), F.lit(buckets)).cast("int"))
    leaves = stored(leaves.select("doc_id", "size", "text_crc32", "atom", "shard", "bucket"), "shard-leaves")
    counts = leaves.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "atom"))
    return leaves.withColumn("place", place).join(stored(offsets, "shard-offsets"), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
