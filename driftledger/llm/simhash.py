"""SimHash near-duplicate groups by tiled exact comparison.

Fingerprints are linked by comparing tiles with exclusive-or and bit counts.
Two fingerprints that differ in at most ``radius`` bits agree in two or more of
``radius + 2`` blocks of bits, so tiles are dealt out by each pair of blocks:
no link is lost, and a tile holds the few fingerprints that agree there.  A
tile of very many is split by population count and then by hash, and each two
parts whose counts are within the radius meet once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import connected_components
from .shared import bit_table, in_table, prepare, small, stored

#: Fingerprints that one tile holds at most.
TILE = 4096
#: A text in so many is read for the shingles that are common: those that two of a sample hold.
SAMPLES = (8, 64, 512)
#: Pairs that a worker holds at once.
PAIRS = 250_000
#: Bits of the map of a text's shingles by which pairs that can't be similar are told.
SKETCH = 1024
#: Differing bits of the fingerprints that are tried first for similar texts.
RADIUS = 6

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, or of the whole if it has fewer."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()  # bytes.split() cuts at 20 and 09-0D
    if not found:
        return np.empty(0, np.uint64)
    runs = zip(*(found[i:] for i in range(words)), strict=False) if len(found) >= words else [found]
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), map(b" ".join, runs)), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; as a signed 64-bit integer."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, 65280):
        bits = np.unpackbits(hashes[lo : lo + 65280].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        counts += bits[:full].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[full:].sum(0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0]) if n else 0


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id`` and ``fp long`` of every row; a null text or one without words has 0."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(found, pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def sketch(hashes: np.ndarray) -> bytes:
    """A map of ``SKETCH`` bits with that of each hash set."""
    bits = np.zeros(SKETCH, np.uint8)
    bits[(hashes % np.uint64(SKETCH)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def common_shingles(docs: DataFrame, words: int) -> list[Broadcast]:
    """Bit tables of the shingles that several texts of ever smaller samples hold; what they miss or add is only slower."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()]
            turns = np.repeat(batch.column("turn").to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_pydict({"token": pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)), "turn": pa.array(turns)})

    turn = F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLES[-1])).cast("int")
    sample = docs.select("text", turn.alias("turn")).where(F.pmod("turn", F.lit(SAMPLES[0])) == 0)
    of = [F.count_if(F.pmod("turn", F.lit(n)) == 0).alias(f"n{n}") for n in SAMPLES]
    counts = stored(sample.mapInArrow(run, "token long, turn int").groupBy("token").agg(*of).where(f"n{SAMPLES[0]} > 1"), "common-shingles")
    return [bit_table(counts.where(f"n{n} > 1").select("token")) for n in SAMPLES]


def rare_first(hashes: np.ndarray, common: list[np.ndarray], similarity: float) -> np.ndarray:
    """The first of distinct hashes in an order that all texts share: those in the fewest of the tables first, then by value.

    Two sets that are ``similarity`` alike share one of these: each holds all but a
    share ``1 - similarity`` of its members in common with the other.
    """
    n = len(hashes)
    level = sum((in_table(t, hashes).astype(np.int8) for t in common), np.zeros(n, np.int8))
    return hashes[np.lexsort((hashes, level))][: n - math.ceil(similarity * n - 1e-9) + 1].view(np.int64)


def sketches(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of rows that have words ``id long``, ``fp long`` of the distinct shingles, their number ``shingles``, ``sketch`` and ``prefix``, the rarest."""
    prepare(docs.sparkSession)
    common = common_shingles(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [t.value for t in common]
        for batch in batches:
            found = [(i, h) for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True) if len(h := shingle_hashes(t, words))]
            sets = [np.unique(h) for _, h in found]
            yield pa.RecordBatch.from_pydict({"id": pa.array([i for i, _ in found], pa.int64()), "fp": pa.array([fingerprint(x) for x in sets], pa.int64()), "shingles": pa.array([len(x) for x in sets], pa.int64()), "sketch": pa.array([sketch(x) for x in sets], pa.binary()), "prefix": pa.array([rare_first(x, tables, similarity) for x in sets], pa.list_(pa.int64()))})

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "id long, fp long, shingles long, sketch binary, prefix array<long>")


def block_masks(radius: int) -> list[int]:
    """Masks of each pair of ``radius + 2`` blocks of the 64 bits."""
    n = radius + 2
    ends = [64 * i // n for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:], strict=False)]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by their first two, cut so that no tile (equal first two) is parted."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        changes = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
        cut = int(changes[-1]) + 1 if len(changes) else 0
        if cut:
            yield [x[:cut] for x in rows]
        held = [x[cut:] for x in rows]
    if held is not None and len(held[0]):
        yield held


def _hits(tile: np.ndarray, key: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and distances of the pairs of a tile within the radius.

    Rows are sorted by tile, key and bit count; rows of side 0 meet one another and
    those of side 1.  Each offset compares all rows with those so far behind, while
    keys agree and counts are within the radius.
    """
    count = np.bitwise_count(fp.view(np.uint64)).astype(np.int8)
    at = np.arange(len(fp) - 1)
    step = 1
    while len(at):
        to = at + step
        near = (tile[at] == tile[to]) & (key[at] == key[to]) & (count[to] - count[at] <= radius)
        at, to = at[near], to[near]
        apart = np.bitwise_count((fp[at] ^ fp[to]).view(np.uint64))
        hit = (apart <= radius) & ((side[at] | side[to]) != 2)
        yield at[hit], to[hit], apart[hit]
        step += 1
        at = at[at + step < len(fp)]


def compare_tiles(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows ``tile, key, fp, side`` -> edges ``u, v``: a forest of the links of whole tiles."""
    for tile, key, fp, side in _whole_tiles(batches):
        u, v = np.empty(0, np.int64), np.empty(0, np.int64)
        waiting, size = [(u, v)], 0
        for x, y, _ in _hits(tile, key, fp, side, radius):
            waiting.append((fp[x], fp[y]))
            size += len(x)
            if size > PAIRS:  # what is linked already need not be kept
                waiting, size = [forest(*map(np.concatenate, zip(*waiting, strict=True)))], 0
        u, v = forest(*map(np.concatenate, zip(*waiting, strict=True)))
        yield pa.RecordBatch.from_pydict({"u": u, "v": v})


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same components as the given ones, at most one a node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def deal_tiles(nodes: DataFrame, radius: int) -> DataFrame:
    """Rows of a stored table of ``id``, ``fp`` and more, dealt to the tiles that they meet in.

    Adds ``tile``, ``key``, ``side`` and ``t`` (the pair of blocks); each tile is
    in one partition, sorted by bit count.
    """
    prepare(nodes.sparkSession)
    masks = F.array(*(F.lit(_signed(m)) for m in block_masks(radius)))
    kept = nodes.columns
    keyed = nodes.select(*kept, F.bit_count("fp").alias("n"), F.posexplode(masks).alias("t", "mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).drop("mask")
    # Tiles of too many rows, by population count; few, as each stands for over TILE rows.
    big = keyed.groupBy("t", "key").count().where(F.col("count") > TILE).select("t", "key")
    big = stored(big, "big-tiles")
    cells = keyed.join(big, ["t", "key"]).groupBy("t", "key", "n").agg(F.ceil(F.count(F.lit(1)) / (TILE // 2)).cast("int").alias("parts"))
    cells = stored(cells, "tile-cells")

    plain = keyed.join(big, ["t", "key"], "left_anti").withColumns({"tile": F.col("t").cast("long"), "side": F.lit(0)})
    # A row of part p of its cell is side 0 of the tiles (p, q) with each part q of
    # the next cells and later parts of its own, and side 1 of those with earlier ones.
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    other = cells.select("t", "key", F.col("n").alias("n2"), F.col("parts").alias("parts2"))
    rows = keyed.join(cells, ["t", "key", "n"]).withColumn("part", part)
    met = rows.join(other, ["t", "key"]).where(F.abs(F.col("n") - F.col("n2")) <= radius)
    met = met.withColumn("part2", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)))
    mine, theirs = F.struct("n", "part"), F.struct(F.col("n2").alias("n"), F.col("part2").alias("part"))
    pair = F.xxhash64(F.lit("tile"), F.least(mine, theirs), F.greatest(mine, theirs), "t")
    split = met.withColumns({"tile": pair, "side": F.lit(0)})
    wanted = ["tile", "key", "n", "fp", "side", "t", *(c for c in kept if c != "fp")]
    tiles = plain.select(*wanted).unionByName(split.select(*wanted))
    return tiles.repartition("tile", "key").sortWithinPartitions("tile", "key", "n", "fp")


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Edges ``u, v`` between the distinct ``fp`` of a stored table, with the components of all links.

    Each tile gives a forest of what it links, so a tile of thousands of near
    copies gives thousands of edges, not their pairs.
    """
    tiles = deal_tiles(fps.select("fp", F.col("fp").alias("id")), radius).select("tile", "key", "fp", "side")
    return tiles.mapInArrow(partial(compare_tiles, radius=radius), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """One row a document: ``doc_id``, ``fp long``, ``component_id``.

    Fingerprints of ``words``-word shingles link at ``radius`` or fewer differing
    bits; ``component_id`` is the smallest ``doc_id`` of all documents reachable
    (null if all of them lack an id).  Texts without words have fingerprint 0,
    linked like any other.  Repeated rows stay; an empty table gives no rows;
    other columns are ignored.
    """
    rows = stored(fingerprints(docs, words), "fingerprints")
    first = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    nodes = stored(connected_components(links(first.select("fp"), radius)), "fingerprint-groups")
    member = first.join(nodes, first["fp"] == nodes["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = nodes.join(first, nodes["node"] == first["fp"]).groupBy("component").agg(F.min("first").alias("least"))
    # Only classes of several fingerprints have a row in ``least``.
    ids = member.join(least, "component", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return rows.join(stored(ids, "component-ids"), "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _similar(batches: Iterator[pa.RecordBatch], words: int, similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
            a, b = np.unique(shingle_hashes(left, words)), np.unique(shingle_hashes(right, words))
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(bool(len(a) and len(b)) and both >= similarity * (len(a) + len(b) - both))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _verified(texts: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the pairs ``u, v`` whose texts are similar by exact Jaccard."""
    left, right = (texts.select(F.col("doc_id").cast("long").alias(c), F.col("text").alias(t)) for c, t in (("u", "left"), ("v", "right")))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "left", "right")
    return stored(both.mapInArrow(partial(_similar, words=words, similarity=similarity), "u long, v long"), "alike")


LISTED = "token long, cell int, group long, id long, shingles int, pos int, side int"


def _meeting(token: np.ndarray, cell: np.ndarray, group: np.ndarray, shingles: np.ndarray, pos: np.ndarray, side: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of other groups in the same list, ``PAIRS`` at a time, that by size and place may be similar.

    ``pos`` is the token's place in its text's prefix; at the first that two similar
    texts share, what is left of both must reach the overlap they need.  Rows of one
    side don't meet, but those of side -1 do.
    """
    n = len(token)
    turn = np.r_[True, (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])]
    ends = np.r_[np.flatnonzero(turn)[1:], n]
    stop = ends[np.cumsum(turn) - 1]
    turn |= np.r_[True, group[1:] != group[:-1]]
    ends = np.r_[np.flatnonzero(turn)[1:], n]
    start = ends[np.cumsum(turn) - 1]
    rows = np.flatnonzero(stop > start)
    total = np.cumsum(stop[rows] - start[rows])
    while len(rows):
        take = max(1, int(np.searchsorted(total, PAIRS, "right")))
        some, many = rows[:take], (stop - start)[rows[:take]]
        x = np.repeat(some, many)
        y = np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[some], many)
        rows, total = rows[take:], total[take:] - total[take - 1]
        left = np.minimum(shingles[x] - pos[x], shingles[y] - pos[y])
        can = (left * (1 + similarity) >= similarity * (shingles[x] + shingles[y]) - 1e-6) & ((side[x] != side[y]) | (side[x] < 0))
        yield x[can], y[can]


def _crowded(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows ``LISTED`` sorted by token, cell and group: those that meet another that they may be similar to."""
    names = [x.split()[0] for x in LISTED.split(", ")]
    for rows in _whole_tiles(batches):
        token, cell, group, _, shingles, pos, side = rows
        keep = np.zeros(len(token), bool)
        for x, y in _meeting(token, cell, group, shingles, pos, side, similarity):
            keep[x] = keep[y] = True
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in rows], names=names)


def _sharing(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows ``LISTED`` and ``sketch``, sorted by token, cell and group -> pairs ``u, v`` of other groups, ``most``.

    Bits of one sketch that the other lacks stand for at least as many shingles that
    it lacks; ``most`` is the greatest similarity that this allows, and pairs whose
    is too low go.
    """
    for token, cell, group, ids, shingles, pos, side, maps in _whole_tiles(batches):
        bits = np.frombuffer(b"".join(maps), np.uint64).reshape(len(token), -1)
        for x, y in _meeting(token, cell, group, shingles, pos, side, similarity):
            both = np.minimum(shingles[x] - np.bitwise_count(bits[x] & ~bits[y]).sum(1, dtype=np.int64), shingles[y] - np.bitwise_count(bits[y] & ~bits[x]).sum(1, dtype=np.int64))
            most = both / (shingles[x].astype(np.int64) + shingles[y] - both)
            can = most >= similarity - 1e-9
            x, y, most = x[can], y[can], most[can]
            u, v = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
            _, first = np.unique(np.stack([u, v], 1), axis=0, return_index=True)
            if len(first):
                yield pa.RecordBatch.from_pydict({"u": u[first], "v": v[first], "most": most[first]})


def prefix_pairs(rows: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``u, v, most`` of other groups that may be similar: none that is, is missing.

    Texts meet at each shingle of their prefixes.  A shingle of very many is split
    into parts, each two of which meet once.  Sketches are joined only to texts that
    meet others.
    """
    named = rows.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("group", F.coalesce("component", "id"))
    tokens = named.select("id", "group", F.col("shingles").cast("int").alias("shingles"), F.posexplode("prefix").alias("pos", "token"))
    # Estimated on a part of the texts: what it misses is only slower.
    seen = rows.where(F.pmod(F.xxhash64("id"), F.lit(16)) == 0).select(F.explode("prefix").alias("token"))
    big = seen.groupBy("token").count().where(F.col("count") > TILE // 16)
    big = small(big.select("token", F.ceil(F.col("count") * 16 / TILE).cast("int").alias("parts")))
    dealt = tokens.join(big, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.least("part", "other") * F.col("parts") + F.greatest("part", "other")
    side = F.when(F.col("part") == F.col("other"), -1).otherwise((F.col("part") > F.col("other")).cast("int"))
    lists = dealt.select("token", cell.alias("cell"), "group", "id", "shingles", "pos", side.alias("side"))
    lists = lists.repartition("token", "cell").sortWithinPartitions("token", "cell", "group")
    crowded = stored(lists.mapInArrow(partial(_crowded, similarity=similarity), LISTED), "crowded-lists")
    met = crowded.join(rows.select("id", "sketch"), "id").select(*crowded.columns, "sketch")
    met = met.repartition("token", "cell").sortWithinPartitions("token", "cell", "group")
    pairs = met.mapInArrow(partial(_sharing, similarity=similarity), "u long, v long, most double")
    return pairs.dropDuplicates(["u", "v"])


def near_groups(texts: DataFrame, rows: DataFrame, words: int, similarity: float, radius: int = RADIUS) -> DataFrame:
    """``node, component`` of the texts that a forest of links within ``radius`` joins, each link verified; ``rows`` are stored ``sketches``."""
    first = stored(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    u, v = (first.select(F.col("fp").alias(c), F.col("first").alias(f"of_{c}")) for c in "uv")
    between = links(first.select("fp"), radius).join(u, "u").join(v, "v").select(F.least("of_u", "of_v").alias("u"), F.greatest("of_u", "of_v").alias("v"))
    equal = rows.join(first, "fp").where("id <> first").select(F.col("first").alias("u"), F.col("id").alias("v"))
    pairs = stored(between.union(equal).distinct(), "near-pairs")
    return stored(connected_components(_verified(texts, pairs, words, similarity)), "near-groups")


def similar_groups(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """``doc_id, text`` of distinct ids -> ``node, component`` of the texts that are similar to another.

    Tiles of SimHash fingerprints find the nearest copies, which makes few groups of
    very many.  Pairs of other groups, however far their fingerprints, meet at the
    shingles that they share: of each two groups the likeliest pairs are verified
    first, until all are verified or in one group.  So no similar pair is lost, and
    a group of thousands of copies never gives all its pairs.
    """
    rows = stored(sketches(texts, words, similarity), "fingerprints")
    groups = near_groups(texts, rows, words, similarity)
    left = stored(prefix_pairs(rows, groups, similarity), "prefix-pairs")
    most = 4
    while True:
        u, v = (groups.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in "uv")
        named = left.join(u, "u", "left").join(v, "v", "left").select("u", "v", "most", F.coalesce("of_u", "u").alias("a"), F.coalesce("of_v", "v").alias("b")).where("a <> b")
        place = F.row_number().over(Window.partitionBy(F.least("a", "b"), F.greatest("a", "b")).orderBy(F.desc("most"), "u", "v"))
        placed = stored(named.withColumn("place", place).select("u", "v", "most", "place"), "placed")
        alike = _verified(texts, placed.where(F.col("place") <= most).select("u", "v"), words, similarity)
        if not alike.isEmpty():
            groups = stored(merged(groups, alike), "groups")
        left = placed.where(F.col("place") > most).select("u", "v", "most")
        if left.isEmpty():
            return groups
        most *= 16


def merged(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """``groups`` (``node, component``) after the links ``u, v`` between nodes."""
    u, v = (groups.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in "uv")
    between = edges.join(u, "u", "left").join(v, "v", "left").select("u", "v", F.coalesce("of_u", "u").alias("a"), F.coalesce("of_v", "v").alias("b"))
    between = stored(between, "between")
    joined = stored(connected_components(between.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("old"), F.col("component").alias("new")), "joined")
    nodes = groups.union(between.select("u", "a")).union(between.select("v", "b")).distinct()
    return nodes.join(joined, nodes["component"] == joined["old"], "left").select("node", F.coalesce("new", "component").alias("component"))


def deduplicate(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near duplicates; of each group the smallest ``doc_id`` stays.

    Two texts are copies if their sets of ``words``-word shingles are at least
    ``similarity`` alike (Jaccard); groups are the components of those links.  Equal
    texts are one text.  Texts without words are copies only of equal ones; a
    null text is no copy of anything.  Rows without a ``doc_id`` stay.  Texts are told apart by
    what they say, so different texts of one id are different texts; those of one group that have
    its smallest id both leave the one of the smaller digest.  All columns are kept.
    """
    key = F.sha2("text", 256).alias("__key")
    named = docs.where("doc_id is not null and text is not null").select("doc_id", "text", key, F.struct(*docs.columns).alias("row"))
    first = named.groupBy("__key").agg(F.min("doc_id").alias("first"))
    # Texts are numbered: an id may stand for several of them.
    texts = stored(first.withColumn("id", F.monotonically_increasing_id()), "first-of-texts")
    same = [named["__key"] == texts["__key"], named["doc_id"] == texts["first"]]
    distinct = stored(named.join(texts, same).select(F.col("id").alias("doc_id"), "text").dropDuplicates(["doc_id"]), "distinct-texts")
    groups = similar_groups(distinct, words, similarity)
    grouped = texts.join(groups, texts["id"] == groups["node"], "left").select("__key", "first", F.coalesce("component", "id").alias("group"))
    # Of texts whose smallest ids are equal the smaller digest stays.
    keep = stored(grouped.groupBy("group").agg(F.min(F.struct("first", "__key")).alias("k")).select(F.col("k.first").alias("doc_id"), F.col("k.__key").alias("__key")), "kept-texts")
    # Of repeated rows with the same id and text one stays, too.
    kept = named.join(keep, ["doc_id", "__key"], "left_semi").dropDuplicates(["doc_id", "__key"])
    return kept.select("row.*").unionByName(docs.where("doc_id is null or text is null"))
