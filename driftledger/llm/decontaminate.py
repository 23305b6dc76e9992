"""Benchmark decontamination by greedy string tiling.

Seeds are runs of words.  A bit table of fixed size tells the documents with seeds that
may be a benchmark item's; only these go on, with their grams: the shorter runs that a tile is made of.
An item that a document covers must share grams with it.  Of each item's grams the ones in
the fewest documents are kept, so many that the others together cover too little; Spark joins documents and items by
these alone, so a phrase that all of them have pairs none.  A pair is tiled: the longest
common runs are marked first, so that no word is in two tiles, by Karp-Rabin hashes
of ever shorter windows.  Tiles may lie in any order, so passages whose sentences
were moved are found as well.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import bit_table, in_table, prepare, small, stored

WORDS = re.compile(r"\w+")
#: Odd base of the running hash over words, modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
#: Word hashes that a worker keeps before it starts anew.
CACHE = 500_000

#: Bytes of benchmark texts that may be sent to all tasks; beyond, a pair's item comes with the pair.
SENT = 32 << 20

SCHEMA = "item_id long, coverage double, covered_words int, item_words int, tiles int"


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


class WordHashes(dict):
    """Word -> its XXH64."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, seed=42)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class RunningHashes:
    """Karp-Rabin hashes of the windows of a sequence, of any length, from its prefix sums."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)])
        down = np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), UNBASE, np.uint64)])[:n]
        self.sums = np.r_[np.uint64(0), np.cumsum(values * down)]

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.up[:n] if n > 0 else np.empty(0, np.uint64)


def runs_of(words: list[str], size: int, hashes: WordHashes) -> np.ndarray:
    """Hash of each run of ``size`` words, others for each size; none of fewer words."""
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    values, out = hashes.of(words), np.full(n, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(BASE) + values[k : n + k]
    return out


def grams_of(words: list[str], seed: int, least: int, hashes: WordHashes) -> np.ndarray:
    """An item's grams by place: its runs of ``least`` words; of an item of fewer than ``seed`` words, all of it."""
    return runs_of(words, least if len(words) >= seed else len(words), hashes) if words else np.empty(0, np.uint64)


def rarest(grams: list[int], counts: list[int], size: int, words: int, need: float) -> list[int]:
    """Those of an item's grams (by place) in the fewest documents, so many that runs of the others cover less than ``need`` words.

    A text that covers ``need`` words of the item has one of them.
    """
    order = sorted(set(zip(counts, grams, strict=True)))
    places: dict[int, list[int]] = defaultdict(list)
    for place, g in enumerate(grams):
        places[g].append(place)
    held = [0] * words  # how many grams cover each word
    for place in range(len(grams)):
        for k in range(place, place + size):
            held[k] += 1
    left, out = sum(h > 0 for h in held), []
    for _, g in order:
        if left < need:
            break
        out.append(g)
        for place in places[g]:
            for k in range(place, place + size):
                held[k] -= 1
                left -= held[k] == 0
    return out


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(doc position, item position, length)``, the longest first.

    ``doc`` and ``item`` are word numbers, 0 for words that the other can't have.
    Ties go to the smallest item position, then document position.  Memory is
    linear in the two: windows meet by hash, never all pairs of them.
    """
    free = [doc > 0, item > 0]
    hashed = [RunningHashes(x.astype(np.uint64)) for x in (doc, item)]
    tiles: list[tuple[int, int, int]] = []

    def windows(side: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the windows of which no word is marked."""
        marked = np.r_[0, np.cumsum(~free[side])]
        at = np.flatnonzero(marked[size:] == marked[:-size]) if size < len(marked) else np.empty(0, np.int64)
        return at, hashed[side].windows(size)[at]

    def common(size: int) -> bool:
        return len(np.intersect1d(windows(0, size)[1], windows(1, size)[1])) > 0

    top = min(len(doc), len(item))
    while top >= least and common(least):
        lo, hi = least, top
        while lo < hi:  # a common window holds shorter ones, so the greatest length can be halved for
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if common(mid) else (lo, mid - 1)
        size = lo
        (at, h), (to, g) = windows(0, size), windows(1, size)
        both = np.isin(h, g)
        places: dict[int, list[int]] = defaultdict(list)
        for x, i in zip(h[both][::-1].tolist(), at[both][::-1].tolist(), strict=True):
            places[x].append(i)  # the first position last
        for x, j in zip(g.tolist(), to.tolist(), strict=True):
            found = places.get(x)
            if not found or not free[1][j : j + size].all():
                continue
            while found and not free[0][found[-1] : found[-1] + size].all():
                found.pop()
            # Equal hashes are checked word by word.
            place = next((i for i in reversed(found) if free[0][i : i + size].all() and (doc[i : i + size] == item[j : j + size]).all()), None)
            if place is not None:
                tiles.append((place, j, size))
                free[0][place : place + size] = False
                free[1][j : j + size] = False
        top = size - 1
    return tiles


def match(doc_words: list[str], item_words: list[str], seed: int, least: int) -> tuple[int, int]:
    """Covered words of the item and tiles; none without a tile of ``seed`` words, or of all words of a shorter item."""
    n = len(item_words)
    number = {w: i for i, w in enumerate(dict.fromkeys(item_words), 1)}
    tiles = tile(np.array([number.get(w, 0) for w in doc_words], np.int64), np.array([number[w] for w in item_words], np.int64), min(least, n))
    if not tiles or tiles[0][2] < min(seed, n):
        return 0, 0
    return sum(t[2] for t in tiles), len(tiles)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, seed: int = 5, least: int = 3) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds.

    ``doc_id, item_id, coverage, covered_words, item_words, tiles``: one row for
    each document row and item row that share a run of ``seed`` words and whose
    tiles of ``least`` or more words cover at least ``threshold`` of the item's
    words.  Words are runs of letters, digits and underscores in lower case.  An
    item of fewer than ``seed`` words is found where all its words stand in a row.
    Null and empty texts share nothing.  Repeated rows give repeated pairs; an
    empty benchmark or table gives no rows; null ids are carried; other columns
    are ignored.  Only documents with a seed that may be an item's are moved, each
    once where the benchmark's texts can be sent to the tasks.
    """
    if not 0 < least <= seed:
        raise ValueError("a tile may not be longer than a seed")
    spark = docs.sparkSession
    prepare(spark)
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]

    def item_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            seeds = [np.unique(runs_of(w, min(seed, len(w)), hashes) if w else np.empty(0, np.uint64)) for w in words]
            grams = [grams_of(w, seed, least, hashes) for w in words]
            lists = (pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())) for found in (seeds, grams))
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), batch.column("text"), pa.array(map(len, words), pa.int32()), *lists], names=["item", "item_id", "text", "n", "seeds", "grams"])

    known = benchmark.where("text is not null").select("item_id", "text").withColumn("item", F.monotonically_increasing_id())
    items = stored(known.select("item", "item_id", "text").mapInArrow(item_runs, f"item long, item_id {item_kind}, text string, n int, seeds array<long>, grams array<long>"), "benchmark-items")
    table, gram_table = (bit_table(items.select(F.explode(c))) for c in ("seeds", "grams"))
    # Lengths of items shorter than a seed: fewer than ``seed`` numbers.
    short = sorted(r["n"] for r in items.where((F.col("n") > 0) & (F.col("n") < seed)).select("n").distinct().collect())

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            at, hits = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                words = words_of(text)
                found = [runs_of(words, size, hashes) for size in short]
                found = [f[in_table(gram_table.value, f)] for f in found]
                if in_table(table.value, runs_of(words, seed, hashes)).any():
                    grams = runs_of(words, least, hashes)
                    found.append(grams[in_table(gram_table.value, grams)])
                if sum(map(len, found)):
                    at.append(k)
                    hits.append(np.unique(np.concatenate(found)).view(np.int64))
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(hits, pa.list_(pa.int64()))], names=["doc_id", "text", "hits"])

    # Stored, so that the rows' numbers hold.
    may = docs.select("doc_id", "text").mapInArrow(candidates, f"doc_id {kind}, text string, hits array<long>")
    may = stored(may.withColumn("row", F.monotonically_increasing_id()), "candidates")
    held = may.select(F.explode("hits").alias("gram")).groupBy("gram").count()

    def kept_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for item, n, places in zip(*(batch.column(c).to_pylist() for c in ("item", "n", "places")), strict=True):
                size = least if n >= seed else n
                grams = [p["gram"] for p in places]
                out += [(item, g) for g in rarest(grams, [p["count"] for p in places], size, n, threshold * n - 1e-9)]
            yield pa.RecordBatch.from_pydict({"item": pa.array([i for i, _ in out], pa.int64()), "gram": pa.array([g for _, g in out], pa.int64())})

    # An item's grams by place, a list as long as its text.
    counted = items.select("item", "n", F.posexplode("grams").alias("place", "gram")).join(held, "gram", "left")
    placed = counted.groupBy("item", "n").agg(F.array_sort(F.collect_list(F.struct("place", "gram", F.coalesce("count", F.lit(0)).alias("count")))).alias("places"))
    wanted = stored(placed.mapInArrow(kept_grams, "item long, gram long"), "rarest-grams")
    pairs = may.select("row", F.explode("hits").alias("gram")).join(wanted, "gram").select("row", "item").distinct()

    def found_in(text: str, words: list[str]) -> tuple | None:
        covered, tiles = match(words_of(text), words, seed, least)
        return (covered / len(words), covered, len(words), tiles) if covered and covered >= threshold * len(words) else None

    def rows_of(batch: pa.RecordBatch, at: list[int], items_at: pa.Array, out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * 4
        kinds = (pa.float64(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), items_at, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "item_id", "coverage", "covered_words", "item_words", "tiles"])

    schema = f"doc_id {kind}, {SCHEMA.replace('item_id long', f'item_id {item_kind}')}"
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > SENT:
        def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [found_in(t, words_of(i)) for t, i in zip(batch.column("text").to_pylist(), batch.column("item_text").to_pylist(), strict=True)]
                at = [k for k, f in enumerate(found) if f]
                yield rows_of(batch, at, batch.column("item_id").take(pa.array(at, pa.int64())), [found[k] for k in at])

        texts = pairs.join(may.select("row", "doc_id", "text"), "row").join(items.select("item", "item_id", F.col("text").alias("item_text")), "item")
        return texts.select("doc_id", "item_id", "text", "item_text").mapInArrow(tiled, schema)

    # Items with texts of at most ``SENT`` bytes in all.
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    sent = spark.sparkContext.broadcast({r["item"]: (r["item_id"], r["text"]) for r in items.select("item", "item_id", "text").toLocalIterator()})

    def tiled_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: dict[int, list[str]] = {}
        for batch in batches:
            at, ids, out = [], [], []
            for k, (text, items_of) in enumerate(zip(batch.column("text").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                for item in items_of:
                    words = split.get(item) or split.setdefault(item, words_of(sent.value[item][1]))
                    if found := found_in(text, words):
                        at.append(k)
                        ids.append(sent.value[item][0])
                        out.append(found)
            yield rows_of(batch, at, pa.array(ids, item_type), out)

    lists = pairs.groupBy("row").agg(F.collect_list("item").alias("items"))
    return may.select("row", "doc_id", "text").join(lists, "row").select("doc_id", "text", "items").mapInArrow(tiled_once, schema)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with all their columns; null texts and ids stay."""
    key = F.sha2("text", 256).alias("key")
    found = contaminated(docs.select(F.sha2("text", 256).alias("doc_id"), "text"), benchmark, threshold).select(F.col("doc_id").alias("key")).distinct()
    return docs.select(F.struct(*docs.columns).alias("row"), key).join(small(found), "key", "left_anti").select("row.*")
