"""Periodic runs of words by suffix-tree LCE and Lyndon roots.

A run of smallest period q holds a Lyndon word of q words, which is the longest
Lyndon word at its place in the words' order or in the opposite one: where the next
smaller suffix begins, it ends.  So each place gives two candidates.  How far a
candidate goes on to the right is the longest common extension of two suffixes, to
the left that of two suffixes of the reversal: the depth of their leaves' lowest
common ancestor in a suffix tree (Ukkonen), read from an Euler tour and a table of
range minima in constant time, for all candidates at once.

A run of 12 or more words holds six words in a row twice, and such six-word windows
cover it.  What they don't cover has no run and needs no tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import prepare

#: Words of a window that each run holds twice: of a run of ``LEAST`` words of period q, the first and the last max(LEAST, 2 * q) - q agree.
LEAST = 12
WINDOW = LEAST // 2
#: Words that share one tree, of several texts; a longer stretch has a tree of its own.
TREE = 1 << 15
#: Odd base of the windows' hash.
BASE = 0x9E3779B97F4A7C15

RUNS = "array<struct<start: long, length: long, period: long>>"
ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than space and 09-0D, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each different word."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def stretches(words: np.ndarray) -> list[tuple[int, int]]:
    """Ranges ``(start, end)`` outside of which there is no run: covered by windows that occur twice in the same range."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return []
    hashes = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        hashes = hashes * np.uint64(BASE) + words[k : n + k].astype(np.uint64)
    at = np.arange(n)
    part = np.zeros(n, np.uint64)
    while True:
        keys = hashes[at] + part * np.uint64(0xD6E8FEB86659FD93)  # equal hashes of unequal windows only keep more
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        kept = at[twice]
        if not len(kept):
            return []
        new = np.r_[True, np.diff(kept) > WINDOW]  # windows that leave no word between them are of one stretch
        starts, ends = kept[new], kept[np.r_[np.flatnonzero(new)[1:] - 1, len(kept) - 1]] + WINDOW
        label = np.cumsum(new) - 1
        large = (ends - starts >= LEAST)[label]
        if large.all() and len(kept) == len(at):
            return list(zip(starts.tolist(), ends.tolist(), strict=True))
        at, part = kept[large], label[large].astype(np.uint64)
        if not len(at):
            return []


class SuffixTree:
    """Ukkonen's suffix tree of symbols, the last of which occurs once, and lowest common ancestors of its leaves.

    ``rank`` and ``opposite`` are the suffixes' places in the order of the symbols and in
    the opposite one; in both a suffix comes before those that it begins.
    """

    def __init__(self, text: list[int], both: bool = True) -> None:
        self.size = len(text)
        self._build(text)
        self._tour(text, both)

    def _build(self, text: list[int]) -> None:
        """Edges are keyed by node and symbol: node 0 is the root; a node's edge is ``text[start:end]``, a leaf's end is open."""
        n = len(text)
        width = max(text) + 1
        go: dict[int, int] = {}
        start, end, link = [0], [0], [0]
        node = length = edge = waiting = 0  # the active point: a node, and length symbols from text[edge]
        for i, symbol in enumerate(text):
            waiting += 1
            last = 0
            while waiting:
                if not length:
                    edge = i
                key = node * width + text[edge]
                child = go.get(key)
                if child is None:
                    go[key] = len(start)
                    start.append(i), end.append(n), link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    begin = start[child]
                    span = end[child] - begin if end[child] < n else i + 1 - begin
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    if text[begin + length] == symbol:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    split = len(start)
                    start.append(begin), end.append(begin + length), link.append(0)
                    go[key] = split
                    go[split * width + symbol] = split + 1
                    start.append(i), end.append(n), link.append(0)
                    start[child] = begin + length
                    go[split * width + text[begin + length]] = child
                    if last:
                        link[last] = split
                    last = split
                waiting -= 1
                if not node and length:
                    length -= 1
                    edge = i - waiting + 1
                elif node:
                    node = link[node]
        keys = np.fromiter(go.keys(), np.int64, len(go))
        self.child = np.fromiter(go.values(), np.int64, len(go))
        self.parent, self.symbol = keys // width, keys % width
        self.length = np.array(end) - np.array(start)

    def _tour(self, text: list[int], both: bool) -> None:
        """Depths along an Euler tour, each suffix's place in it, and the suffixes' ranks."""
        nodes = len(self.length)
        order = np.lexsort((self.symbol, self.parent))
        children, first = self.child[order].tolist(), np.searchsorted(self.parent[order], np.arange(nodes + 1)).tolist()
        length = self.length.tolist()
        depths, place, leaves = [0], [0] * self.size, []
        depth, path, turn = 0, [0], first[:]
        while path:
            node = path[-1]
            k = turn[node]
            if k < first[node + 1]:
                turn[node] = k + 1
                child = children[k]
                below = depth + length[child]
                if first[child] == first[child + 1]:  # a leaf: its depth tells which suffix it is
                    suffix = self.size - below
                    place[suffix] = len(depths)
                    leaves.append(suffix)
                    depths.append(below)
                    depths.append(depth)
                else:
                    path.append(child)
                    depth = below
                    depths.append(depth)
            else:
                path.pop()
                if path:
                    depth -= length[node]
                    depths.append(depth)
        self.place = np.array(place)
        self.minima = [np.array(depths, np.int32)]
        step = 1
        while 2 * step <= len(depths):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-step], last[step:]))
            step *= 2
        if both:
            self.rank = np.empty(self.size, np.int64)
            self.rank[leaves] = np.arange(self.size)
            # In the opposite order the smaller of two neighbours' next symbols is the larger, but an end stays first.
            self.opposite = np.empty(self.size, np.int64)
            self.opposite[self._opposite_leaves(children, first, length)] = np.arange(self.size)

    def _opposite_leaves(self, children: list[int], first: list[int], length: list[int]) -> list[int]:
        leaves, path = [], [(0, 0)]
        while path:
            node, depth = path.pop()
            if first[node] == first[node + 1]:
                leaves.append(self.size - depth)
            else:
                path.extend((c, depth + length[c]) for c in children[first[node] : first[node + 1]])
        return leaves

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``i`` and ``j``, different from one another."""
        a, b = np.minimum(self.place[i], self.place[j]), np.maximum(self.place[i], self.place[j])
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            some = level == k
            table = self.minima[k]
            out[some] = np.minimum(table[a[some]], table[b[some] + 1 - (1 << k)])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """Place of the next smaller rank after each, or their number."""
    out, stack = [len(rank)] * len(rank), []
    for i, x in enumerate(rank.tolist()):
        while stack and stack[-1][0] > x:
            out[stack.pop()[1]] = i
        stack.append((x, i))
    return np.array(out)


def runs_of(words: np.ndarray) -> np.ndarray:
    """Rows ``start, length, period`` of all runs of two or more periods, by start, then period.

    ``words`` are numbers of at least 0.
    """
    n = len(words)
    if n < 2:
        return np.empty((0, 3), np.int64)
    known, symbols = np.unique(words, return_inverse=True)
    symbols += 1
    forward = SuffixTree([*symbols.tolist(), 0])
    backward = SuffixTree([*symbols[::-1].tolist(), 0], both=False)
    found = []
    for rank in (forward.rank, forward.opposite):
        i = np.arange(n)
        j = next_smaller(rank)[:n]
        i, j = i[j < n], j[j < n]
        right = forward.extension(i, j)
        left = np.where(i > 0, backward.extension(n - np.maximum(i, 1), n - np.maximum(j, 2)), 0)
        start, length, period = i - left, j + right - i + left, j - i
        run = length >= 2 * period
        found.append(np.stack([start, length, period], 1)[run])
    out = np.unique(np.concatenate(found), axis=0)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs_of_texts(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each sequence of word numbers its runs of at least ``LEAST`` words; stretches of several texts share a tree."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    waiting: list[tuple[int, int, np.ndarray]] = []

    def flush() -> None:
        if not waiting:
            return
        # A word that occurs once keeps stretches apart: no run holds it.
        top = 1 + max(int(w.max()) for _, _, w in waiting)
        whole = np.concatenate([np.r_[w, top + k] for k, (_, _, w) in enumerate(waiting)])
        runs = runs_of(whole)
        runs = runs[runs[:, 1] >= np.maximum(LEAST, 2 * runs[:, 2])]
        ends = np.cumsum([len(w) + 1 for _, _, w in waiting])
        of = np.searchsorted(ends, runs[:, 0], "right")
        for k, (text, start, w) in enumerate(waiting):
            own = runs[of == k]
            if len(own):
                own[:, 0] += start - (ends[k] - len(w) - 1)
                out[text].append(own)
        waiting.clear()

    size = 0
    for text, words in enumerate(texts):
        for start, end in stretches(words):
            if size + end - start > TREE:
                flush()
                size = 0
            waiting.append((text, start, words[start:end]))
            size += end - start + 1
    flush()
    return [np.concatenate([np.empty((0, 3), np.int64), *x]) for x in out]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0).tolist()]


def _periodic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [words_of(t) for t in batch.column("text").to_pylist()]
        runs = runs_of_texts([numbered(w) for w in words])
        every = np.concatenate([np.empty((0, 3), np.int64), *runs])
        ends = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], ["start", "length", "period"]))
        texts = pa.array([b" ".join(collapsed(w, r) if len(r) else w).decode("utf-8", "replace") for w, r in zip(words, runs, strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists.cast(ARROW_RUNS), texts], names=["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``runs`` by start, then period, and the text ``collapsed`` to the words that no run repeats.

    A run is a stretch of at least max(12, 2 * q) words of smallest period q that
    no neighbouring word extends; words are numbered from 0.  Null and empty texts have no
    runs and an empty collapsed text.  Rows stay as they are, repeated ones and those
    without an id included; an empty table gives no rows; other columns are ignored.
    A text is worked on by one task, in memory in proportion to its longest stretch of repeated windows.
    """
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_periodic, f"doc_id {dict(docs.dtypes)['doc_id']}, runs {RUNS}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where a tenth of the texts repeat some of their words to the end.

    With h the crc32 of the id as text and g = h div 10, a text of n words whose h is
    divisible by 10 goes on from word a = g % n with period 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    placed = chosen.withColumn("a", F.expr("if(size(words) > 0, g % size(words), null)"))
    placed = placed.withColumn("p", F.expr("1 + (size(words) - a) div (3 + g % 8)"))
    planted = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[cast(a + (i - a) % p as int)])), ' ')")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row for each of ``periodic_runs``: number of runs, the longest, and digests of all runs and of the collapsed text."""
    best = "array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))"
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    one = found.selectExpr("doc_id", "cast(size(runs) as long) as n_runs", f"{best} as best", f"sha2({lines}, 256) as runs_sha256", "sha2(collapsed, 256) as collapsed_sha256")
    return one.selectExpr("doc_id", "n_runs", "-best.start as start", "best.length as length", "-best.period as period", "(1000 * best.length) div (-best.period) as exponent_milli", "runs_sha256", "collapsed_sha256")
