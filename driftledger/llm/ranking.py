"""Ranked lexical search by dense blocked matrix products.

Items are taken in blocks of a bounded number of terms.  One pass over the documents
counts the block's terms in each; from these counts come the documents' impacts.  A
tile of documents (rows: documents, columns: a tile of the block's compact
vocabulary) times the vocabulary tile's weights for each item gives partial scores in
float64.  All factors are whole numbers and a vocabulary tile is so narrow that a
partial sum stays below 2**53, so the products are exact in any order of summation;
partial sums are added as 64-bit integers.  Each task keeps the best of each item,
ties by id, and merges of those are bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window, functions as F

from .shared import prepare, stored

#: Items and terms of one block, which is sent to the tasks; an item of more terms is a block alone.
ITEMS, TERMS = 1024, 1 << 17
#: Documents and vocabulary columns of one tile: 16 MB of float64.
DOCUMENTS, COLUMNS = 512, 4096
#: Whole numbers below this are exact in float64.
EXACT = 1 << 53
#: Groups that the tasks' best of an item are merged in before the last merge, which so has a bounded number of rows.
MERGES = 256

#: Scale of a term's weight and of its saturated frequency; parts of the length norm in hundredths.  Fixed values.
WEIGHT, IMPACT, NORM, FLAT, LENGTH = 1000, 1_000_000_000, 20, 50, 50

#: Bytes that are no part of a term become spaces, A-Z lower case; bytes of other characters stay.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()

HITS = "n long, terms array<int>, counts array<int>"


def terms_of(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and all characters beyond ASCII, with A-Z alone lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


@dataclass
class Block:
    """Items of one block: their ids, their terms' numbers and the vocabulary that these are of."""

    ids: list
    terms: list[np.ndarray]
    vocabulary: dict[bytes, int]


def blocks(items: Iterable[Row]) -> Iterator[Block]:
    """Rows ``item_id, text`` in blocks of at most ``ITEMS`` items and ``TERMS`` terms; items without terms have no rows to find."""
    block = Block([], [], {})
    for row in items:
        own = dict.fromkeys(terms_of(row["text"]))
        if block.ids and (len(block.ids) == ITEMS or len(block.vocabulary) + len(own) > TERMS):
            yield block
            block = Block([], [], {})
        block.ids.append(row["item_id"])
        block.terms.append(np.array([block.vocabulary.setdefault(w, len(block.vocabulary)) for w in own], np.int64))
    if block.ids:
        yield block


def count_terms(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """``doc_id, text`` -> ``doc_id`` and ``HITS`` of rows that have terms: how many, and which of the vocabulary how often."""
    for batch in batches:
        at, lengths, terms, counts = [], [], [], []
        for k, text in enumerate(batch.column("text").to_pylist()):
            words = terms_of(text)
            if words:
                known, often = np.unique(np.fromiter((i for i in map(vocabulary.get, words) if i is not None), np.int32), return_counts=True)
                at.append(k)
                lengths.append(len(words))
                terms.append(known)
                counts.append(often.astype(np.int32))
        ends = pa.array(np.cumsum([0, *map(len, terms)]), pa.int32())
        listed = (pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int32), *x])) for x in (terms, counts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(lengths, pa.int64()), *listed], names=["doc_id", "n", "terms", "counts"])


def vocabulary_tiles(weights: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of columns whose weighted impacts sum to less than ``EXACT``, at most ``COLUMNS`` wide."""
    most = IMPACT // WEIGHT  # no impact is larger, however often a term occurs
    tiles, lo, total = [], 0, 0
    for k, w in enumerate(weights.tolist()):
        if k > lo and (k - lo == COLUMNS or total + w * most >= EXACT):
            tiles.append((lo, k))
            lo, total = k, 0
        total += w * most
    return [*tiles, (lo, len(weights))] if len(weights) else tiles


def score_tile(lengths: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], tiles: list[tuple[int, int, np.ndarray]], documents: int, total: int) -> np.ndarray:
    """Scores (documents x items, int64) of one tile of documents; ``tiles`` are ranges of the vocabulary with their weights for each item."""
    row = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    column = np.concatenate([np.empty(0, np.int64), *terms]).astype(np.int64)
    often = np.concatenate([np.empty(0, np.int64), *counts]).astype(np.int64)
    norm = np.array([100 - FLAT + LENGTH * n * documents // total for n in lengths.tolist()], np.int64)
    impact = (IMPACT * often // (WEIGHT * often + NORM * norm[row])).astype(np.float64)
    scores = 0
    for lo, hi, weights in tiles:
        some = (column >= lo) & (column < hi)
        dense = np.zeros((len(terms), hi - lo))
        dense[row[some], column[some] - lo] = impact[some]
        scores = scores + (dense @ weights).astype(np.int64)
    return scores


def best_of(item: np.ndarray, score: np.ndarray, key: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` rows of each item, by score downwards, then key; ties at the edge are decided by the key alone."""
    order = np.lexsort((key, -score, item))
    turns = np.r_[True, np.diff(item[order]) != 0]
    first = np.flatnonzero(turns)[np.cumsum(turns) - 1]
    return order[np.arange(len(order)) - first < top]


def search_tiles(batches: Iterator[pa.RecordBatch], block: Block, weights: np.ndarray, documents: int, total: int, top: int) -> Iterator[pa.RecordBatch]:
    """``doc_id`` and ``HITS`` -> a task's best rows of each item: ``item`` (its place in the block), ``doc_id, score``."""
    tiles = []
    for lo, hi in vocabulary_tiles(weights):
        matrix = np.zeros((hi - lo, len(block.ids)))
        for k, own in enumerate(block.terms):
            own = own[(own >= lo) & (own < hi)]
            matrix[own - lo, k] = weights[own]
        tiles.append((lo, hi, matrix))
    item, score, key = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    least = np.ones(len(block.ids), np.int64)  # what a row must reach to be among the best so far
    for batch in batches:
        ids = batch.column("doc_id")
        # Ids in order, a missing one last.
        keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        keys = np.where(missing, np.iinfo(np.int64).max, keys)
        lengths, terms, counts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "terms", "counts"))
        for lo in range(0, len(ids), DOCUMENTS):
            part = slice(lo, lo + DOCUMENTS)
            found = score_tile(lengths[part], list(terms[part]), list(counts[part]), tiles, documents, total)
            d, k = np.nonzero(found >= least)
            item, score, key = np.r_[item, k], np.r_[score, found[d, k]], np.r_[key, keys[part][d]]
            keep = best_of(item, score, key, top)
            item, score, key = item[keep], score[keep], key[keep]
            full = np.bincount(item, minlength=len(least)) == top
            lowest = np.full(len(least), np.iinfo(np.int64).max)
            np.minimum.at(lowest, item, score)
            least = np.where(full, lowest, 1)
    yield pa.RecordBatch.from_pydict({"item": pa.array(item, pa.int32()), "doc_id": pa.array(key, pa.int64(), mask=key == np.iinfo(np.int64).max), "score": pa.array(score, pa.int64())})


def search(docs: DataFrame, items: DataFrame, top: int = 50) -> DataFrame:
    """The ``top`` documents of each item: ``item_id, rank int, doc_id long, score long``.

    Every row of ``docs(doc_id, text)`` is a document and every row of
    ``items(item_id, text)`` an item, repeats included (rows of a repeated item id
    are told apart by ``item_row``); only documents with a score above 0 are
    returned.  Equal scores are ranked by ascending ``doc_id``, a null id last;
    ids are integers.  Null and empty texts have no terms: such items find nothing, such
    documents count nowhere.  Empty tables give no rows; other columns are
    ignored.  The driver holds one block of items at a time.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = dict(items.dtypes)["item_id"]
    wanted = items.where("text is not null").select("item_id", "text").orderBy("item_id", "text")
    out, before = [], 0
    for block in blocks(wanted.toLocalIterator()):
        out.append(_search_block(docs, block, top, before, kind))
        before += len(block.ids)
    if not out:
        return spark.createDataFrame([], f"item_id {kind}, item_row long, rank int, doc_id long, score long")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _search_block(docs: DataFrame, block: Block, top: int, before: int, kind: str) -> DataFrame:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(block)
    hits = stored(docs.mapInArrow(lambda batches: count_terms(batches, sent.value.vocabulary), f"doc_id long, {HITS}"), "term-counts")
    documents, total = hits.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(len(block.vocabulary), np.int64)
    for row in hits.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        held[row["term"]] = row["count"]
    weights = np.array([math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)

    run = partial(_tiles_of, sent=sent, weights=weights, documents=documents, total=total, top=top)
    best = hits.mapInArrow(run, "item int, doc_id long, score long")
    by_rank = (F.desc("score"), F.asc_nulls_last("doc_id"))
    merge = Window.partitionBy("item", "part").orderBy(*by_rank)
    parts = best.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGES)))
    some = parts.withColumn("place", F.row_number().over(merge)).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by_rank))).where(F.col("rank") <= top)
    names = spark.createDataFrame([(k, x, before + k) for k, x in enumerate(block.ids)], f"item int, item_id {kind}, item_row long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "item_row", "rank", "doc_id", "score")


def _tiles_of(batches: Iterator[pa.RecordBatch], sent, **known) -> Iterator[pa.RecordBatch]:
    return search_tiles(batches, sent.value, **known)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = rf"""
WITH listed AS (SELECT doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT doc_id, len(terms) AS n FROM listed WHERE len(terms) > 0),
whole AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS total FROM sizes),
wanted AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
occurs AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM listed)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * documents + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM occurs, whole GROUP BY term, documents
),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * documents) // total)))) AS BIGINT) AS score
  FROM wanted JOIN occurs USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), whole GROUP BY item_id, doc_id
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
