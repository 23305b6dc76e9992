"""Language identification with hyperdimensional profiles.

Each letter, of any script, has a random vector of +1 and -1 of its own.  A trigram's vector is the product
of its letters' vectors, the first rolled by two places and the second by one.  A
text's vector is the sum over its trigrams; a language's prototype is the sum of
its training texts' unit vectors.  The prediction is the language whose prototype
has the greatest cosine with the text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import prepare

DIMENSIONS = 1024
SEED = 20240607
#: Languages that may be learned; prototypes of so many are sent to the tasks.
LANGUAGES = 1000
UNDETERMINED = "und"
#: Unit vectors are summed as integers of this scale, so that order can't matter.
SCALE = 1 << 24


#: Bits of a code point; a trigram's code is three of them.  0 is a word's edge.
BITS = 21
POINT = (1 << BITS) - 1


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@functools.lru_cache(20_000)
def letter_vector(point: int, dimensions: int) -> np.ndarray:
    """The random vector of +1 and -1 of a letter, or of a word's edge (0); each code point has its own."""
    return np.random.default_rng((SEED, point)).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1


class Trigrams:
    """Vectors of the trigrams met so far; starts anew when full."""

    FULL = 30_000

    def __init__(self, dimensions: int) -> None:
        self.dimensions = dimensions
        self.row: dict[int, int] = {}
        self.table = np.empty((self.FULL, dimensions), np.float32)

    def of(self, codes: np.ndarray) -> np.ndarray:
        if len(codes) > self.FULL:
            return self._bind(codes)
        if len(self.row) + len(codes) > self.FULL:
            self.row.clear()
        new = [c for c in codes.tolist() if c not in self.row]
        if new:
            lo = len(self.row)
            self.table[lo : lo + len(new)] = self._bind(np.array(new))
            self.row.update(zip(new, range(lo, lo + len(new)), strict=True))
        return self.table[[self.row[c] for c in codes.tolist()]]

    def _bind(self, codes: np.ndarray) -> np.ndarray:
        points = np.stack([codes >> 2 * BITS, codes >> BITS & POINT, codes & POINT])
        known, at = np.unique(points, return_inverse=True)
        vectors = np.stack([letter_vector(p, self.dimensions) for p in known.tolist()])
        first, second, third = at.reshape(points.shape)
        return (np.roll(vectors, 2, 1)[first] * np.roll(vectors, 1, 1)[second] * vectors[third]).astype(np.float32)


@functools.lru_cache(4)
def _trigrams(dimensions: int) -> Trigrams:
    return Trigrams(dimensions)


def trigram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a text's letter trigrams, word edges as a letter; empty if it has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    points = np.where(_letters()[points], points, 0)
    points = np.r_[0, points, 0]
    keep = np.r_[True, (points[1:] > 0) | (points[:-1] > 0)]  # one edge between words
    points = points[keep]
    if not points.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = (points[:-2] << 2 * BITS) | (points[1:-1] << BITS) | points[2:]
    return np.unique(codes, return_counts=True)


def unit_vectors(texts: list[str | None], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of texts and whether each has a letter."""
    out = np.zeros((len(texts), dimensions), np.float32)
    table = _trigrams(dimensions)
    for lo in range(0, len(texts), 32):
        counted = [trigram_counts(t) for t in texts[lo : lo + 32]]
        codes, at = np.unique(np.concatenate([c for c, _ in counted]), return_inverse=True)
        if not len(codes):
            continue
        dense = np.zeros((len(counted), len(codes)), np.float32)
        dense[np.repeat(np.arange(len(counted)), [len(c) for c, _ in counted]), at] = np.concatenate([n for _, n in counted])
        for k in range(0, len(codes), Trigrams.FULL):
            out[lo : lo + 32] += dense[:, k : k + Trigrams.FULL] @ table.of(codes[k : k + Trigrams.FULL])
    norms = np.linalg.norm(out, axis=1)
    return out / np.maximum(norms, 1e-9)[:, None], norms > 0


def learn(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes of the non-null ``lang`` of ``docs(text, lang)``, as unit vectors.

    Each task sums its texts' vectors for each language, so that the shuffle has
    one number for each task, language and dimension.  A text without a letter adds
    nothing; an empty table gives no prototypes.  Raises if there are more
    than ``LANGUAGES`` languages.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            vectors, _ = unit_vectors(batch.column("text").to_pylist(), dimensions)
            for lang in set(langs):
                part = np.rint(vectors[langs == lang].astype(np.float64) * SCALE).astype(np.int64).sum(0)
                sums[lang] = sums.get(lang, 0) + part
        for lang, total in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * dimensions, pa.string()), "dim": pa.array(range(dimensions), pa.int32()), "total": pa.array(total, pa.int64())})

    known = docs.where("lang is not null and text is not null").select("lang", "text")
    sums = known.mapInArrow(run, "lang string, dim int, total long").groupBy("lang", "dim").agg(F.sum("total").alias("total"))
    vectors: dict[str, np.ndarray] = {}
    for lang, dim, total in sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "total"))).alias("v")).limit(LANGUAGES + 1).selectExpr("lang", "v.dim", "v.total").toLocalIterator():
        vectors[lang] = np.zeros(dimensions)
        vectors[lang][dim] = total
    if len(vectors) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    return {k: v / max(np.linalg.norm(v), 1e-9) for k, v in vectors.items()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the greatest cosine cut to 0 to 1.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was
    learned; ties go to the language that sorts first.  Columns of those names
    are replaced; all others and repeated rows stay.
    """
    prepare(docs.sparkSession)
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float32).reshape(len(names), dimensions)

    @F.pandas_udf("lang_pred string, score double")
    def best(texts):
        import pandas as pd

        vectors, some = unit_vectors(texts.tolist(), dimensions)
        if not names:
            return pd.DataFrame({"lang_pred": [UNDETERMINED] * len(texts), "score": 0.0})
        cosines = np.round((vectors @ matrix.T).astype(np.float64), 6)
        at = cosines.argmax(1)
        score = np.where(some, np.clip(cosines[np.arange(len(at)), at], 0, 1), 0.0)
        return pd.DataFrame({"lang_pred": np.where(some, np.array(names, object)[at], UNDETERMINED), "score": score})

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, best("text").alias("__best")).select(*kept, "__best.lang_pred", "__best.score")
