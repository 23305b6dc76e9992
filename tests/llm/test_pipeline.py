"""The pipeline and each of its stages against plain versions, on small tables."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm import DATA, ODD, brute_groups, plain_tiles
from tokenizers import Tokenizer

import corpus_pipeline
from driftledger.llm import decontaminate, langid


def plain_language(rows):
    vectors, some = langid.unit_vectors([r.text for r in rows], langid.DIMENSIONS)
    names = sorted({r.lang for r in rows if r.lang is not None and r.text is not None})
    sums = [sum(v.astype(float) for v, r in zip(vectors, rows, strict=True) if r.lang == n and r.text is not None) for n in names]
    cosines = np.array([vectors @ (s / max(np.linalg.norm(s), 1e-9)) for s in sums]).T
    return [r for r, c, ok in zip(rows, cosines, some, strict=True) if ok and names[c.argmax()] in corpus_pipeline.WANTED and c.max() >= 3 / 32]


def plain_dedup(rows):
    """One row of each group of similar texts: that of its smallest id, of the smaller digest if it has several."""
    first = {}
    for r in rows:
        if r.doc_id is not None and r.text is not None:
            first[r.text] = min(r.doc_id, first.get(r.text, r.doc_id))
    texts = sorted(first, key=lambda t: (first[t], hashlib.sha256(t.encode()).hexdigest()))
    gone = brute_groups(texts).keys()
    kept = [r for r in rows if r.doc_id is None or r.text is None]
    of = {(r.doc_id, r.text): r for r in rows}
    return kept + [of[first[t], t] for k, t in enumerate(texts) if k not in gone]


def plain_clean(rows, items):
    def holds(text, item):
        words, own = decontaminate.words_of(text), decontaminate.words_of(item)
        if len(own) < 5:
            return bool(own) and any(words[i : i + len(own)] == own for i in range(len(words)))
        runs = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        if not runs & {tuple(own[i : i + 5]) for i in range(len(own) - 4)}:
            return False
        number = {w: i for i, w in enumerate(dict.fromkeys(own), 1)}
        tiles = plain_tiles([number.get(w, 0) for w in words], [number[w] for w in own], 3)
        return bool(tiles) and tiles[0][2] >= 5 and sum(t[2] for t in tiles) >= 0.8 * len(own)

    return [r for r in rows if not any(holds(r.text, i) for i in items if i is not None)]


def plain_encoding(rows):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        out.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return out


def plain(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def items(spark):
    return [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]


@pytest.fixture(scope="module")
def tables(spark, items):
    """The small documents; and odd ones, with a copy, a contaminated one and columns that clash."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    base = " ".join(f"wort{i} mit" for i in range(60))
    more = [(30, base, "de", "s", 1), (31, base + " ende", "de", None, None), (32, items[0], "en", "s", 1), (None, items[0], "en", "s", 1), (33, "qzxj", None, "s", 1)]
    odd = spark.createDataFrame([(*r, 1) for r in ODD] + more, schema)
    for name in ("key", "item_id", "lang_pred", "score", "row", "id", "fp", "__text"):
        odd = odd.withColumn(name, F.lit("clash"))
    return [spark.read.parquet(f"{DATA}/documents.parquet"), odd]


def test_stages_equal_plain_versions(spark, tables, items):
    versions = {"language": plain_language, "near_dedup": plain_dedup, "decontamination": lambda rows: plain_clean(rows, items), "encoding": plain_encoding}
    assert [n for n, _ in corpus_pipeline.STAGES] == list(versions)
    for docs in tables:
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, DATA)
            assert plain(found.collect()) == plain(versions[name](docs.collect())), name
            assert name == "encoding" or found.columns == docs.columns
            assert stage(spark, docs.limit(0), DATA).count() == 0


def test_run_equals_plain_versions(spark, items):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = plain_encoding(plain_clean(plain_dedup(plain_language(rows)), items))
    assert plain(corpus_pipeline.run(spark, DATA).collect()) == plain(want) and len(want) > 100
