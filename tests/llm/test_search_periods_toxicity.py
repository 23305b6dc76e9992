"""Ranked search, periodic runs and toxicity against brute force, planted cases and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from driftledger.llm import periods, queries, ranking, toxicity

DATA = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, top):
    terms = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    n, total = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(w for t in terms for w in set(t))
    out = []
    for item, text in items:
        scored = []
        for (doc, _), own in zip(docs, terms, strict=True):
            m = 100 - 50 + 50 * len(own) * n // total if total else 0
            tf = Counter(own)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * tf[w] // (1000 * tf[w] + 20 * m)) for w in set(TERM.findall((text or "").translate(LOWER))) & tf.keys())
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, k, None if missing else doc, -s) for k, (s, missing, doc) in enumerate(sorted(scored)[:top], 1)]
    return out


@pytest.mark.parametrize(("tile", "block", "exact"), [(4096, 1 << 17, 1 << 53), (7, 20, 1 << 53), (4096, 1 << 17, 1 << 34)])
def test_search_equals_plain_scores(spark, monkeypatch, tile, block, exact):
    for name, value in (("COLUMNS", tile), ("DOCUMENTS", tile), ("TERMS", block), ("EXACT", exact)):
        monkeypatch.setattr(ranking, name, value)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["É", "Ünï", "É", "42", "x_y", "I"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(150)]
    docs += [(500 + i, "w1 W1 w2,w3") for i in range(60)] + [(7, docs[7][1]), (None, "w1 w2"), (None, None), (900, None), (901, ""), (902, " .,;"), (903, "w5 " * 30000)]
    items = [(1, "w1 w2 w2 W3"), (2, ""), (3, None), (4, "nothing here"), (5, " ".join(words)), (6, "w5 é É")]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as score", "2 as item")
    asked = spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "3 as rank")
    found = [(r.item_id, r.rank, r.doc_id, r.score) for r in ranking.search(table, asked, 50).collect()]
    key = lambda r: (r[0], r[1])
    # Of rows alike any may come first.
    assert sorted(found, key=key) == sorted(plain_search(docs, items, 50), key=key)
    assert len({r[:2] for r in found}) == len(found)
    assert ranking.search(table.limit(0), asked).count() == ranking.search(table, asked.limit(0)).count() == 0


def test_search_of_repeated_items_and_ties(spark):
    docs = spark.createDataFrame([(i, "same words") for i in range(300)] + [(999, "other")], "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(1, "same"), (1, "same"), (1, "other")], "item_id long, text string")
    found = ranking.search(docs, items, 50).collect()
    assert len({(r.item_row, r.rank) for r in found}) == len(found) == 101
    assert all(r.doc_id == r.rank - 1 for r in found if r.doc_id != 999)


def plain_runs(w, least=1):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            part = w[s : s + size]
            if size >= max(least, 2 * q) and not any(part[r:] == part[: size - r] for r in range(1, q)):
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        w = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 40))]
        assert [tuple(r) for r in periods.runs_of(np.array(w, np.int64)).tolist()] == plain_runs(w)


@pytest.mark.parametrize("tree", [1 << 15, 20])
def test_runs_of_texts_equal_brute_force(monkeypatch, tree):
    monkeypatch.setattr(periods, "TREE", tree)
    rng = random.Random(3)
    for _ in range(200):
        texts = []
        for _ in range(3):
            w = []
            while len(w) < rng.randint(1, 120):
                root = [rng.randrange(rng.choice([2, 30])) for _ in range(rng.randint(1, 20))]
                w += [root[i % len(root)] for i in range(rng.randint(2, 50))] + [rng.randrange(30) for _ in range(rng.randint(0, 9))]
            texts.append(w)
        found = periods.runs_of_texts([np.array(w, np.int64) for w in texts])
        assert [[tuple(r) for r in f.tolist()] for f in found] == [plain_runs(w, 12) for w in texts]


def plain_periods(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words, 12)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digests = ["".join(f"{s},{size},{q}\n" for s, size, q in runs).encode(), b" ".join(w for i, w in enumerate(words) if i not in gone)]
    return (doc_id, len(runs), *longest, *(hashlib.sha256(x).hexdigest() for x in digests))


def test_periods_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 6000")
    odd = [(None, "a b " * 9), (10**6, None), (10**6 + 1, ""), (10**6 + 2, " \t\n"), *((3 * 10**6 + i, "x\xa0y z " * 7 + "é\ntail") for i in range(30)), (5, "word " * 5000), (5, "word " * 5000)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")).selectExpr("*", "1 as runs", "'x' as words", "2 as h")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = [tuple(r) for r in periods.digests(periods.periodic_runs(periods.with_planted_runs(docs))).collect()]
    want = {}
    plain = [want.setdefault(r, None) or want.update({r: plain_periods(*r)}) or want[r] for r in rows]
    assert sorted(map(str, found)) == sorted(map(str, plain))
    assert sum(r[1] > 0 for r in found) > 40
    assert periods.digests(periods.periodic_runs(docs.limit(0))).count() == 0


def test_fold_undoes_disguise():
    assert toxicity.fold("You 1d10t, ѕtupіd $cum!! ｃｌｏｗｎ lo​ser 12345 w%%% été") == "you idiot, stupid scum!! clown loser 12345 w%%% été"
    assert toxicity.fold(None) == toxicity.fold("") == ""


def planted(rng, n):
    """Texts of which one in eight holds insults; ``trash`` is one, but not in ``trash can``."""
    clean = [f"c{rng.choice('abcdef')}{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words, bad = rng.choices(clean, k=rng.randint(5, 300)), i % 8 == 0
        if bad:
            for w in rng.choices(["idiot", "moron", "trash", "zorgle" + rng.choice(["n", "t", "rk", "st"])], k=rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), w)
        elif i % 8 == 1:
            at = rng.randrange(len(words))
            words[at:at] = ["trash", "can"]
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_of_planted_words_and_exceptions(spark):
    rows = planted(random.Random(4), 1600)
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(table, table.select("doc_id", "toxic"))
    assert {" idiot ", " moron ", " trash "} <= set(lexicon.weights) and any(w.startswith(" zorgle") for w in lexicon.weights)
    assert "trash can" in lexicon.exceptions
    new = [(1, "ca1 cb2 an idiot and a moron"), (2, "cd1 a Trash can, a trash can"), (3, "cc3 1d10t m0rоn ce9"), (4, None), (5, ""), (6, "ca3 cf7 " * 9000), (6, "ca3 cf7 " * 9000), (None, "idiotic ca1 cb2"), (7, "zorglexx ca1 zorglen trash")]
    odd = spark.createDataFrame(new, "doc_id long, text string").selectExpr("*", "0.5 as toxicity", "'x' as score")
    found = sorted((str(r.doc_id), r.toxicity >= 0.3, r.score) for r in toxicity.score(odd, lexicon).collect())
    assert found == sorted((str(i), i in (1, 3, 7), "x") for i, _ in new)
    assert all(0 <= r.toxicity <= 1 for r in toxicity.score(odd, lexicon).collect())


def test_toxicity_without_labels_or_toxic_rows(spark):
    docs = spark.createDataFrame([(1, "an idiot"), (2, "fine words")], "doc_id long, text string")
    for labels in ([], [(1, None)], [(1, 0), (2, 0)], [(1, 1), (1, 0)], [(None, 1)]):
        lexicon = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert not lexicon.weights and all(r.toxicity < 0.3 for r in toxicity.score(docs, lexicon).collect())
    assert toxicity.score(docs.limit(0), toxicity.Lexicon()).count() == 0


def test_toxicity_query_on_held_out_rows(spark):
    path = "/root/testdata/sf0.1"
    found = queries.QUERIES["op13_toxicity"](spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").toPandas()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    assert ((found.score >= 0.3) == (found.predicted == 1)).all() and found.score.between(0, 1).all()
    held = found[found.held_out]
    # Some labelled texts hold nothing that tells them.
    assert held[held.toxic == 1].predicted.mean() > 0.8 and held[held.toxic == 0].predicted.mean() < 0.01
