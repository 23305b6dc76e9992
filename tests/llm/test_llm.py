"""The training-data operators against brute force, round trips, libraries and SQL, on small tables."""

import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftledger.llm import bpe, decontaminate, html, kdshards, langid, licenses, media, queries, simhash, tokencount, warc

DATA = "/root/testdata/sf0.001"
ODD = [
    (1, None, "en", "s"), (2, "", None, "s"), (3, "A.", "en", None), (3, "A.", "en", None), (None, "no id", "en", "s"),
    (5, "word " * 5000, "en", "s"), (6, "Σ é 中文 😀 <|endoftext|> x", "fr", "s"), (7, "   \n\t ", "en", "s"),
    *((10 + i, "the same text again and again in many rows of it", "en", "s") for i in range(9)),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return rows.withColumn("size", F.lit(1)).withColumn("path", F.lit("x")).withColumn("key", F.lit("k"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = duck.execute(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()[list(want.columns)]
    plain = lambda f: sorted(tuple("" if pd.isna(x) else str(x).removesuffix(".0") for x in r) for r in f.astype(object).itertuples(index=False))
    assert plain(got) == plain(want)


def test_bpe_equals_library(odd, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for table in (odd, docs):
        rows = table.select("doc_id", "text").collect()
        found = bpe.encode_documents(table, public_tokenizers.path("word_bpe_49k.json"), with_ids=True).collect()
        assert len(found) == len(rows)
        want = sorted((str(r.doc_id), tuple(library.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)
        assert sorted((str(r.doc_id), tuple(r.ids)) for r in found) == want
        assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in found)
        assert all(hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256 for r in found)


def brute_components(fps, radius):
    fps = np.array(sorted(set(fps)), np.int64)
    u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i in range(len(fps) - 1):
        hit = fps[i + 1 :][np.bitwise_count((fps[i + 1 :] ^ fps[i]).view(np.uint64)) <= radius]
        u.append(np.full(len(hit), fps[i]))
        v.append(hit)
    return dict(zip(*simhash.forest(np.concatenate(u), np.concatenate(v)), strict=True))


@pytest.mark.parametrize(("radius", "tile"), [(3, 4096), (14, 16)])
def test_simhash_equals_brute_force(docs, odd, radius, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    for table in (docs, odd):
        found = simhash.near_duplicates(table, 3, radius).toPandas()
        assert len(found) == table.count()
        labels = brute_components(found.fp, radius)
        found["group"] = found.fp.map(lambda x: labels.get(x, x))
        assert (found.component_id.fillna(-1) == found.groupby("group").doc_id.transform("min").fillna(-1)).all()


def test_deduplicate_keeps_one_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(1, base), (2, base), (3, base + " tail"), (4, " ".join(f"v{i}" for i in range(200))), (5, None), (6, None), (None, base), (7, ""), (8, "")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "4", "5", "6", "7", "None"]


def test_deduplicate_tells_texts_of_one_id_apart(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(80)) for c in "xyz")
    rows = [(3, x), (5, x), (5, y), (9, z), (9, z), (9, z + " more"), (7, y + " and more"), (5, z + " even more"), (1, "other"), (1, "another")]
    found = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as key", "1 as first"))
    # z's group has id 5 as its smallest, by another text than y's.
    assert sorted((r.doc_id, r.text) for r in found.collect()) == sorted([(3, x), (5, y), (5, z + " even more"), (1, "other"), (1, "another")])
    assert found.columns == ["doc_id", "text", "key", "first"]


@pytest.mark.parametrize("tile", [4096, 8])
def test_similar_groups_of_many_copies_equal_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    random = np.random.default_rng(1)
    rows = []
    for base in range(3):  # copies of a text, each with other words changed
        words = [f"b{base}w{i}" for i in range(150)]
        for _ in range(25):
            copy = list(words)
            for i in random.integers(0, 150, random.integers(0, 7)):
                copy[i] = f"x{random.integers(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    want = brute_groups([t for _, t in rows])
    found = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 0.8).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.component for r in found if r.node != r.component} == want and len(want) > 20


def brute_groups(texts):
    """Place of a text -> the smallest that it reaches by similar pairs, over all pairs; only where they differ."""
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    alike = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return dict(zip(*(x.tolist() for x in simhash.forest(*np.array(alike).T)), strict=True)) if alike else {}


def test_near_duplicates_are_found_at_every_distance(spark):
    """Planted pairs of similarity 0.8 to 1: recall by the bits in which their fingerprints differ."""
    random = np.random.default_rng(3)
    rows, distance = [], {}
    for base in range(250):
        words = [f"b{base}w{i}" for i in range(random.integers(30, 400))]
        copy = list(words)
        for i in random.choice(len(words), max(1, len(words) // random.integers(46, 200)), replace=False):
            copy[i] = f"x{random.integers(10**6)}"
        a, b = (np.unique(simhash.shingle_hashes(" ".join(x), 5)) for x in (words, copy))
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            distance[len(rows) + 1] = bin((simhash.fingerprint(a) ^ simhash.fingerprint(b)) & ((1 << 64) - 1)).count("1")
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(copy))]
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not kept & distance.keys() and kept == {i - 1 for i in distance}
    assert len(distance) > 100 and max(distance.values()) > 10 and min(distance.values()) < 6


@pytest.mark.parametrize(("tile", "pairs"), [(4096, 250_000), (16, 50)])
def test_similar_groups_equal_all_pairs_without_a_radius(spark, tile, pairs, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    monkeypatch.setattr(simhash, "SAMPLES", (1, 2, 4))
    random = np.random.default_rng(2)
    rows, line = [], "this line stands in every one of the texts"
    for base in range(120):  # a text and one copy, about 0.8 alike
        words = [f"b{base}w{i}" for i in range(100)]
        copy = list(words)
        for i in random.choice(20, random.integers(1, 4), replace=False):
            copy[5 * i + 2] = f"x{random.integers(10**6)}"
        rows += [(len(rows), f"{line} {' '.join(words)}"), (len(rows) + 1, f"{line} {' '.join(copy)}")]
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(len(rows), f"{' '.join([passage] * 40)} q r"), (len(rows) + 1, f"{passage} q r s")]  # a repeated passage
    want = brute_groups([t for _, t in rows])
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicate(texts).collect()) == sorted({i for i, _ in rows} - want.keys())
    found = simhash.similar_groups(texts, 5, 0.8).collect()
    assert {r.node: r.component for r in found if r.node != r.component} == want and len(want) > 60


def test_language_held_out_accuracy(spark, docs, odd):
    split = queries.held_out(docs)
    found = langid.predict(split, langid.learn(split.where("not held_out"))).where("held_out").select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)
    prototypes = langid.learn(odd)
    undetermined = {str(r.doc_id) for r in langid.predict(odd, prototypes).collect() if r.lang_pred == "und"}
    assert undetermined == {"1", "2", "7"}
    assert {r.lang_pred for r in langid.predict(odd, {}).collect()} == {"und"}


def test_language_vectors_equal_plain_binding(spark):
    dims = 64
    texts = ["The cat, the Hat", "中文字", "ab", "1 2", "Ünïcode ß"]

    def plain(text):
        total, words = np.zeros(dims), "".join(c if c.isalpha() else " " for c in text.lower()).split()
        letters = [0, *(p for w in words for p in (*map(ord, w), 0))]
        for a, b, c in zip(letters, letters[1:], letters[2:]):
            total += np.roll(langid.letter_vector(a, dims), 2) * np.roll(langid.letter_vector(b, dims), 1) * langid.letter_vector(c, dims)
        return total / max(np.linalg.norm(total), 1e-9)

    found, some = langid.unit_vectors(texts, dims)
    assert np.allclose(found, [plain(t) for t in texts], atol=1e-5) and some.tolist() == [True, True, True, False, True]
    vectors = [langid.letter_vector(p, dims) for p in (0x4E00, 0x4E00 + 1023, 0xAC00)]  # no two letters share one
    assert len({v.tobytes() for v in vectors}) == 3
    rows = [("The cat sat", "a"), ("Le chat noir", "b"), ("The dog ran", "a"), (None, "a"), ("1", "b")]
    learned = langid.learn(spark.createDataFrame(rows, "text string, lang string"), dims)
    sums = {k: sum(plain(t) for t, lang in rows if lang == k and t) for k in "ab"}
    assert all(np.allclose(learned[k], v / np.linalg.norm(v), atol=1e-5) for k, v in sums.items())
    found = langid.predict(spark.createDataFrame(rows, "text string, lang string"), learned, dims).collect()
    cosine = [max(float(plain(t or "") @ learned[k]) for k in "ab") for t, _ in rows]
    assert np.allclose([r.score for r in found], np.clip(cosine, 0, 1), atol=1e-4)
    # A tie goes to the language that sorts first; an empty table has neither prototypes nor predictions.
    tied = langid.predict(spark.createDataFrame(rows, "text string, lang string"), {"z": learned["a"], "y": learned["a"]}, dims)
    assert {r.lang_pred for r in tied.collect()} == {"y", "und"}
    assert langid.learn(spark.createDataFrame([], "text string, lang string")) == {}


def plain_count(trie, token):
    """Tokens of the best path by plain dynamic programming over positions."""
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        ways = [(best[s][0] - trie.score[token[s:end]], best[s][1] + 1) for s in range(max(0, end - trie.longest), end) if token[s:end] in trie.score]
        if token[end - 1] not in trie.score:
            size = len(token[end - 1].encode())
            ways.append((best[end - 1][0] - trie.unknown, best[end - 1][1] + size))
        best.append(min(ways))
    return best[-1][1]


def test_token_counts_equal_plain_dynamic_programming(odd, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    trie = tokencount.UnigramTrie(path)
    for table in (odd, docs.limit(60)):
        texts = sorted((str(r.doc_id), sum(plain_count(trie, "▁" + w) for w in (r.text or "").split())) for r in table.select("doc_id", "text").collect())
        assert sorted((str(r.doc_id), r.n_tokens) for r in tokencount.token_counts(table, path).collect()) == texts
    assert tokencount.token_counts(odd.limit(0), path).count() == 0


def test_token_scores_are_the_vocabulary_s():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    trie = tokencount.UnigramTrie(public_tokenizers.path("piece_bpe_32k.model"))
    assert all(trie.score[model.id_to_piece(i)] == model.get_score(i) for i in range(259, model.get_piece_size(), 97))


@pytest.mark.parametrize("size", [255, 256, 257, 1000, 100_000])
def test_token_counts_of_long_words_equal_plain_dynamic_programming(size):
    trie = tokencount.UnigramTrie(public_tokenizers.path("piece_bpe_32k.model"))
    random = np.random.default_rng(size)
    pieces = sorted(p for p in trie.score if "▁" not in p and p.split() == [p])
    for word in ("".join(random.choice(pieces, size))[:size], ("internationalization中文é" * size)[:size]):
        assert trie.count(word) == (plain_count(trie, "▁" + word), 1)
        assert trie.count(f"{word} {word}")[0] == 2 * trie.count(word)[0]


def test_token_counts_hold_when_the_trie_starts_anew(monkeypatch):
    monkeypatch.setattr(tokencount, "NODES", 50)
    trie = tokencount.UnigramTrie(public_tokenizers.path("piece_bpe_32k.model"))
    words = [f"word{i} other{i % 7}" for i in range(200)]
    assert trie.count(" ".join(words)) == (sum(plain_count(trie, "▁" + w) for x in words for w in x.split()), 400)


def test_media_round_trip(odd, docs):
    for table in (odd, docs):
        texts = [media.payload_of(r.text) for r in table.select("text").collect()]
        want = sorted((n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for p, n in texts)
        found = media.media_facts(table).collect()
        assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found) == want
        assert len({(r.payload_sha256, r.media_sha256, r.media_bytes, r.feature) for r in found}) == len({r.payload_sha256 for r in found})


def stored_media(path):
    """Key -> form of each medium, from the store's files alone: its list, then its chunks wherever they are stored."""
    import pyarrow.parquet as pq

    rows = [r for part in ("alone", "sharing") for r in pq.read_table(f"{path}/{part}").to_pylist()]
    chunks = {}
    for row in rows:
        listed, at = media.entries(row["head"]), 0
        for i in row["own"]:
            chunks[listed[i][0]] = row["samples"][at : at + listed[i][1]]
            at += listed[i][1]
        assert at == len(row["samples"])
    assert sum(len(r["own"]) for r in rows) == len(chunks)  # each different chunk is stored once
    return {r["key"]: r["head"] + b"".join(chunks[d] for d, _ in media.entries(r["head"])) for r in rows}


def test_media_columns_are_of_the_stored_files(spark, odd, docs, tmp_path):
    nul = spark.createDataFrame([(1, ""), (2, "\0"), (3, None), (4, "x" * 70_000), (5, "x" * 90_000)], "doc_id long, text string")
    for k, table in enumerate((odd, docs, nul)):
        path = f"{tmp_path}/{k}"
        media.write_store(table, path)
        want = stored_media(path)
        found = {r.key: r for r in media.read_store(spark, path).collect()}
        assert found.keys() == want.keys()
        for key, form in want.items():
            r = found[key]
            assert (r.media_bytes, r.media_sha256) == (len(form), hashlib.sha256(form).hexdigest())
            payload = form[-r.payload_bytes :]
            samples = np.frombuffer(payload, np.uint8).astype(float)
            assert hashlib.sha256(payload).digest() == key
            plain = f"mean={samples.mean():.6f};deviation={samples.std():.6f};peak={int(samples.max())};step={np.abs(np.diff(samples)).mean():.6f}"
            assert r.feature == f"chunks={int.from_bytes(form[8:12], 'little')};{plain}"
    assert media.media_facts(nul).count() == 5 and media.media_facts(nul.limit(0)).count() == 0


def test_shards(odd, docs):
    for table, even in ((odd, False), (docs, True)):
        found = kdshards.shard_documents(table, 8).toPandas()
        assert len(found) == table.count()
        for _, rows in found.groupby("shard"):
            assert sorted(rows.slot) == list(range(len(rows)))
        sizes = found.groupby("shard")["size"].sum()
        assert not even or sizes.max() < 1.2 * sizes.min()
    assert kdshards.shard_documents(docs.limit(0), 8).count() == 0
    assert kdshards.shard_documents(docs.select("doc_id", "text"), 3).count() == docs.count()


@pytest.mark.parametrize("heavy", [0.02, 0.2, 10.0])
def test_equal_texts_share_a_shard_unless_one_is_too_small(spark, heavy):
    rows = [(i, f"text {i % 40} " + "w" * (i % 40)) for i in range(400)] + [(1000 + i, "twenty equal texts, a good part of a shard " * 3) for i in range(20)]
    docs = spark.createDataFrame([(i, t, "x" * 20 + str(i % 7), None) for i, t in rows], "doc_id long, text string, lang string, source string")
    found = kdshards.shard_documents(docs, 4, heavy=heavy).toPandas()
    assert (found.groupby(["text_crc32", "size"]).shard.nunique() == 1).all()
    sizes = found.groupby("shard")["size"].sum()
    assert heavy > 1 or sizes.max() < (1.1 if heavy < 0.1 else 1.3) * sizes.min()
    # Equal texts of more bytes than a shard may have are dealt into parts.
    hot = docs.union(spark.createDataFrame([(5000 + i, "hot text", None, None) for i in range(9000)], docs.schema))
    found = kdshards.shard_documents(hot, 4, heavy=heavy).toPandas()
    texts = found.groupby(["text_crc32", "size"]).agg(n=("doc_id", "size"), shards=("shard", "nunique"))
    assert (texts.shards[texts.n < 9000] == 1).all() and (texts.shards[texts.n == 9000] > 1).all()
    sizes = found.groupby("shard")["size"].sum()
    assert heavy > 1 or sizes.max() < (1.1 if heavy < 0.1 else 1.3) * sizes.min()


def test_heavy_weights_are_dealt_and_shares_filled():
    assert kdshards.deal([9, 5, 5, 4, 1], 3) == ([0, 1, 2, 1, 2], [9, 9, 6])
    assert kdshards.filled([9, 2, 0], 4) == [0.0, 1.0, 3.0] and kdshards.filled([0, 0], 0) == [0.0, 0.0]
    assert kdshards.filled([5, 5, 5], 6) == [2.0, 2.0, 2.0]


def test_names_are_ranked_as_whole_strings(spark):
    names = [None, "", "same start a", "same start b", "same start", "é", "z", "Z", "same start b"] + [f"n{i:03}" for i in range(300)]
    rows = spark.createDataFrame([(n,) for n in names], "lang string").repartition(5)
    found = {r.lang: r.lang_code for r in kdshards.ranked(rows, "lang").collect()}
    order = sorted({n or "" for n in names}, key=str.encode)
    assert found == {n: order.index(n or "") for n in names}


def plain_kd(points, dims, leaves, first=0, span=None):
    """A recursive k-d tree over (weight, atom, *coordinates): atom -> leaf, by exact weighted medians."""
    span = span or [max(1, max(p[2 + k] for p in points) - min(p[2 + k] for p in points)) for k in range(dims)]
    if leaves == 1 or not points:
        return {p[1]: first for p in points}
    width = [(max(p[2 + k] for p in points) - min(p[2 + k] for p in points)) / span[k] for k in range(dims)]
    dim = width.index(max(width))
    ordered = sorted(points, key=lambda p: (p[2 + dim], p[1]))
    want, below, n = sum(p[0] for p in points) * (leaves // 2) / leaves, 0, 0
    while below + ordered[n][0] <= want:
        below += ordered[n][0]
        n += 1
    n += want - below > below + ordered[n][0] - want  # the cut's nearer side
    return plain_kd(ordered[:n], dims, leaves // 2, first, span) | plain_kd(ordered[n:], dims, leaves - leaves // 2, first + leaves // 2, span)


@pytest.mark.parametrize("leaves", [1, 2, 5, 8])
def test_kd_leaves_equal_plain_recursion(spark, leaves):
    random = np.random.default_rng(leaves)
    points = [(int(random.integers(1, 50)), int(a), int(random.integers(0, 1000)), int(random.integers(0, 4)) * 10**15) for a in random.permutation(5000)[:700]]
    table = spark.createDataFrame(points, "weight long, atom long, x long, y long")
    found = {r.atom: r.leaf for r in kdshards.kd_leaves(table, ["x", "y"], leaves, tolerance=0).collect()}
    assert found == plain_kd(points, 2, leaves)


def test_warc_loser_tree_and_revisits(spark):
    runs = [[1, 4, 9], [], [2, 2, 3], [0], [5, 6, 7, 8]]
    for k in range(6):
        assert list(warc.loser_tree(list(map(iter, runs[:k])))) == sorted(sum(runs[:k], []))
    pages = [(3, "http://www.B.com/x#y", "same"), (1, "http://a.com", "same"), (2, None, None), (4, "bad url\r\n", ""), (5, "http://a.com", "a\r\n\r\nb é")]
    found = warc.archive_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in found} == {1: ("response", None, 4), 3: ("revisit", 1, 4), 2: ("response", None, 0), 4: ("revisit", 2, 0), 5: ("response", None, 9)}
    assert [r.url_key for r in found] == sorted(r.url_key for r in found)


def test_warc_cuts_archives_by_running_bytes(spark, tmp_path):
    pages = [(i, f"http://h.com/{i % 9}", "p" * 2000) for i in range(300)] + [(300, "http://h.com/big", "b" * (20 << 20)), (None, None, None), (7, "http://h.com/7", "p" * 2000)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("archive", F.lit("x")).coalesce(1)
    path = f"{tmp_path}/warc"
    warc.write_archives(warc.captures(rows), path)
    files = [p.stat().st_size for p in tmp_path.rglob("part-*.txt")]
    assert 2 <= len(files) <= 3 and sum(files) > 20 << 20
    index = warc.merged_index(warc.read_archives(spark, path)).collect()
    assert len(index) == 303
    order = [(r.url_key, r.captured_at, r.page_id is not None, r.page_id or 0, r.archive, r.record_offset) for r in index]
    assert order == sorted(order)
    assert sorted(r.payload_bytes for r in index)[-1] == 20 << 20
    assert warc.archive_pages(rows.limit(0)).count() == 0


def test_html(spark):
    body = "<p>First, a paragraph of text &amp; more.<p>Second   one,\n with <b>bold</b>.</p>"
    page = f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=x>Home</a></nav><div class=ad>Buy.</div><article><h1>Title</h1>{body}<div class='comments'><p>A comment, long enough to count.</p></div></article><footer>End.</footer>"
    rows = [(i, f"http://h.com/{i}", page) for i in range(3)] + [(9, None, None), (10, "http://h.com/10", "")]
    found = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = "Title\nFirst, a paragraph of text & more.\nSecond one, with bold."
    assert found[0].text == want and found[0].n_chars == len(want)
    assert found[9].text == "" and found[10].text == ""


@pytest.mark.parametrize("wrapper", ["div class='site has-sidebar'", "div id='page' class='no-sidebar'", "div class='sidebar'", "div", "form"])
def test_html_wrappers_named_like_furniture(wrapper):
    article = "<article><p>A text of several words, and more of them.</p><p>With <math><mi>x</mi></math> in it.</p><div class='post-comments'><p>A comment, longer than all of the article, that says little of note, but goes on and on, and so on.</p></div></article>"
    for inside in (article, article.replace("article", "section")):
        page = html.Page(f"<body><{wrapper}>{inside}<div class='ad'>Buy.</div></{wrapper.split()[0]}><script>x</script></body>")
        text = page.extract(max(page.scores(), key=page.scores().get))[0]
        assert "A text of several words, and more of them.\nWith x in it." in text
    assert "before" in html.Page("<p>before</p><svg><p>after</p>").extract(None)[0]


ARTICLE = "<p>A text of several words, and more of them.</p><p>Then another one, which is longer.</p>"
TEXT = "A text of several words, and more of them.\nThen another one, which is longer."


def text_of(markup):
    page = html.Page(markup)
    scores = page.scores()
    return page.extract(min(scores, key=lambda p: (-scores[p], p)) if scores else None)[0]


@pytest.mark.parametrize(
    ("markup", "want"),
    [
        ("<p title=it's>Hello there.</p>", "Hello there."),
        ("<!-->" + ARTICLE, TEXT),
        ("<!--->" + ARTICLE + "<!-- <p>not this</p> --!>", TEXT),
        (f"<div class='content-with-sidebar'><article>{ARTICLE}</article></div>", TEXT),
        (f"<div class='site header-fixed'><article>{ARTICLE}</article></div>", TEXT),
        (f"<article>{ARTICLE}<section id='discussion'><p>Discussed.</p></section><div class='search'><p>Found.</p></div></article>", f"{TEXT}\nDiscussed.\nFound."),
        (f"<article>{ARTICLE}<div class='comments'><p>{'A long comment, by a reader. ' * 20}</p></div></article>", TEXT),
        (f"<div class='sidebar'><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><div class='post'>{ARTICLE}</div>", TEXT),
        (f"<div><ul><li><a href=a>First menu</a><li><a href=b>Second</a><li><a href=c>Third</a></ul></div><div>{ARTICLE * 3}</div>", "\n".join([TEXT] * 3)),
        (f"<form action=x><div class='notice'>We use cookies.</div><div>{ARTICLE}</div></form>", TEXT),
        (f"<div class='related'><article><p>Teaser.</p></article></div><article>{ARTICLE}</article>", TEXT),
        (f"<article><header><h1>Head</h1><p>by one</p></header>{ARTICLE}<footer>End</footer></article>", f"Head\n{TEXT}"),
        ("<div>" * 300 + ARTICLE + "</div>" * 300, TEXT),
        ("<table><tr><td>a.<td>b.<tr><td>c.</table>", "a.\nb.\nc."),
        ("<p>1 < 2 &lt; 3 &amp;amp; &copy;</p><p>cut <a hre", "1 < 2 < 3 &amp; ©\ncut"),
        ("<article><p>Shown.<p hidden>Not<p style='display: none'>Nor</article>", "Shown."),
        ("<article><p>One <span hidden>two</span> three <a class=tag href=x>#four</a> <span class=search-term>five</span><button>six</button>.</article>", "One three #four five."),
        ("<article><h1 class='page-header'>Head</h1><p>Text.</p></article>", "Head\nText."),
        ("<nav><a href=x>Only a menu</a></nav>", "Only a menu"),
        (f"<!DOCTYPE html><title>t</title><p>{'Long text, and more. ' * 9}<p>{'Long text, and more. ' * 9}<div>short</div>", "\n".join([("Long text, and more. " * 9).strip()] * 2 + ["short"])),
        (f"<body><h1>Head</h1><div class=content>{ARTICLE}</div></body>", f"Head\n{TEXT}"),
        (f"<body><h1><a href=/>Site</a></h1><div class=content>{ARTICLE}</div></body>", TEXT),
        (f"<body><header><h1>Site</h1></header><div class=content>{ARTICLE}</div></body>", TEXT),
        (f"<body><main><div class='hero-banner'><h1>Head</h1><p>Lead.</p></div>{ARTICLE}<div class='banner'>Buy.</div></main></body>", f"Head\nLead.\n{TEXT}"),
        ("<article><p>One <![CDATA[ x > y ]]>two.</article>", "One two."),
        ("<script>if (a<b) '</scr'</script><style>p{}</style>", ""),
    ],
)
def test_html_markup(markup, want):
    assert text_of(markup) == want


def test_html_page_of_another_layout_than_its_host(spark):
    one = "<body><div class='content'>{}</div></body>"
    other = f"<body><div class='content'>Read on.</div><section class='long'><p>{'Another layout, with its text elsewhere. ' * 40}</p></section></body>"
    pages = [(i, "http://h.com/x", one.format(ARTICLE)) for i in range(20)] + [(99, "http://h.com/y", other)]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found.pop(99) == ("Another layout, with its text elsewhere. " * 40).strip() and set(found.values()) == {TEXT}


@pytest.mark.parametrize("part", ["<p title='", "<p ", "</div>", "<div>", "<div>x", "<", "<!--", "<title>", "<a", "<div></b>", "<b></div>", "<p/ / = =", "<table><tr><td>", "<ul><li>x", "<a href=x>y"])
def test_html_takes_linear_time(part):
    import time

    began = time.process_time()
    page = html.Page(part * 10_000)
    page.scores()
    page.extract(None)
    assert time.process_time() - began < 1


def test_html_equals_a_plain_parser(spark):
    """The given pages by Python's own parser: blocks of the article."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside = self.inside or tag == "article"
            if tag in ("p", "h1", "article"):
                self.blocks.append("")
            elif tag == "br":
                self.blocks[-1] += " "

        def handle_endtag(self, tag):
            if tag in ("p", "h1", "article"):
                self.blocks.append("")
            self.inside = self.inside and tag != "article"

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    found = {r.page_id: r for r in html.extract(pages).collect()}
    assert len(found) == pages.count()
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html or "")
        plain.close()
        want = "\n".join(t for t in (" ".join(b.split()) for b in plain.blocks) if t)
        assert found[r.page_id].text == want and found[r.page_id].n_chars == len(want)


def test_html_rows_and_ties(spark):
    one, two = f"<div class='b1'>{ARTICLE}</div>", f"<div class='a2'>{ARTICLE}</div>"
    rows = [(1, "http://h.com/1", one), (2, "http://h.com/2", two), (1, "http://h.com/1", one), (3, None, one), (None, "x", None), (4, "http://h.com/4", "<div class=b7>" + "<p>Very long.</p>" * 50_000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("path", F.lit(1))
    found = html.extract(table).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in found) == sorted([(1, len(TEXT)), (2, len(TEXT)), (1, len(TEXT)), (3, len(TEXT)), (0, 0), (4, 50_000 * 11 - 1)])
    assert html.extract(table.limit(0)).count() == 0


def test_decontamination_finds_moved_sentences(spark):
    item = "one two three four five six seven. eight nine ten eleven twelve thirteen. alpha beta gamma delta epsilon zeta"
    a, b, c = item.split(". ")
    rows = [(1, f"noise {item} noise"), (2, f"{c}. x y z {a} q {b}"), (3, f"{a} only"), (4, None), (5, ""), (6, "One"), (7, "one more"), (1, f"noise {item} noise"), (None, item), (9, "very long " * 100_000 + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("seed", F.lit(2))
    bench = spark.createDataFrame([(7, item), (8, "one"), (9, None), (10, ""), (7, item)], "item_id long, text string")
    found = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in found) == sorted([(0, 7), (1, 7), (1, 7), (2, 7), (9, 7)] * 2 + [(k, 8) for k in (0, 1, 1, 2, 3, 6, 7, 9)])
    assert {r.coverage for r in found} == {1.0}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5]


def plain_tiles(doc, item, least):
    """Greedy string tiling over all pairs of positions."""
    free, left, tiles = [x > 0 for x in doc], [x > 0 for x in item], []
    while True:
        best = None
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and free[i + n] and left[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return tiles
        tiles.append(best)
        i, j, n = best
        free[i : i + n] = left[j : j + n] = [False] * n


def test_tiles_equal_plain_tiling():
    random = np.random.default_rng(0)
    for _ in range(300):
        doc, item = random.integers(0, random.integers(2, 6), random.integers(0, 40)), random.integers(1, 5, random.integers(0, 25))
        assert decontaminate.tile(doc, item, 3) == plain_tiles(doc.tolist(), item.tolist(), 3)
    same = np.ones(50_000, np.int64)
    assert decontaminate.tile(same, same, 3) == [(0, 0, 50_000)]


def test_decontamination_equals_brute_force(spark):
    docs, bench = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    rows, items = docs.select("doc_id", "text").collect(), bench.collect()
    want = []
    for r in rows:
        words = decontaminate.words_of(r.text)
        runs = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        for item in items:
            own = decontaminate.words_of(item.text)
            if runs & {tuple(own[i : i + 5]) for i in range(len(own) - 4)}:
                number = {w: i for i, w in enumerate(dict.fromkeys(own), 1)}
                tiles = plain_tiles([number.get(w, 0) for w in words], [number[w] for w in own], 3)
                if tiles and tiles[0][2] >= 5 and sum(t[2] for t in tiles) >= 0.8 * len(own):
                    want.append((r.doc_id, item.item_id, sum(t[2] for t in tiles), len(tiles)))
    found = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.covered_words, r.tiles) for r in found) == sorted(want) and want


def plain_contaminated(docs, items, seed=5, least=3, threshold=0.8):
    out = []
    for doc, text in docs:
        words = decontaminate.words_of(text)
        for item, item_text in items:
            own = decontaminate.words_of(item_text)
            size = min(seed, len(own))
            runs = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
            if not own or not runs & {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}:
                continue
            number = {w: i for i, w in enumerate(dict.fromkeys(own), 1)}
            tiles = plain_tiles([number.get(w, 0) for w in words], [number[w] for w in own], min(least, len(own)))
            if tiles and tiles[0][2] >= size and sum(t[2] for t in tiles) >= threshold * len(own):
                out.append((doc, item, sum(t[2] for t in tiles), len(tiles)))
    return sorted(out)


@pytest.mark.parametrize("sent", [32 << 20, 0])
def test_decontamination_with_a_seed_that_all_share(spark, monkeypatch, sent):
    """All items and many documents have one phrase; items of a word to four; passages in another order."""
    monkeypatch.setattr(decontaminate, "SENT", sent)
    random = np.random.default_rng(9)
    hot = "which of the following is"
    items = [(k, f"{hot} " + " ".join(f"i{k}w{j}" for j in range(random.integers(1, 30)))) for k in range(40)]
    items += [(100, "one"), (101, "two words"), (102, "a b c d"), (103, None), (104, ""), (105, hot), (106, "p q r s t u v w x y"), (106, "p q r s t u v w x y")]
    docs = [(k, f"{hot} d{k} e{k} f{k} and so on, d{k % 9}") for k in range(150)]
    docs += [(500 + k, f"before {t} after") for k, t in items if t]
    docs += [(700, "v w x y, and p q r s t u"), (701, "p q r s t, u v w, x y"), (702, "p q r s t"), (703, "p q r. s t u. v w x. y"), (704, "a b c, d, one"), (705, "two, words"), (706, None), (706, ""), (None, items[3][1]), (707, "a b c and d")]
    tables = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as row", "'x' as items"), spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "2 as n")
    found = decontaminate.contaminated(*tables).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.item_id, r.covered_words, r.tiles) for r in found), key=key) == sorted(plain_contaminated([d for d in docs if d[0] is not None], items) + [(None, *x[1:]) for x in plain_contaminated([(0, items[3][1])], items)], key=key)
    assert {(r.doc_id, r.item_id) for r in found} >= {(700, 106), (701, 106), (704, 100), (705, 101), (704, 102)} and not {(702, 106), (707, 102)} & {(r.doc_id, r.item_id) for r in found}


def test_rare_grams_leave_too_little_to_the_others():
    random = np.random.default_rng(2)
    for _ in range(200):
        n = int(random.integers(5, 25))
        grams, counts = random.integers(0, 12, n - 2).tolist(), {}
        some = decontaminate.rarest(grams, [counts.setdefault(g, int(random.integers(0, 9))) for g in grams], 3, n, 0.8 * n)
        left = {k for place, g in enumerate(grams) if g not in some for k in range(place, place + 3)}
        assert len(left) < 0.8 * n and len(set(some)) == len(some)


def test_licences(odd):
    assert all(licenses.normalised is not None and any(h in s for h in licenses.HINT.split("|")) for s in licenses.sentence_table())
    text = "Hi.\nThis work is licensed under the GNU General Public\nLicense, version 3."
    found = licenses.scan(odd.limit(1).withColumn("text", F.lit(text))).first()
    assert found.licenses == "GPL-3.0-only" and found.first_license == "GPL-3.0-only"
    assert licenses.scan(odd).where("licenses <> ''").count() == 0


def test_licences_wrapped_and_whole(spark):
    sentences = list(licenses.sentence_table().items())
    forms = [f(s) for s, _ in sentences for f in (lambda s: s.replace(" ", "\n"), lambda s: s.replace(" ", "  "), lambda s: s.replace(" ", "-"))]
    found = licenses.scan(spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.sentence_ids for r in found} == {3 * i + k: name for i, (_, name) in enumerate(sentences) for k in range(3)}
    text = {i: s for s, i in sentences}
    assert len({n for n, _, _ in licenses.rule_table()}) > 100
    bsd = [text[i] for i in ("bsd-redist", "bsd-source", "bsd-binary", "bsd-names")]
    rows = [(1, ".\n".join(bsd[:3])), (2, ".\n".join(bsd)), (3, text["lgpl-free:2.1"]), (4, text["agpl-free:3"])]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.licenses for r in found} == {1: "BSD-2-Clause", 2: "BSD-3-Clause", 3: "LGPL-2.1-or-later", 4: "AGPL-3.0-or-later"}


def test_spdx_expressions(spark):
    rows = {
        1: ("// SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0,MIT"),
        2: ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) AND BSD-3-Clause */", "BSD-3-Clause,GPL-2.0-only"),
        3: ("# SPDX-License-Identifier: GPL-2.0+", "GPL-2.0-or-later"),
        4: ("# SPDX-License-Identifier: MIT", "MIT"),
        5: ("# SPDX-License-Identifier: LGPL-2.1-or-later or (MPL-2.0 and ISC)\nfree text\n SPDX-License-Identifier: Zlib OR Nonsense-1.0", "ISC,LGPL-2.1-or-later,MPL-2.0,Zlib"),
        6: ("SPDX-License-Identifier: \nMIT OR Apache-2.0", ""),
        7: ("this program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ""),
    }
    table = spark.createDataFrame([(k, t) for k, (t, _) in rows.items()], "doc_id long, text string")
    found = {r.doc_id: ",".join(sorted(filter(None, r.licenses.split(",")))) for r in licenses.scan(table).collect()}
    assert {k: v for k, v in found.items() if k != 7} == {k: v for k, (_, v) in rows.items() if k != 7}
    duck = duckdb.connect()
    duck.register("documents", table.toPandas())
    want = {r[0]: r[1:] for r in duck.execute(licenses.sql()).fetchall()}
    assert {r.doc_id: (r.sentence_ids, r.licenses, r.first_license) for r in licenses.scan(table).collect()} == want


def test_one_identifier_for_a_licence(spark):
    text = {i: s for s, i in licenses.sentence_table().items()}
    forms = ["gpl-free:3", "gpl-free:3.0", "named:GPL-3.0-or-later"]
    found = licenses.scan(spark.createDataFrame([(k, text[f]) for k, f in enumerate(forms)], "doc_id long, text string")).collect()
    assert {r.licenses for r in found} == {"GPL-3.0-or-later"}
    names = {n for n, _, _ in licenses.rule_table()}
    assert not {n for n in names if n.split("-")[0] in ("GPL", "LGPL", "AGPL") and not n.endswith(("-only", "-or-later"))}


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
KNOWN = [
    (BSD + BSD_END, "BSD-2-Clause"),
    (BSD + BSD_NAMES + BSD_END, "BSD-3-Clause"),
    (BSD, "BSD-2-Clause"),
    (BSD + BSD_END + "\n---\n" + BSD + BSD_NAMES, "BSD-3-Clause,BSD-2-Clause"),
    ("// SPDX-License-Identifier: MPL-2.0\nint x;", "MPL-2.0"),
    ("# SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0-or-later"),
    ("/* SPDX-License-Identifier: (MIT) */", "MIT"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.", "0BSD"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this", "MPL-2.0"),
    ("This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"),
    ("This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:", "Zlib"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.", "Apache-2.0"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\").", "Apache-2.0"),
    ("Released under the Artistic License 2.0.", "Artistic-2.0"),
    ("This software is licensed under the European Union Public License 1.2.", "EUPL-1.2"),
    ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("The contents of this file are subject to the terms of the Common Development\nand Distribution License (the License).", "CDDL-1.0"),
    ("No licence is named here, but a warranty and permission are.", ""),
]


def test_licences_of_known_texts(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(KNOWN)], "doc_id long, text string").withColumn("licenses", F.lit("clash"))
    found = {r.doc_id: r.licenses for r in licenses.scan(rows).collect()}
    assert [found[i] for i in range(len(KNOWN))] == [want for _, want in KNOWN]
    assert licenses.scan(rows.limit(0)).count() == 0
