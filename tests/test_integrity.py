"""Digests, manifests and ramps against brute force."""

import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

from driftledger.functions import checksums
from driftledger.operators import integrity
from driftledger.plans import registry
from driftledger.sources import formats
from driftledger.streaming import flows

DATA = "/root/testdata/sf0.01"
FILES = [(1, "r", "b/x.bin", b"123456789"), (2, "r", "a.txt", b""), (3, "r", "b", b"q" * 5000), (4, "s", "é.txt", os.urandom(3000)), (5, "s", "skip.part.1", b"zz")]
COLUMNS = "file_id long, root string, relative_path string, content binary"


def crc(data: bytes) -> int:
    value = 0xFFFFFFFF
    for byte in data:
        value ^= byte
        for _ in range(8):
            value = value >> 1 ^ (0x82F63B78 if value & 1 else 0)
    return value ^ 0xFFFFFFFF


def tree(root: str) -> str:
    rows = sorted((p.encode(), c) for _, r, p, c in FILES if r == root and ".part." not in p)
    return f"crc32c:{crc(b''.join(p + b'\0' + str(len(c)).encode() + b'\0' + c + b'\0' for p, c in rows)):08x}"


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, COLUMNS)


def test_crc_vectors():
    values = [b"123456789", b"", b"a", os.urandom(777), os.urandom(12_293)]
    assert checksums.crcs(values).tolist() == [crc(v) for v in values]
    assert checksums.crcs(values)[0] == 0xE3069283 and checksums.crcs([b""]).tolist() == [0]


def test_null_content_has_null_crc(spark):
    rows = spark.createDataFrame([(1, None), (2, b"a")], "i long, c binary").select("i", checksums.crc32c("c").alias("v"))
    assert {r.i: r.v for r in rows.collect()} == {1: None, 2: crc(b"a")}


def test_chunks_and_combination(files):
    chunks = integrity.crc32c_chunks(files, 1000)
    wanted = {(i, k): crc(c[k * 1000 : k * 1000 + 1000]) for i, _, _, c in FILES for k in range(-(-len(c) // 1000))}
    assert {(r.file_id, r.chunk_id): r.crc for r in chunks.collect()} == wanted
    assert {r.file_id: (r.size, r.crc) for r in integrity.crc32c_combine(chunks).collect()} == {i: (len(c), crc(c)) for i, _, _, c in FILES if c}


def test_tree_digest_both_ways(files):
    sizes = files.withColumn("size", F.length("content").cast("long")).drop("content")
    content = {r.root: r.tree_hash for r in integrity.tree_hash_content(files, 1000).collect()}
    assert content == {"r": tree("r"), "s": tree("s")}
    chunks = integrity.crc32c_chunks(files, 700)
    assert {r.root: r.tree_hash for r in integrity.tree_hash_chunks(sizes, chunks).collect()} == content
    gap = {r.root: (r.tree_hash, r.reason) for r in integrity.tree_hash_chunks(sizes, chunks.where("NOT (file_id = 3 AND chunk_id = 2)")).collect()}
    assert gap == {"r": (None, "not_contiguous"), "s": (content["s"], None)}


def test_contents_pass_through_one_python_worker(files, monkeypatch):
    """A CRC and its move are one function: nested ones would have a worker each, beside the one of the folded CRCs."""
    monkeypatch.setattr(integrity, "tree_digest", lambda rows: rows)
    plan = integrity.tree_hash_content(files, 1000)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") == 2


def test_moved_crc_is_that_of_content_with_bytes_behind(spark):
    rows = spark.createDataFrame([(1, b"ab", 3), (2, b"", 5), (3, None, 1), (4, b"x", None), (5, b"xyz", -3)], "i long, c binary, n long")
    told = rows.select("i", checksums.crc32c_moved("c", "n").alias("a"), checksums.crc32c_shift(checksums.crc32c("c"), "n").alias("b")).collect()
    assert all(r.a == r.b for r in told) and {r.i for r in told if r.a is None} == {3, 4}


def test_tree_digest_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(integrity, "SAMPLES", 2)
    rows = [(f"p{i:04d}", bytes([i % 251]) * (i % 7)) for i in range(300)]
    frame = spark.createDataFrame([("r", p, len(c), crc(c)) for p, c in rows], "root string, relative_path string, size long, crc long")
    wanted = crc(b"".join(p.encode() + b"\0" + str(len(c)).encode() + b"\0" + c + b"\0" for p, c in rows))
    assert integrity.tree_digest(frame).first().tree_hash == f"crc32c:{wanted:08x}"
    assert integrity.tree_digest(frame.union(frame.limit(1))).first().tree_hash is None


def test_verify_counts_corrupt_and_missing(files):
    chunks = integrity.crc32c_chunks(files, 1000).where("NOT (file_id = 3 AND chunk_id = 1)").withColumn("crc", F.when(F.expr("file_id = 3 AND chunk_id = 4"), 1).otherwise(F.col("crc")))
    row = integrity.chunk_verify(files, chunks, 1000).where("file_id = 3").first()
    assert (row.kept, row.removed_corrupt, row.missing, row.verified_bytes) == (3, 1, 1, 3000)


def test_verify_removes_chunks_beyond_the_content(spark, files):
    chunks = integrity.crc32c_chunks(files, 1000).select("file_id", "chunk_id", "crc").where("NOT (file_id = 3 AND chunk_id = 2)")
    foreign = spark.createDataFrame([(1, 9, 0), (2, 0, 5), (77, 0, 5)], "file_id long, chunk_id long, crc long")
    found = {r.file_id: tuple(r)[1:] for r in integrity.chunk_verify(files, chunks.union(foreign), 1000).collect()}
    # kept, removed_corrupt, missing, verified_bytes, kept_ranges, missing_ranges
    assert found == {1: (1, 1, 0, 9, 1, 0), 2: (0, 1, 0, 0, 0, 0), 3: (4, 0, 1, 4000, 2, 1), 4: (3, 0, 0, 3000, 1, 0), 5: (1, 0, 0, 2, 1, 0), 77: (0, 1, 0, 0, 0, 0)}


def test_tree_sha256_is_of_the_sequence(spark):
    rows = [("r", f"p{i % 50:02d}/{i}", i, hashlib.sha256(b"x" * i).hexdigest()) for i in range(120)] + [("s", "a", 0, hashlib.sha256(b"").hexdigest())]
    found = {r.root: (r.tree_hash, r.file_count, r.bytes) for r in integrity.tree_sha256(spark.createDataFrame(rows, "root string, relative_path string, size long, sha256 string")).collect()}
    for root in "rs":
        own = sorted((p, n, h) for r, p, n, h in rows if r == root)
        text = b"".join(p.encode() + b"\0" + str(n).encode() + b"\0" + h.encode() + b"\0" for p, n, h in own)
        assert found[root] == (hashlib.sha256(text).hexdigest(), len(own), sum(n for _, n, _ in own))


def test_compression(files):
    rows = {r.file_id: r for r in integrity.compress_sample(files, 1024).collect()}
    assert rows[2].reason == "empty_file" and rows[3].decision == "compression_candidate"
    # Blocks that overlap repeat bytes; blocks of 200 of 3000 random bytes hardly do.
    assert {r.file_id: r.reason for r in integrity.compress_sample(files, 200).collect()}[4] == "poor_ratio"
    offsets = integrity.sample_offsets("3", 5000, 1024, 0)
    raw = b"".join(FILES[2][3][o : o + 1024] for o in offsets)
    assert rows[3].compressed_bytes == len(zlib.compress(raw, 1)) and {0, 2500, 3976} <= set(offsets)
    blocks = integrity.compress_roundtrip(files, 1024).collect()
    assert all(b.sha256_ok for b in blocks) and sum(b.original for b in blocks) == sum(len(c) for *_, c in FILES)


def test_manifest_rules(spark, tmp_path):
    transfers = spark.createDataFrame([("a", "o", "t", 4096, 1024, 1, 2, "partial"), ("b", "o", "t", 4096, 1024, 1, 2, "partial")], "transfer_id string, output_path string, temp_path string, total_size long, chunk_size long, created_ns long, updated_ns long, state string")
    chunks = spark.createDataFrame([("a", 2, 2048, 2048, 7), ("a", 0, 0, 1024, 9)], "transfer_id string, chunk_id long, begin long, length long, crc long")
    texts = formats.sink_transfer_manifest(transfers, chunks, 3)
    text = {r.transfer_id: r.text for r in texts.collect()}
    assert "completed_ranges=0-1024,2048-4096\nverified_chunks=0:0:1024:crc32c:00000009,2:2048:2048:crc32c:00000007\n" in text["a"]
    assert text["b"].endswith(f"manifest_body_crc32c={crc(text['b'].rsplit('manifest_body', 1)[0].encode()):08x}\n")
    twice = text["a"].replace("state=partial\n", "state=partial\nstate=partial\n")
    (tmp_path / "m.txt").write_text("\n".join([text["a"], text["b"], twice, text["a"].replace("state=partial\n", ""), text["a"].replace("0-1024", "0-1023")]))
    reasons = [r.reason for r in formats.scan_transfer_manifest(spark, str(tmp_path), 3).collect()]
    assert sorted(map(str, reasons)) == ["None", "None", "bad_crc", "duplicate_key", "missing_key"]
    assert {r.reason for r in formats.scan_transfer_manifest(spark, str(tmp_path), 4).where("transfer_id = 'b'").collect()} == {"bad_version"}


def test_ramp_alerts(spark):
    marks = [(0.1, 0, 0), (0.1, 0, 0), (0.1, 0, 0), (1.0, 0, 0), (0.1, 0, 0), (2.0, 0, 0), (0.1, 0.9, 0), (0.1, 0, 1), (0.1, 0, 1), (0.2, 0, 1)]
    rows = spark.createDataFrame([(1, i, i, float(m[0]), float(m[1]), m[2]) for i, m in enumerate(marks)], "link_id long, ts long, event_id long, fill double, pressure double, retries long")
    got = [(r.action, r.reason) for r in flows.ramp_alerts(rows).orderBy("event_id").collect()]
    hold = ("hold", "balanced")
    assert got == [hold, ("up", "low_watermark"), hold, hold, hold, ("down", "high_watermark"), ("down", "send_pressure"), ("down", "retry_pressure"), hold, ("up", "low_watermark")]


@pytest.mark.parametrize("name", ["stream_throughput", "stream_transfer_sessions", "stream_event_counts", "stream_ramp"])
def test_streams_do_not_depend_on_files(spark, tmp_path, name):
    """Forty files in no order of time: other batches, other watermarks, the same rows."""
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(40, F.xxhash64("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    one, many = (registry.QUERIES[name](spark, d).toPandas() for d in (DATA, str(tmp_path)))
    late = many.pop("late_events").sum() if "late_events" in many else None
    one = one.drop(columns="late_events", errors="ignore")
    rows = lambda f: sorted(map(repr, f[sorted(f)].itertuples(index=False)))
    assert rows(one) == rows(many) and late != 0
