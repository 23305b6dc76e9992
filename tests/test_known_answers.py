"""Literal cases with known answers."""

import pytest
from pyspark.sql import functions as F

from driftledger.functions import checksums
from driftledger.operators import integrity, ranges, records, verdicts
from driftledger.sources import formats


def spans(spark, rows):
    frame = spark.createDataFrame([(1, b, n) for b, n in rows], "file_id long, begin long, length long")
    return frame.withColumn("stop", F.col("begin") + F.col("length"))


def test_crc_of_nothing_and_of_digits():
    assert checksums.crcs([b"", b"123456789"]).tolist() == [0, 0xE3069283]


def test_ranges_with_a_gap(spark):
    held = spans(spark, [(0, 1024), (1024, 1024), (3072, 1024)])
    merged = sorted((r.begin, r.stop) for r in ranges.coalesce(held).collect())
    assert merged == [(0, 2048), (3072, 4096)] and sum(b - a for a, b in merged) == 3072
    totals = spark.createDataFrame([(1, 4096), (2, 10), (3, 0)], "file_id long, total long")
    assert sorted((r.file_id, r.begin, r.stop) for r in ranges.missing(held, totals).collect()) == [(1, 2048, 3072), (2, 0, 10)]
    status = {r.file_id: (r.status, r.bytes_completed) for r in ranges.coverage(held, totals).collect()}
    assert status == {1: ("missing", 3072), 2: ("missing", 0), 3: ("empty", 0)}


def test_ranges_out_of_order_make_one(spark):
    rows = ranges.coalesce(spans(spark, [(2048, 1024), (0, 1024), (1024, 1024), (512, 512)])).collect()
    assert [(r.begin, r.stop) for r in rows] == [(0, 3072)]


@pytest.mark.parametrize("second", [(0, 1024), (512, 1024)])
def test_overlap(spark, second):
    held = spans(spark, [(0, 1024), second])
    assert ranges.overlaps(held).count() == 1
    totals = spark.createDataFrame([(1, 4096)], "file_id long, total long")
    assert ranges.coverage(held, totals).first().status == "duplicate"


def test_invalid_ranges(spark):
    assert [r.is_valid for r in ranges.validate(spans(spark, [(0, 0), (4090, 16), (0, 4096)]), 4096).orderBy("begin", "length").collect()] == [False, True, False]


def test_work_items(spark):
    files = spark.createDataFrame([(1, 512 << 20, "pending"), (2, 1, "completed"), (3, 1, "changed")], "file_id long, size long, status string")
    items = ranges.plan_work_items(files, 64 << 20, 256 << 20).orderBy("item").collect()
    assert [(r.file_id, r.begin, r.length, r.dispatchable) for r in items] == [(1, 0, 256 << 20, True), (1, 256 << 20, 256 << 20, False)]


def test_least_loaded_link(spark):
    items = spark.createDataFrame([(1, 0, 0), (1, 1024, 1)], "file_id long, begin long, index long")
    links = lambda rows: spark.createDataFrame(rows, "link_id string, capacity long, ready_bytes long, healthy boolean")
    one = verdicts.least_loaded(items, links([("a", 1, 200, True), ("b", 1, 100, True), ("c", 1, 0, False)])).collect()
    assert {r.link_id for r in one} == {"b"}
    tied = verdicts.least_loaded(items, links([("a", 1, 100, True), ("b", 1, 100, True)])).collect()
    assert {r.begin: r.link_id for r in tied} == {0: "a", 1024: "b"}


@pytest.mark.parametrize("kind", ["upload", "download"])
def test_manifest_round_trip(spark, tmp_path, kind):
    paths = {"source_path": "in/é", "target_path": "out"} if kind == "download" else {"output_path": "out/é"}
    row = {"transfer_id": "phase2a", **paths, "temp_path": "t", "total_size": 4096, "chunk_size": 1024, "created_ns": 1, "updated_ns": 2, "state": "transferring"}
    transfers = spark.createDataFrame([tuple(row.values())], list(row))
    chunks = spark.createDataFrame([("phase2a", 0, 0, 1024, 5), ("phase2a", 2, 2048, 2048, 6)], "transfer_id string, chunk_id long, begin long, length long, crc long")
    path = f"{tmp_path}/m"
    formats.write_manifests(formats.sink_transfer_manifest(transfers, chunks, 2, kind), path)
    scan = formats.scan_download_manifest if kind == "download" else formats.scan_transfer_manifest
    read = scan(spark, path, 2).first()
    assert read.is_valid and [tuple(r) for r in read.ranges] == [(0, 1024), (2048, 4096)] and len(read.chunks) == 2
    assert all(read[k] == v for k, v in paths.items())


def test_ranges_of_a_manifest_come_with_its_list(spark, tmp_path):
    """Ranges that overlap, hold another, touch or stand apart; chunks are shuffled once and joined once."""
    spans = {"a": [(0, 100), (10, 20), (50, 100), (150, 10), (200, 5), (203, 1), (300, 1)], "b": [(7, 3)], "c": []}
    transfers = spark.createDataFrame([(t, "out", "t", 4096, 1024, 1, 2, "partial") for t in spans], "transfer_id string, output_path string, temp_path string, total_size long, chunk_size long, created_ns long, updated_ns long, state string")
    chunks = spark.createDataFrame([(t, i, b, n, 5) for t, own in spans.items() for i, (b, n) in enumerate(own)], "transfer_id string, chunk_id long, begin long, length long, crc long").repartition(3)
    texts = formats.sink_transfer_manifest(transfers, chunks, 2)
    assert texts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 2
    path = f"{tmp_path}/m"
    formats.write_manifests(texts, path)
    found = {r.transfer_id: [tuple(x) for x in r.ranges] for r in formats.scan_transfer_manifest(spark, path, 2).collect()}
    assert found == {"a": [(0, 160), (200, 205), (300, 301)], "b": [(7, 10)], "c": []}


def test_tree_digest_of_no_files_has_no_row(spark):
    files = spark.createDataFrame([], "file_id long, root string, relative_path string, content binary")
    assert integrity.tree_hash_content(files, 1024).count() == 0


def test_owned_sidecars(spark):
    names = ["a", "a.manifest", "b.manifest", "c.manifest"]
    files = spark.createDataFrame([(n,) for n in names], "relative_path string")
    manifests = spark.createDataFrame([("a.manifest", "a", True), ("b.manifest", "z", True), ("c.manifest", "c", False)], "relative_path string, output_path string, is_valid boolean")
    assert sorted(r[0] for r in records.without_owned_sidecars(files, manifests, ".manifest").collect()) == ["a", "b.manifest", "c.manifest"]


def test_hygiene_rules(spark):
    key = "AK" + "IA" + "ABCDEFGHIJKLMNOP"
    lines = ["-----BEGIN RSA PRIVATE KEY-----", f"id {key}", "password: <your password>", 'api_key = "abcdefgh12345678"', "see host-7.internal", "https://u:p4ss@h/x", "plain text"]
    rows = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    found = [(r.line_no, r.finding) for r in records.hygiene_scan(rows, denied=("host-7.internal",)).orderBy("line_no").collect()]
    assert found == [(1, "pem_private_key"), (2, "cloud_access_key_id"), (4, "named_secret"), (5, "denied_text"), (6, "credential_in_url")]


def test_listing_of_a_folder(spark):
    files = spark.createDataFrame([("a/b", 1, 5), ("a/c/d", 2, 7), ("x", 3, 9)], "relative_path string, size long, mtime_s long")
    assert sorted(map(tuple, records.listing(files, "a").collect())) == [("b", False, 1, 5), ("c", True, 0, 7)]


def test_tree_of_lines_has_the_crc_of_its_one_row_form(spark, tmp_path):
    records = [("a", f"d{k % 7}/f é{k}", k, 5, f"t{k}", "completed", "e:1" if k % 3 else None) for k in range(400)] + [("b", "x", 1, 2, "t", "pending", None), (None, "x", 1, 2, "t", "pending", None)]
    records += [("c", "same", k, 2, "t", "pending", None) for k in (10, 9)]
    files = spark.createDataFrame(records, "manifest_id string, relative_path string, size long, mtime_s long, transfer_id string, status string, error string").repartition(5)
    path, row_path = f"{tmp_path}/lines", f"{tmp_path}/rows"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few records are one file
    formats.write_tree_manifest(files, path, 3)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    texts = formats.sink_tree_manifest(files.where("manifest_id IS NOT NULL"), 3)
    formats.write_manifests(texts, row_path)
    stated = {r.manifest_id: r.text.strip().rsplit("=", 1)[1] for r in texts.collect()}
    checked = formats.tree_manifest_check(spark, path, 3).collect()
    assert {r.manifest_id: r.expected for r in checked} == {r.manifest_id: r.actual for r in checked} == stated
    assert all(r.broken is None for r in checked)
    got, want = formats.read_tree_manifest(spark, path, 3), formats.scan_tree_manifest(spark, row_path, 3)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    lines = [line for part in sorted((tmp_path / "lines/records").glob("part-*")) for line in part.read_text().splitlines()]
    assert len(list((tmp_path / "lines/records").glob("part-*"))) > 1
    whole = ",".join(line.split("\t")[2] for line in lines if line.startswith("61\t"))
    assert f"files={whole}\n" in next(r.text for r in texts.collect() if r.manifest_id == "a")


@pytest.mark.parametrize(
    ("spoil", "reason"),
    [
        (lambda lines: lines[1:], "bad_bytes"),
        (lambda lines: [*lines, lines[0]], "bad_bytes"),
        (lambda lines: [lines[0].replace(":7:", ":8:"), *lines[1:]], "bad_crc"),
        (lambda lines: [lines[1].replace("\t14\t", "\t0\t"), lines[0].replace("\t0\t", "\t14\t"), *lines[2:]], "bad_crc"),
        (lambda lines: lines[::-1], None),
        (lambda lines: [], "bad_bytes"),
        (lambda lines: ["61\t0", *lines[1:]], "bad_bytes"),
    ],
)
def test_tree_of_lines_that_lost_or_changed_some(spark, tmp_path, spoil, reason):
    files = spark.createDataFrame([("a", p, 7, 5, "t", "pending", None) for p in "xyz"], "manifest_id string, relative_path string, size long, mtime_s long, transfer_id string, status string, error string")
    formats.write_tree_manifest(files, f"{tmp_path}/w", 3)
    lines = [r.value for r in spark.read.text(f"{tmp_path}/w/records").orderBy("value").collect()]
    assert lines[0] == "61\t0\t78:7:5:t:pending:" and len(lines) == 3
    spoilt = tmp_path / "s"
    (spoilt / "records").mkdir(parents=True)
    (spoilt / "records/part").write_text("".join(f"{line}\n" for line in spoil(lines)))
    (spoilt / "heads").mkdir()
    head = "".join(p.read_text() for p in (tmp_path / "w/heads").glob("part-*"))
    (spoilt / "heads/part").write_text(head)
    found = formats.tree_manifest_check(spark, str(spoilt), 3).collect()
    assert [(r.manifest_id, r.broken) for r in found] == [("a", reason)]
    assert {r.reason for r in formats.read_tree_manifest(spark, str(spoilt), 3).collect()} <= {reason}
    assert [r.broken for r in formats.tree_manifest_check(spark, str(spoilt), 4).collect()] == [reason or "bad_version"]
    (spoilt / "heads/part").write_text(head * 2)
    assert formats.tree_manifest_check(spark, str(spoilt), 3).first().broken == "duplicate_head"
