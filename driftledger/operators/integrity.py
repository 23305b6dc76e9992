"""Chunk and tree digests, verification of recorded chunks, and compression samples."""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from driftledger.functions.checksums import crc32c, crc32c_moved, crc32c_shift, crcs
from driftledger.functions.workers import ship, stored

from . import ranges
from .records import without_sidecars

#: Buckets of paths in a tree digest, and the paths sampled for each one's bound.
BUCKETS, SAMPLES = 64, 20
#: Seed and factor of the sample offset, and what is added to size and generation.  Fixed values.
SEED, FACTOR, SIZE_SALT, GENERATION_SALT = 1469598103934665603, 1099511628211, 0x9E3779B97F4A7C15, 0x632BE59BD9B4E019
#: Worst ratio that is still worth compressing.  Fixed value.
POOR_RATIO = 0.85


def slices(files: DataFrame, chunk: int) -> DataFrame:
    """``content`` cut into chunks; an empty file has none.  Rows stay where they are.

    Slices are cut before they are exploded, so a row never carries the whole content again.
    """
    last = F.ceil(F.length("content") / F.lit(chunk)).cast("long") - 1
    cut = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: F.struct(k.alias("chunk_id"), F.substring("content", (k * chunk + 1).cast("int"), F.lit(chunk)).alias("part")))
    rows = files.where(F.length("content") > 0).select("file_id", F.explode(cut).alias("p")).select("file_id", "p.*")
    return rows.select("file_id", "chunk_id", (F.col("chunk_id") * chunk).alias("begin"), "part", F.length("part").cast("long").alias("length"))


def crc32c_chunks(files: DataFrame, chunk: int, algorithm: str = "crc32c") -> DataFrame:
    """CRC-32C of each chunk of ``content`` (binary); the algorithm ``none`` gives 0."""
    ship(files.sparkSession)
    return slices(files, chunk).select("file_id", "chunk_id", "begin", "length", (crc32c("part") if algorithm == "crc32c" else F.lit(0).cast("long")).alias("crc"))


def crc32c_combine(chunks: DataFrame, *keys: str) -> DataFrame:
    """CRC-32C of each whole from its chunks, which must cover it.

    Each chunk is moved back by its end, so the fold needs neither order nor the
    total, and combines before the shuffle.
    """
    ship(chunks.sparkSession)
    keys = keys or ("file_id",)
    stop = F.col("begin") + F.col("length")
    return _folded(chunks.select(*keys, stop.alias("stop"), crc32c_shift("crc", -stop).alias("moved")), *keys)


def _folded(moved: DataFrame, *keys: str) -> DataFrame:
    """CRC of each whole from the CRCs of its chunks, each moved back by its end ``stop``."""
    folded = moved.groupBy(*keys).agg(F.max("stop").alias("size"), F.bit_xor("moved").alias("moved"))
    return folded.select(*keys, "size", crc32c_shift("moved", "size").alias("crc"))


def content_crc32c(files: DataFrame, chunk: int) -> DataFrame:
    """CRC-32C of each file's ``content``, cut into chunks that are summed and moved in one pass; an empty file has no row."""
    ship(files.sparkSession)
    stop = F.col("begin") + F.col("length")
    return _folded(slices(files, chunk).select("file_id", stop.alias("stop"), crc32c_moved("part", -stop).alias("moved")), "file_id")


def exact_chunks(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each file's CRC from chunks that cover it exactly; ``reason`` where they don't."""
    order = Window.partitionBy("file_id").orderBy("begin", "length")
    follows = (F.col("length") > 0) & (F.col("begin") == F.lag(F.col("begin") + F.col("length"), 1, 0).over(order))
    facts = chunks.withColumn("follows", follows).groupBy("file_id").agg(F.bool_and("follows").alias("follows"), F.max(F.col("begin") + F.col("length")).alias("stop"))
    whole = crc32c_combine(chunks).select("file_id", F.col("crc").alias("whole"))
    rows = files.join(facts, "file_id", "left").join(whole, "file_id", "left")
    reason = F.when(F.col("stop").isNull() & (F.col("size") > 0), "no_chunks").when(~F.col("follows"), "not_contiguous").when(F.coalesce("stop", F.lit(0)) != F.col("size"), "short_cover")
    return rows.select(*files.columns, F.coalesce("whole", F.lit(0).cast("long")).alias("crc"), reason.alias("reason"))


def tree_digest(files: DataFrame) -> DataFrame:
    """CRC-32C of ``path NUL size NUL content NUL`` of all files in byte order of paths.

    ``files`` has root, relative_path, size and crc (of the content).  A root may hold
    most files, so positions come from two levels: bytes of buckets of paths, then
    running sums within a bucket.  Bounds of buckets are a bounded sample of paths
    and don't change the result.  A duplicate, empty or unsafe path makes it null.
    """
    spark = files.sparkSession
    ship(spark)
    size = F.col("size").cast("string")
    nul = F.lit(b"\0")
    head = F.concat(F.col("relative_path").cast("binary"), nul, size.cast("binary"), nul)
    bad = (F.col("relative_path") == "") | F.col("relative_path").contains("\\") | F.col("relative_path").contains("\0")
    rows = without_sidecars(files).select("root", "relative_path", bad.alias("bad"), (F.octet_length("relative_path") + F.octet_length(size) + 3 + F.col("size")).alias("bytes"), "size", "crc", head.alias("head"))
    crc = crc32c_moved("head", F.col("size") + 1).bitwiseXOR(crc32c_shift("crc", F.lit(1).cast("long"))).bitwiseXOR(F.lit(int(crcs([b"\0"])[0])).cast("long"))
    rows = stored(rows.select("root", "relative_path", "bad", "bytes", "size", crc.alias("crc")), "tree-segments")
    sample = sorted(r[0] for r in rows.select("relative_path").orderBy(F.xxhash64("relative_path"), "relative_path").limit(BUCKETS * SAMPLES).collect())
    bounds = F.array(*map(F.lit, sample[SAMPLES::SAMPLES])).cast("array<string>")
    rows = rows.withColumn("bucket", F.size(F.filter(bounds, lambda b: b <= F.col("relative_path"))))
    before = F.sum("bytes").over(Window.partitionBy("root").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("root", "bucket").agg(F.sum("bytes").alias("bytes")).select("root", "bucket", F.coalesce(before, F.lit(0)).alias("start"))
    inside = Window.partitionBy("root", "bucket").orderBy("relative_path")
    placed = rows.withColumn("stop", F.sum("bytes").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("again", F.coalesce(F.lag("relative_path").over(inside) == F.col("relative_path"), F.lit(False)))
    placed = placed.join(starts, ["root", "bucket"]).withColumn("stop", F.col("start") + F.col("stop"))
    moved = placed.withColumn("moved", crc32c_shift("crc", -F.col("stop")))
    whole = moved.groupBy("root").agg(F.bit_xor("moved").alias("moved"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("bytes"), F.bool_or(F.col("bad") | F.col("again")).alias("bad"))
    text = F.concat(F.lit("crc32c:"), F.lpad(F.lower(F.hex(crc32c_shift("moved", "stop"))), 8, "0"))
    return whole.select("root", F.when(~F.col("bad"), text).alias("tree_hash"), "file_count", "bytes")


def tree_hash_content(files: DataFrame, chunk: int) -> DataFrame:
    """Digest of each root from contents, which are read once and never shuffled."""
    names = files.select("file_id", "root", "relative_path", F.length("content").cast("long").alias("size"))
    whole = content_crc32c(files, chunk).select("file_id", "crc")
    return tree_digest(names.join(whole, "file_id", "left").withColumn("crc", F.coalesce("crc", F.lit(0).cast("long"))))


def tree_hash_chunks(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """The same digest from recorded chunks; null with a reason where a file isn't covered exactly."""
    rows = stored(exact_chunks(files, chunks), "tree-files")
    reasons = rows.groupBy("root").agg(F.min("reason").alias("reason"))
    return tree_digest(rows.drop("reason")).join(reasons, "root").select("root", F.when(F.col("reason").isNull(), F.col("tree_hash")).alias("tree_hash"), "file_count", "bytes", "reason")


def chunk_verify(files: DataFrame, chunks: DataFrame, chunk: int) -> DataFrame:
    """Recorded chunks against contents: what is kept, removed and missing of each file.

    A record that differs, or that lies beyond the content, is removed; a chunk
    with several is kept if one of them is right.
    ``kept_ranges`` and ``missing_ranges`` count the merged ranges of what is verified
    and of what isn't.  An empty file without records has zeros.
    """
    actual = crc32c_chunks(files, chunk).withColumnRenamed("crc", "actual")
    recorded = chunks.select("file_id", "chunk_id", F.col("crc").alias("recorded")).distinct()
    right = F.coalesce(F.col("actual") == F.col("recorded"), F.lit(False))
    each = actual.join(recorded, ["file_id", "chunk_id"], "full").groupBy("file_id", "chunk_id", "begin", "length")
    rows = stored(each.agg(F.bool_or(right).alias("kept"), F.count("recorded").alias("records")), "verified-chunks")
    wrong = F.col("records") - F.col("kept").cast("int")
    sums = rows.groupBy("file_id").agg(F.count_if("kept").alias("kept"), F.sum(wrong).alias("removed_corrupt"), F.count_if(F.col("records") == 0).alias("missing"), F.sum(F.when(F.col("kept"), F.col("length")).otherwise(0)).alias("verified_bytes"))
    # A file's kept and other chunks are merged at once, as two files.
    spans = rows.where("begin IS NOT NULL").select(F.struct("file_id", "kept").alias("file_id"), "begin", (F.col("begin") + F.col("length")).alias("stop"))
    merged = ranges.coalesce(spans).groupBy(F.col("file_id.file_id").alias("file_id")).agg(F.count_if("file_id.kept").alias("kept_ranges"), F.count_if(~F.col("file_id.kept")).alias("missing_ranges"))
    zeros = ["kept", "removed_corrupt", "missing", "verified_bytes", "kept_ranges", "missing_ranges"]
    return files.select("file_id").join(sums, "file_id", "full").join(merged, "file_id", "left").na.fill(0, zeros)


def tree_sha256(files: DataFrame) -> DataFrame:
    """SHA-256 of ``path NUL size NUL hexadecimal SHA-256 NUL`` of each root's files in byte order of paths.

    ``files`` has root, relative_path, size and sha256.  The digest is of one sequence, so
    a root's lines pass through one task, sorted by Spark, and none is held.
    """
    ship(files.sparkSession)
    line = F.concat(F.col("relative_path").cast("binary"), F.lit(b"\0"), F.col("size").cast("string").cast("binary"), F.lit(b"\0"), F.col("sha256").cast("binary"), F.lit(b"\0"))
    rows = files.select("root", "relative_path", F.col("size").cast("long").alias("size"), line.alias("line")).repartition("root").sortWithinPartitions("root", "relative_path")
    return rows.select("root", "size", "line").mapInArrow(_roots, "root string, tree_hash string, file_count long, bytes long")


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by root -> a row for each root."""
    root, digest, count, size, out = None, None, 0, 0, []
    for batch in batches:
        for name, n, line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if digest is None or name != root:
                if digest is not None:
                    out.append((root, digest.hexdigest(), count, size))
                root, digest, count, size = name, hashlib.sha256(), 0, 0
            digest.update(line)
            count, size = count + 1, size + n
    if digest is not None:
        out.append((root, digest.hexdigest(), count, size))
    columns = zip(*out, strict=True) if out else [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["root", "tree_hash", "file_count", "bytes"])


def sample_offsets(file_id: str, size: int, block: int, generation: int) -> list[int]:
    """Start, middle, end and one place that follows from the id: where a file is sampled."""
    if size <= block:
        return [0] if size else []
    seed, mask = SEED, 2**64 - 1
    for byte in file_id.encode():
        seed = (seed ^ byte) * FACTOR & mask
    seed ^= (size + SIZE_SALT) & mask
    seed ^= (generation + GENERATION_SALT) & mask
    return sorted({0, min(size - block, size // 2), size - block, seed % (size - block + 1)})


def compress_sample(files: DataFrame, block: int, generation: int = 0) -> DataFrame:
    """Ratio of the fastest zlib level over up to four blocks of each file, and what follows from it.

    Measured speed isn't part of the decision.  An empty file stays raw.
    """
    ship(files.sparkSession)

    @F.pandas_udf("struct<raw_bytes:long,compressed_bytes:long>")
    def sampled(ids: pd.Series, contents: pd.Series) -> pd.DataFrame:
        def one(file_id: str, content: bytes) -> tuple[int, int]:
            raw = b"".join(content[o : o + block] for o in sample_offsets(file_id, len(content), block, generation))
            return len(raw), len(zlib.compress(raw, 1)) if raw else 0

        return pd.DataFrame([one(i, bytes(c or b"")) for i, c in zip(ids, contents)], columns=["raw_bytes", "compressed_bytes"])

    rows = files.select("file_id", sampled(F.col("file_id").cast("string"), "content").alias("s")).select("file_id", "s.*")
    ratio = F.when(F.col("raw_bytes") > 0, F.col("compressed_bytes") / F.col("raw_bytes")).otherwise(1.0)
    reason = F.when(F.col("raw_bytes") == 0, "empty_file").when(F.col("ratio") > POOR_RATIO, "poor_ratio").otherwise("worthwhile")
    return rows.withColumn("ratio", F.round(ratio, 6)).withColumn("reason", reason).withColumn("decision", F.when(F.col("reason") == "worthwhile", "compression_candidate").otherwise("raw"))


def compress_roundtrip(files: DataFrame, block: int) -> DataFrame:
    """Each block's gzip size, and whether it unpacks to what it was."""
    ship(files.sparkSession)

    @F.pandas_udf("struct<compressed:long,sha256_ok:boolean>")
    def packed(parts: pd.Series) -> pd.DataFrame:
        def one(raw: bytes) -> tuple[int, bool]:
            data = gzip.compress(raw, 6, mtime=0)
            return len(data), hashlib.sha256(gzip.decompress(data)).digest() == hashlib.sha256(raw).digest()

        return pd.DataFrame([one(bytes(p)) for p in parts], columns=["compressed", "sha256_ok"])

    rows = slices(files, block).select("file_id", "chunk_id", "begin", "length", packed("part").alias("p"))
    return rows.select("file_id", F.col("chunk_id").alias("index"), "begin", F.col("length").alias("original"), "p.*")


def compress_effective(samples: DataFrame, task: str) -> DataFrame:
    """Packed over plain bytes of each task, and how many files stay raw."""
    raw = F.count_if(F.col("decision") == "raw")
    ratio: Column = F.round(F.sum("compressed_bytes") / F.sum("raw_bytes"), 6)
    return samples.groupBy(task).agg(ratio.alias("ratio"), F.count(F.lit(1)).alias("attempts"), raw.alias("raw_fallback"))
