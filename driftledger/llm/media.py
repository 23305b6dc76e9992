"""Content-defined chunks of media payloads, each stored once.

A payload is cut where a rolling gear hash of its last 32 bytes has leading
zeros.  Spark joins find the chunks that occur more than once; one place is such
a chunk's owner and the others refer to it.  Most payloads share no chunk, and a
bit table of fixed size shows that without moving them; only the others are
shuffled, once.  A medium's stored form is its list of chunks, kept in its row,
followed by those chunks, kept in their owners' rows.  Reading joins the owners'
chunks to those who refer to them and checks each payload against its SHA-256.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .shared import bit_table, folder, in_table, prepare, stored

#: Payloads are whole numbers of these units of 8-bit samples.
UNIT = 64
#: Mean, least and greatest chunk.
MEAN_BITS, LEAST, MOST = 11, 256, 16384
SEED = 42

#: ``head`` is the stored list of a medium's chunks, ``samples`` the bytes of those that it owns.
STORE = "key binary, head binary, digests array<binary>, own array<int>, lent array<int>, samples binary"
FACTS = "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
MAGIC = b"GEARCDC1"


@functools.lru_cache(1)
def _gear() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with bytes 0 up to a positive multiple of ``UNIT``, and its unpadded length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % UNIT if raw else UNIT), len(raw)


def cut(payload: bytes) -> list[bytes]:
    """Chunks of a payload; the last may be under ``LEAST``."""
    h = _gear()[np.frombuffer(payload, np.uint8)]
    width = 1
    while width < 32:  # the sum over 32 bytes, each shifted by its distance, by doubling
        more = h.copy()
        more[width:] += h[:-width] << np.uint32(width)
        h, width = more, width * 2
    ends = np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1
    out, at = [], 0
    for end in [*ends.tolist(), len(payload)]:
        while end - at > MOST:
            out.append(payload[at : at + MOST])
            at += MOST
        if end - at >= LEAST or end == len(payload) and end > at:
            out.append(payload[at:end])
            at = end
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:16]


def head_of(chunks: list[bytes]) -> bytes:
    """The stored list of a medium's chunks: format, count, then digest and size of each."""
    return MAGIC + len(chunks).to_bytes(4, "little") + b"".join(digest(c) + len(c).to_bytes(4, "little") for c in chunks)


def entries(head: bytes) -> list[tuple[bytes, int]]:
    """Digest and size of each chunk of a stored list."""
    count = int.from_bytes(head[8:12], "little")
    if head[:8] != MAGIC or len(head) != 12 + 20 * count:
        raise ValueError("no list of chunks")
    return [(head[k : k + 16], int.from_bytes(head[k + 16 : k + 20], "little")) for k in range(12, len(head), 20)]


def key_of(text: Column) -> Column:
    """SHA-256 of the payload, as binary."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(raw)
    pad = F.when(size == 0, F.lit(UNIT)).otherwise(F.pmod(-size, F.lit(UNIT)))
    return F.unhex(F.sha2(F.concat(raw, F.unhex(F.repeat(F.lit("00"), pad))), 256))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, keys, places = [], [], []
        for text in batch.column("text").to_pylist():
            payload, _ = payload_of(text)
            key = hashlib.sha256(payload).digest()
            found = [digest(b"whole" + key), *map(digest, cut(payload))]  # place -1 is the whole
            digests += found
            keys += [key] * len(found)
            places += range(-1, len(found) - 1)
        yield pa.RecordBatch.from_pydict({"digest": pa.array(digests, pa.binary()), "key": pa.array(keys, pa.binary()), "place": pa.array(places, pa.int32())})


def _route(batches: Iterator[pa.RecordBatch], table: np.ndarray, shared: bool) -> Iterator[pa.RecordBatch]:
    """Payloads without a chunk in the table as store rows, or those with one by key, compressed for the way."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            payload, _ = payload_of(text)
            key = hashlib.sha256(payload).digest()
            chunks = cut(payload)
            head = head_of(chunks)
            hashes = [xxhash.xxh64_intdigest(d, seed=42) for d in [digest(b"whole" + key), *(d for d, _ in entries(head))]]
            hit = bool(in_table(table, np.array(hashes, np.uint64)).any())
            if hit == shared:
                out.append((key, press.compress(payload)) if shared else (key, head, [], list(range(len(chunks))), [], payload))
        yield _rows(out, "key binary, frame binary" if shared else STORE)


KINDS = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "array<binary>": pa.list_(pa.binary()), "array<int>": pa.list_(pa.int32())}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads with the places of their chunks that occur elsewhere -> store rows."""
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            chunks = cut(open_.decompress(row["frame"]))
            lends = {r["place"]: r["owner"] for r in row["roles"] or ()}
            own = [i for i in range(len(chunks)) if lends.get(i, True)]
            out.append((row["key"], head_of(chunks), list(map(digest, chunks)), own, [i for i in own if i in lends], b"".join(chunks[i] for i in own)))
        yield _rows(out, STORE)


def write_store(docs: DataFrame, path: str) -> None:
    """Chunk ``docs``' payloads and write each different chunk once, below ``path``."""
    spark = docs.sparkSession
    texts = docs.select("text")
    found = texts.mapInArrow(_occurrences, "digest binary, key binary, place int")
    places = stored(found.groupBy("digest", "key", "place").agg(F.count(F.lit(1)).alias("n")), "chunk-places")
    shared = places.groupBy("digest").agg(F.sum("n").alias("n"), F.min(F.struct("key", "place")).alias("owner")).where("n > 1")
    shared = stored(shared.select("digest", "owner"), "shared-chunks")
    # Where the table fills up, more payloads are shuffled, each once at most.
    sent = bit_table(shared.select(F.xxhash64("digest")))
    # Alone: straight to the store.
    alone = texts.mapInArrow(lambda it: _route(it, sent.value, False), STORE)
    alone.write.option("compression", "zstd").parquet(f"{path}/alone")
    # The others: one row of each, with what the joins say of its chunks.
    others = texts.mapInArrow(lambda it: _route(it, sent.value, True), "key binary, frame binary").groupBy("key").agg(F.first("frame").alias("frame"))
    owner = (F.col("owner.key") == F.col("key")) & (F.col("owner.place") == F.col("place"))
    roles = places.where("place >= 0").join(shared, "digest").select("key", F.struct("place", owner.alias("owner")).alias("role")).groupBy("key").agg(F.collect_list("role").alias("roles"))
    settled = others.join(roles, "key", "left").select("key", "frame", "roles").mapInArrow(_settle, STORE)
    settled.write.option("compression", "zstd").parquet(f"{path}/sharing")


def facts_of(head: bytes, chunks: list[bytes], key: bytes) -> tuple:
    """Facts of a stored medium: its form is the stored list followed by the stored chunks."""
    payload = b"".join(chunks)
    sha = hashlib.sha256(payload)
    if sha.digest() != key or [(digest(c), len(c)) for c in chunks] != entries(head):
        raise ValueError(f"payload {key.hex()} is not what was stored")
    form = hashlib.sha256(head)
    form.update(payload)
    samples = np.frombuffer(payload, np.uint8)
    steps = np.abs(np.diff(samples.astype(np.int16)))
    feature = f"chunks={len(chunks)};mean={samples.mean():.6f};deviation={samples.std():.6f};peak={samples.max()};step={steps.mean():.6f}"
    return key, len(payload), sha.hexdigest(), zlib.crc32(payload[-UNIT:]), len(head) + len(payload), form.hexdigest(), feature


def _own(row: dict) -> dict[int, bytes]:
    sizes, out, at = [n for _, n in entries(row["head"])], {}, 0
    for i in row["own"]:
        out[i] = row["samples"][at : at + sizes[i]]
        at += sizes[i]
    return out


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Store rows, with ``parts`` that they refer to where they have such -> facts of the payload."""
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            chunks = _own(row) | {p["place"]: open_.decompress(p["bytes"]) for p in row.get("parts") or ()}
            out.append(facts_of(row["head"], [chunks[i] for i in range(len(chunks))], row["key"]))
        yield _rows(out, FACTS)


def _lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            own = _own(row)
            out += [(row["digests"][i], press.compress(own[i])) for i in row["lent"]]
        yield _rows(out, "digest binary, bytes binary")


def read_store(spark, path: str) -> DataFrame:
    """Facts of each payload of a store, from the stored bytes."""
    alone = spark.read.schema(STORE).parquet(f"{path}/alone")
    sharing = spark.read.schema(STORE).parquet(f"{path}/sharing")
    whole = F.size("own") == F.size("digests")
    plain = alone.unionByName(sharing.where(whole)).mapInArrow(_assemble, FACTS)
    part = sharing.where(~whole)
    lent = sharing.where(F.size("lent") > 0).mapInArrow(_lend, "digest binary, bytes binary")
    wanted = part.select("key", "own", F.posexplode("digests").alias("place", "digest")).where(~F.array_contains("own", F.col("place"))).select("key", "place", "digest")
    parts = wanted.join(lent, "digest").groupBy("key").agg(F.collect_list(F.struct("place", "bytes")).alias("parts"))
    joined = part.join(parts, "key").select(*part.columns, "parts").mapInArrow(_assemble, FACTS)
    return plain.unionByName(joined)


def media_facts(docs: DataFrame) -> DataFrame:
    """One row a document: ``doc_id``, ``n_bytes`` and the facts of its payload, read back.

    A null or empty text is a payload of 64 bytes 0.  Equal texts share one
    medium and all values.  ``media_bytes`` and ``media_sha256`` are of the stored
    list and chunks as read back.  Repeated rows and null ids stay; an empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = folder(spark, "media")
    write_store(docs, path)
    facts = stored(read_store(spark, path), "media-facts")
    keys = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), key_of(F.col("text")).alias("key"))
    return keys.join(facts, "key").drop("key")
