"""Readers and writers of manifests, event logs, result tables and profiler texts.

Many manifests share a text file, one blank line apart, so that readers split large
files and a tree of small manifests isn't a tree of small files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from driftledger.functions.checksums import crc32c, crc32c_moved, crc32c_shift, crcs
from driftledger.functions.workers import ship, stored
from driftledger.operators.ranges import opening
from driftledger.operators.ranks import placed
from driftledger.operators.records import path_reason, without_sidecars

#: Keys of a transfer manifest in order, its version, and the key of the body's CRC.  Fixed values.
TRANSFER_KEYS = ["manifest_version", "transfer_id", "output_path_hex", "temp_path_hex", "total_size", "chunk_size", "checksum_algorithm", "created_at_unix_ns", "updated_at_unix_ns", "state", "completed_ranges", "verified_chunks"]
#: Keys of a download manifest in order.  Fixed values.
DOWNLOAD_KEYS = ["manifest_version", "transfer_id", "source_path_hex", "target_path_hex", "temp_path_hex", "total_size", "chunk_size", "checksum_algorithm", "created_at_unix_ns", "updated_at_unix_ns", "state", "completed_ranges", "verified_chunks"]
#: Keys of a tree manifest in order.  Fixed values.
TREE_KEYS = ["manifest_version", "mode", "root_logical_path_hex", "checksum_algorithm", "created_at_unix_ns", "updated_at_unix_ns", "files"]
CRC_KEY = "manifest_body_crc32c"
STATUSES = ["pending", "transferring", "completed", "failed", "changed"]


def _hex(text: Column) -> Column:
    return F.lower(F.hex(text.cast("binary")))


def _hex32(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 8, "0")


def _signed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``text`` of the key lines and of the CRC line over them."""
    ship(rows.sparkSession)
    body = F.concat(*(F.concat(F.lit(f"{k}="), F.col(k).cast("string"), F.lit("\n")) for k in keys))
    signed = F.concat("body", F.lit(f"{CRC_KEY}="), _hex32(F.col("crc")), F.lit("\n"))
    return rows.withColumn("body", body).withColumn("crc", crc32c(F.col("body").cast("binary"))).withColumn("text", signed).drop("body", "crc")


def sink_transfer_manifest(transfers: DataFrame, chunks: DataFrame, version: int | Column, kind: str = "upload") -> DataFrame:
    """Canonical text of each transfer: records by offset and id, ranges derived from them.

    ``transfers`` has transfer_id, temp_path, total_size, chunk_size, created_ns,
    updated_ns, state and output_path, or source_path and target_path for the kind
    ``download``; ``chunks`` transfer_id, chunk_id, begin, length and crc.  A transfer
    without chunks has empty lists.  ``version`` may be a column, of ``transfer_id``.
    """
    keys, paths = (DOWNLOAD_KEYS, ("source_path", "target_path", "temp_path")) if kind == "download" else (TRANSFER_KEYS, ("output_path", "temp_path"))
    record = F.struct("begin", "chunk_id", "length", "crc")
    opened = opening(chunks.select(F.col("transfer_id").alias("file_id"), "chunk_id", "begin", "length", "crc", (F.col("begin") + F.col("length")).alias("stop")))
    # A range goes on to the furthest stop before the next one opens; the last to the furthest of all.
    opens = F.array_sort(F.collect_list(F.when(F.col("new"), F.struct("begin", "past"))))
    lists = opened.groupBy(F.col("file_id").alias("transfer_id")).agg(F.array_sort(F.collect_list(record)).alias("r"), opens.alias("opens"), F.max("stop").alias("last"))
    stops = F.concat(F.transform(F.slice("opens", 2, F.greatest(F.size("opens") - 1, F.lit(0))), lambda x: x["past"]), F.array("last"))
    spans = F.array_join(F.zip_with("opens", stops, lambda x, stop: F.concat_ws("-", x["begin"].cast("string"), stop.cast("string"))), ",")
    texts = F.transform("r", lambda x: F.concat_ws(":", x["chunk_id"].cast("string"), x["begin"].cast("string"), x["length"].cast("string"), F.lit("crc32c"), _hex32(x["crc"])))
    rows = transfers.join(lists, "transfer_id", "left").select(
        "transfer_id", F.lit(version).alias("manifest_version"), *(_hex(F.col(p)).alias(f"{p}_hex") for p in paths), "total_size", "chunk_size",
        F.lit("crc32c").alias("checksum_algorithm"), F.col("created_ns").alias("created_at_unix_ns"), F.col("updated_ns").alias("updated_at_unix_ns"), "state",
        F.coalesce(spans, F.lit("")).alias("completed_ranges"), F.coalesce(F.array_join(texts, ","), F.lit("")).alias("verified_chunks"),
    )
    return _signed(rows, keys).select("transfer_id", "text")


def sink_tree_manifest(files: DataFrame, version: int, mode: str = "upload") -> DataFrame:
    """Canonical text of each tree (``manifest_id``): file records by path, paths and errors in hex."""
    lists = files.groupBy("manifest_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("relative_path", _tree_record().alias("t")))), lambda x: x["t"]), ",").alias("files"))
    return _signed(_tree_keys(lists, version, mode), TREE_KEYS).select("manifest_id", "text")


def _tree_record() -> Column:
    return F.concat_ws(":", _hex(F.col("relative_path")), F.col("size").cast("string"), F.col("mtime_s").cast("string"), "transfer_id", "status", _hex(F.coalesce("error", F.lit(""))))


def _tree_keys(rows: DataFrame, version: int, mode: str) -> DataFrame:
    """``rows`` with a tree's key columns, but for ``files``."""
    named = {"manifest_version": F.lit(version), "mode": F.lit(mode), "root_logical_path_hex": _hex(F.col("manifest_id")), "checksum_algorithm": F.lit("crc32c"), "created_at_unix_ns": F.lit(0), "updated_at_unix_ns": F.lit(0)}
    return rows.withColumns(named)


def write_manifests(manifests: DataFrame, path: str) -> None:
    manifests.select("text").write.text(path)


def _keyed(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """Key lines of each manifest as columns; ``broken`` where a key is missing or repeated.

    A manifest is cut into lines once; keys are looked up in its list of lines.
    """
    rows = spark.read.option("lineSep", "\n\n").text(path).select(F.concat(F.regexp_replace("value", r"\n+$", ""), F.lit("\n")).alias("text")).where("trim(text) <> '\n'")
    lines = F.filter(F.split("text", "\n"), lambda x: F.substring_index(x, "=", 1).isin(wanted) & x.contains("="))
    rows = rows.withColumn("lines", lines).withColumn("names", F.transform("lines", lambda x: F.substring_index(x, "=", 1)))
    value = lambda k: F.coalesce(F.substring(F.get("lines", F.array_position("names", k).cast("int") - 1), len(k) + 2, 1 << 30), F.lit("")).alias(k)
    kinds = F.size(F.array_distinct("names"))
    broken = F.when(F.size("names") > kinds, "duplicate_key").when(kinds < len(wanted), "missing_key")
    return rows.select("text", broken.alias("broken"), *map(value, wanted))


def _read(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Key lines of each manifest as columns, and the first rule that fails as ``reason``."""
    ship(spark)
    body = F.regexp_replace("text", f"(?m)^{CRC_KEY}=.*\\n", "")
    rows = _keyed(spark, path, [*keys, CRC_KEY]).withColumn("actual", _hex32(crc32c(body.cast("binary"))))
    return rows.withColumn("reason", F.coalesce("broken", F.when(F.col(CRC_KEY) != F.col("actual"), "bad_crc"))).drop("broken")


def _text(key: str) -> Column:
    return F.decode(F.unhex(key), "UTF-8")


def _number(x: Column) -> Column:
    return x.try_cast("long")


def _scan(spark: SparkSession, path: str, version: int, keys: list[str], paths: tuple[str, ...]) -> DataFrame:
    rows = _read(spark, path, keys)
    item = "struct<chunk_id:bigint,begin:bigint,length:bigint,crc:bigint>"
    items = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    cut = lambda c, sep: F.transform(items(c), lambda x: F.split(x, sep))
    chunks = F.transform(cut("verified_chunks", ":"), lambda p: F.struct(_number(F.get(p, F.lit(0))).alias("chunk_id"), _number(F.get(p, F.lit(1))).alias("begin"), _number(F.get(p, F.lit(2))).alias("length"), _number(F.conv(F.get(p, F.lit(4)), 16, 10)).alias("crc"))).cast(f"array<{item}>")
    ranges = F.transform(cut("completed_ranges", "-"), lambda p: F.struct(_number(F.get(p, F.lit(0))).alias("begin"), _number(F.get(p, F.lit(1))).alias("stop")))
    rows = rows.withColumn("chunks", chunks).withColumn("ranges", ranges).withColumn("total_size", _number(F.col("total_size")))
    held = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["begin"])
    listed = F.aggregate("chunks", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    reason = F.coalesce("reason", F.when(F.col("manifest_version") != str(version), "bad_version").when(~F.col("transfer_id").rlike("^[A-Za-z0-9._-]{1,128}$"), "bad_id").when(F.exists("chunks", lambda x: x["chunk_id"].isNull() | x["begin"].isNull() | x["length"].isNull() | x["crc"].isNull()), "bad_chunk").when(held != listed, "ranges_differ").when(F.exists("chunks", lambda x: x["begin"] + x["length"] > F.col("total_size")), "out_of_bounds"))
    return rows.select("transfer_id", *(_text(f"{p}_hex").alias(p) for p in paths), "total_size", _number(F.col("chunk_size")).alias("chunk_size"), "state", "ranges", "chunks", reason.alias("reason")).withColumn("is_valid", F.col("reason").isNull())


def scan_transfer_manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    """One row a manifest; ``reason`` names the first rule that fails, and its lists stay as read."""
    return _scan(spark, path, version, TRANSFER_KEYS, ("output_path", "temp_path"))


def scan_download_manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The same of download manifests, which have a source and a target path."""
    return _scan(spark, path, version, DOWNLOAD_KEYS, ("source_path", "target_path", "temp_path")).withColumn("kind", F.lit("download"))


def scan_tree_manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    """One row a file record, with the first rule that fails for it; repeated paths are counted by a shuffle on both names."""
    rows = _read(spark, path, TREE_KEYS).withColumn("manifest_id", _text("root_logical_path_hex"))
    broken = F.coalesce("reason", F.when(F.col("manifest_version") != str(version), "bad_version"))
    rows = rows.select("manifest_id", "mode", broken.alias("broken"), F.explode(F.filter(F.split("files", ","), lambda x: x != "")).alias("record"))
    return _tree_records(rows)


def _tree_records(rows: DataFrame) -> DataFrame:
    """Fields of each ``record`` of ``manifest_id, mode, broken``, and the first rule that fails."""
    part = F.split("record", ":")
    rows = rows.select("manifest_id", "mode", "broken", F.decode(F.unhex(part[0]), "UTF-8").alias("relative_path"), F.get(part, F.lit(1)).try_cast("long").alias("size"), F.get(part, F.lit(2)).try_cast("long").alias("mtime_s"), F.get(part, F.lit(3)).alias("transfer_id"), F.get(part, F.lit(4)).alias("status"), (F.size(part) != 6).alias("odd"))
    again = rows.groupBy("manifest_id", "relative_path").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(again, ["manifest_id", "relative_path"], "left")
    reason = F.coalesce("broken", F.when(F.col("odd") | F.col("size").isNull() | F.col("mtime_s").isNull(), "bad_record").when(path_reason(F.col("relative_path")).isNotNull(), "bad_path").when(F.col("n") > 1, "duplicate_path").when(~F.col("transfer_id").rlike("^[A-Za-z0-9._-]{1,128}$"), "bad_id").when(~F.col("status").isin(STATUSES), "bad_status"))
    return rows.select("manifest_id", "mode", "relative_path", "size", "mtime_s", "transfer_id", "status", reason.alias("reason")).withColumn("is_valid", F.col("reason").isNull())


#: Key of a tree's head that says how many bytes its list of records has in the one-row form.
LIST_BYTES_KEY = "files_bytes"


def _list_sums(records: DataFrame, *keys: str) -> DataFrame:
    """``bytes`` and ``files_crc`` of each tree's list from records that say where they are (``at``).

    In the one-row form a comma follows each record, and a line end the last.  A
    record's CRC is moved back by its end, so the fold needs no order; the last
    byte is changed at the end, as a CRC is linear.
    """
    stop = F.col("at") + F.octet_length("record") + 1
    moved = records.select(*keys, (F.octet_length("record") + 1).cast("long").alias("n"), crc32c_moved(F.concat("record", F.lit(",")).cast("binary"), -stop).alias("moved"))
    sums = moved.groupBy(*keys).agg(F.sum("n").alias("bytes"), F.bit_xor("moved").alias("moved"))
    comma, end = (int(c) for c in crcs([b",", b"\n"]))
    return sums.select(*keys, "bytes", crc32c_shift("moved", "bytes").bitwiseXOR(F.lit(comma ^ end).cast("long")).alias("files_crc"))


def _whole_crc(keys: list[str]) -> Column:
    """CRC of a tree's body in the one-row form, from its key lines and its list's sums."""
    head = F.concat(*(F.concat(F.lit(f"{k}="), F.col(k).cast("string"), F.lit("\n")) for k in keys), F.lit(f"{TREE_KEYS[-1]}="))
    return _hex32(crc32c_moved(head.cast("binary"), "bytes").bitwiseXOR(F.col("files_crc")))


def write_tree_manifest(files: DataFrame, path: str, version: int, mode: str = "upload") -> None:
    """Trees of any size below ``path``: a line for each record, in order of tree and path, and a head for each tree.

    A line is the root in hex, where the record begins in the one-row form's list,
    and the record, with a tab between; a head has the key lines, the list's
    bytes and the CRC of the whole one-row form, which is never built.  Records
    of one tree are placed and written by many tasks.  Files with a null ``manifest_id``
    are in no tree.
    """
    ship(files.sparkSession)
    rows = files.where("manifest_id IS NOT NULL").select("manifest_id", "relative_path", _tree_record().alias("record"))
    rows = placed(rows.withColumn("bytes", (F.octet_length("record") + 1).cast("long")), "manifest_id", ["relative_path", "record"], "bytes")
    lines = stored(rows.select("manifest_id", F.col("before").alias("at"), "record"), "tree-lines")
    lines.orderBy("manifest_id", "at").select(F.concat_ws("\t", _hex(F.col("manifest_id")), F.col("at").cast("string"), "record")).write.text(f"{path}/records")
    heads = _tree_keys(_list_sums(lines, "manifest_id"), version, mode).withColumn(LIST_BYTES_KEY, F.col("bytes")).withColumn(CRC_KEY, _whole_crc(TREE_KEYS[:-1]))
    heads.select(F.concat(*(F.concat(F.lit(f"{k}="), F.col(k).cast("string"), F.lit("\n")) for k in (*TREE_KEYS[:-1], LIST_BYTES_KEY, CRC_KEY)))).write.text(f"{path}/heads")


def _record_lines(spark: SparkSession, path: str) -> DataFrame:
    part = F.split("value", "\t", 3)
    return spark.read.text(f"{path}/records").select(part[0].alias("root"), _number(F.get(part, F.lit(1))).alias("at"), F.get(part, F.lit(2)).alias("record"))


def tree_manifest_check(spark: SparkSession, path: str, version: int) -> DataFrame:
    """``root, manifest_id, mode, bytes, expected, actual, broken`` of each tree that ``write_tree_manifest`` wrote.

    ``broken`` is the first rule that fails: a key is missing or repeated, there are several heads or none, bytes
    are missing or too many, the CRC or the version is another.  A tree without any line is
    here too.
    """
    ship(spark)
    keys = TREE_KEYS[:-1]
    heads = _keyed(spark, f"{path}/heads", [*keys, LIST_BYTES_KEY, CRC_KEY]).withColumnRenamed("root_logical_path_hex", "root")
    first = heads.groupBy("root").agg(F.count(F.lit(1)).alias("heads"), F.min(F.struct(*(c for c in heads.columns if c not in ("root", "text")))).alias("h")).select("root", "heads", "h.*")
    sums = _list_sums(_record_lines(spark, path).where("at IS NOT NULL AND record IS NOT NULL"), "root")
    rows = first.join(sums, "root", "full").withColumn("root_logical_path_hex", F.col("root")).withColumn("actual", _whole_crc(keys))
    held = F.coalesce("bytes", F.lit(0)) == _number(F.col(LIST_BYTES_KEY))
    broken = F.coalesce(F.when(F.col("heads").isNull(), "no_head"), "broken", F.when(F.col("heads") > 1, "duplicate_head").when(~F.coalesce(held, F.lit(False)), "bad_bytes").when(F.col(CRC_KEY) != F.col("actual"), "bad_crc").when(F.col("manifest_version") != str(version), "bad_version"))
    return rows.select("root", _text("root").alias("manifest_id"), "mode", "bytes", F.col(CRC_KEY).alias("expected"), "actual", broken.alias("broken"))


def read_tree_manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    """``scan_tree_manifest``'s rows of what ``write_tree_manifest`` wrote; a line that is cut breaks its tree."""
    checked = tree_manifest_check(spark, path, version).select("root", "manifest_id", "mode", "broken")
    return _tree_records(_record_lines(spark, path).where("record IS NOT NULL").join(checked, "root", "left").select("manifest_id", "mode", "broken", "record"))


def _reader(spark: SparkSession, stream: bool, files: int = 16):
    """A reader of files that are there, or of a stream of files as they come, some a batch."""
    return spark.readStream.option("maxFilesPerTrigger", files) if stream else spark.read


def scan_event_log(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """JSON lines with a stated schema; a line that isn't one keeps its text in ``_corrupt_record``."""
    return _reader(spark, stream).schema(f"{schema}, _corrupt_record string").json(path)


def told_apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a scan that were read, and the text of those that weren't; a streamed scan is to be written before."""
    rest = rows.drop("_corrupt_record")
    return rows.where("_corrupt_record IS NULL").select(rest.columns), rows.where("_corrupt_record IS NOT NULL").select("_corrupt_record")


def scan_results(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """CSV tables under one header; a value of another type is null."""
    text = spark.read.option("header", True).csv(paths)
    return text.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)), F.col("_metadata.file_name").alias("_source_csv"))


def transfer_log(lines: DataFrame, marker: str) -> DataFrame:
    """Intervals of a ``START= DATE= NBYTES= CODE= STREAMS= FILE=`` log; a run is named after ``marker`` in the path."""
    field = lambda k: F.regexp_extract("line", rf"(?:^| ){k}=(\S+)", 1)
    clock = lambda k: F.unix_micros(F.try_to_timestamp(field(k), F.lit("yyyyMMddHHmmss.SSSSSS")))
    run = F.split(F.substring_index(field("FILE"), marker, -1), "/")[0]
    return lines.where(field("FILE").contains(marker)).select(run.alias("run"), clock("START").alias("start_us"), clock("DATE").alias("stop_us"), *(field(k).try_cast("long").alias(n) for k, n in (("NBYTES", "bytes"), ("CODE", "code"), ("STREAMS", "streams"))))


def marked_json(lines: DataFrame, marker: str, schema: str) -> DataFrame:
    """Records of log lines that hold ``marker`` and JSON, by the allow-list ``schema``; the rest is malformed."""
    at = F.expr(f"instr(line, '{marker}')")
    rows = lines.where(at > 0).select("source", F.from_json(F.expr(f"substring(line, instr(line, '{marker}') + {len(marker)})"), f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.select("source", (F.col("r._bad").isNull() & F.col("r").isNotNull()).alias("parsed"), "r.*").drop("_bad")


def text_blocks(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """``block``: runs of lines between blank lines."""
    return _reader(spark, stream).option("lineSep", "\n\n").text(path).select(F.trim(F.col("value"), F.lit("\n")).alias("block")).where("block <> ''")


def stacks(blocks: DataFrame) -> DataFrame:
    """Samples of profiler text, one a block: a header line, then a line for each frame from the leaf.

    A header's fields are the command, ``pid`` or ``pid/tid``, maybe the CPU in brackets,
    the time with a colon, the period and the event's name with a colon.
    """
    lines = F.split("block", "\n")
    rows = blocks.select(lines.alias("lines"), F.filter(F.split(F.trim(lines[0]), r"\s+"), lambda x: ~x.rlike(r"^\[\d+\]$")).alias("head"))
    at = F.array_position(F.transform("head", lambda x: x.rlike(r"^\d+\.\d+:$")), True).cast("int") - 1
    field = lambda k: F.get("head", F.col("at") + k)
    rows = rows.withColumn("at", at).where(F.col("at") > 0).where(field(2).startswith("cpu-clock"))
    ids = F.split(field(-1), "/")
    symbol = lambda x: F.regexp_replace(x, r"^\s*[0-9a-f]+\s+|\s+\([^()]*\)\s*$", "")
    frames = F.transform(F.filter(F.slice("lines", 2, F.size("lines")), lambda x: x.rlike(r"^\s*[0-9a-f]+\s+\S") & F.rtrim(x).endswith(")")), symbol)
    return rows.select(_number(ids[0]).alias("pid"), _number(F.coalesce(F.get(ids, F.lit(1)), ids[0])).alias("tid"), F.floor(F.rtrim(field(0), F.lit(":")).cast("decimal(28,9)") * 1_000_000_000).cast("long").alias("at_ns"), _number(field(1)).alias("period"), frames.alias("symbols"))


def lost_samples(blocks: DataFrame) -> DataFrame:
    """How many lines of a profiler's text report lost samples; a complete profile has none."""
    return blocks.agg(F.coalesce(F.sum(F.size(F.filter(F.split("block", "\n"), lambda x: F.upper(x).contains("LOST")))), F.lit(0)).alias("lost"))


def counter_lines(lines: DataFrame) -> DataFrame:
    """``name: value`` lines of snapshots as counter rows; other lines are left out."""
    value = F.regexp_extract("line", r"^\s*([\w.\[\]-]+):\s*(-?\d+)\s*$", 2)
    return lines.select("source", F.regexp_extract("line", r"^\s*([\w.\[\]-]+):\s*(-?\d+)\s*$", 1).alias("name"), value.try_cast("long").alias("value")).where("value is not null")


#: First words of the hexadecimal columns of per-CPU packet statistics, and the column of the CPU.  Fixed values.
SOFTNET, SOFTNET_CPU = ("processed", "dropped", "time_squeeze"), 12


def scan_counters(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """``source, family, name, value`` of snapshots, a block each: ``# source family``, then lines as the family writes them.

    ``named``: ``name: value``; ``softnet``: hexadecimal columns for each CPU; ``netstat``:
    lines of names, each followed by its values; ``interrupts``: a line of CPUs, then
    counts of each.  A netstat pair that doesn't match has one row with a null value.
    """
    lines = F.split("block", "\n")
    head = F.split(lines[0], " ")
    rows = text_blocks(spark, path, stream).where(F.col("block").startswith("# ")).select(head[1].alias("source"), F.get(head, F.lit(2)).alias("family"), F.slice(lines, 2, F.size(lines)).alias("lines"))
    entry = lambda n, v: F.struct(n.alias("name"), v.cast("long").alias("value"))
    words = lambda x: F.split(F.trim(x), r"\s+")
    named = F.transform(F.filter("lines", lambda x: x.rlike(r"^\s*[\w.\[\]-]+:\s*-?\d+\s*$")), lambda x: entry(F.trim(F.substring_index(x, ":", 1)), _number(F.trim(F.substring_index(x, ":", -1)))))
    hexed = lambda x: F.conv(x, 16, 10)
    cpu = lambda w, i: F.when(F.size(w) > SOFTNET_CPU, hexed(F.get(w, F.lit(SOFTNET_CPU)))).otherwise(i.cast("string"))
    softnet = F.flatten(F.transform("lines", lambda x, i: F.array(*(entry(F.concat(cpu(words(x), i), F.lit(f".{n}")), hexed(F.get(words(x), F.lit(k)))) for k, n in enumerate(SOFTNET)))))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("lines") - 1, F.lit(0)), F.lit(2)), lambda i: F.struct(words(F.get("lines", i)).alias("n"), words(F.coalesce(F.get("lines", i + 1), F.lit(""))).alias("v")))
    agree = lambda p: (F.size(p["n"]) == F.size(p["v"])) & (p["n"][0] == p["v"][0])
    tail = lambda a: F.slice(a, 2, F.size(a))
    matched = lambda p: F.zip_with(tail(p["n"]), tail(p["v"]), lambda n, v: entry(F.concat(F.rtrim(p["n"][0], F.lit(":")), F.lit("."), n), _number(v)))
    netstat = F.flatten(F.transform(pairs, lambda p: F.when(agree(p), matched(p)).otherwise(F.array(entry(F.rtrim(p["n"][0], F.lit(":")), F.lit(None))))))
    cpus = words(F.get("lines", F.lit(0)))
    counts = lambda x: F.slice(words(F.substring_index(x, ":", -1)), 1, F.size(cpus))
    interrupts = F.flatten(F.transform(F.filter(tail(F.col("lines")), lambda x: x.contains(":")), lambda x: F.zip_with(cpus, counts(x), lambda c, v: entry(F.concat(F.trim(F.substring_index(x, ":", 1)), F.lit("."), c), _number(v)))))
    found = F.when(F.col("family") == "named", named).when(F.col("family") == "softnet", softnet).when(F.col("family") == "netstat", netstat).when(F.col("family") == "interrupts", interrupts)
    return rows.select("source", "family", F.inline(found))


def manifest_crc_check(spark: SparkSession, path: str) -> DataFrame:
    """The CRC that each transfer manifest states, the one its body has, and whether they agree."""
    rows = _read(spark, path, TRANSFER_KEYS)
    return rows.select("transfer_id", F.col(CRC_KEY).alias("expected"), "actual", (F.col(CRC_KEY) == F.col("actual")).alias("ok"))


def scan_sched_logs(spark: SparkSession, summary: str, events: str, samples: str, schemas: tuple[str, str, str], stream: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three logs of runs as tables or streams of their own."""
    return (
        _reader(spark, stream).schema(schemas[0]).option("header", True).csv(summary),
        _reader(spark, stream).schema(schemas[1]).json(events),
        _reader(spark, stream).schema(schemas[2]).option("header", True).csv(samples),
    )


def logs_present(logs: tuple[DataFrame, ...]) -> DataFrame:
    """Which of its logs a run has so far, as bits, and whether it has them all: of streams a row for each run of a batch (update mode)."""
    seen = [d.select("run", F.lit(1 << k).alias("bit")) for k, d in enumerate(logs)]
    rows = seen[0]
    for more in seen[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("run").agg(F.bit_or("bit").alias("logs")).withColumn("all_present", F.col("logs") == (1 << len(logs)) - 1)


def scan_client_summary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Summaries, one JSON object a line; their ``error`` object becomes ``error_message``."""
    rows = spark.read.schema(schema).json(path)
    return rows.withColumn("error_message", F.col("error.message")).drop("error")


def sink_report(summary: DataFrame, path: str, form: str = "csv") -> None:
    """A summary as CSV with a header or as JSON lines; its parts stay as Spark deals them."""
    if form == "json":
        summary.write.option("ignoreNullFields", False).json(path)
    else:
        summary.write.option("header", True).csv(path)


def scan_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Regular files below ``path``, sidecars left out: relative path, size and time; contents stay unread."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    relative = F.substring("path", len(root) + 2, 1 << 30)
    return without_sidecars(files.select(relative.alias("relative_path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime_s")))


def evidence_index(files: DataFrame, allowed: list[str]) -> DataFrame:
    """``name``, ``bytes`` and ``sha256`` of the allowed of ``files``; ``reason`` where a name is unsafe or missing.

    A name is a file's own, without folders; any other is unsafe.
    """
    names = files.sparkSession.createDataFrame([(n,) for n in sorted(set(allowed))], "name string")
    unsafe = F.col("name").rlike(r"[/\\\x00-\x1f]") | F.col("name").isin("", ".", "..")
    rows = names.join(files.select("name", "bytes", "sha256"), "name", "left")
    reason = F.when(unsafe, "unsafe_name").when(F.col("bytes").isNull(), "missing")
    return rows.select("name", F.when(~unsafe, F.col("bytes")).alias("bytes"), F.when(~unsafe, F.col("sha256")).alias("sha256"), reason.alias("reason"))


def source_digests(spark: SparkSession, path: str) -> DataFrame:
    """``source``, ``sha256`` of each log file; a source is named by its folder ``source=NAME``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    return files.select(F.regexp_extract("path", r"/source=([^/]+)/", 1).alias("source"), F.sha2("content", 256).alias("sha256"))
