"""Queries of digests, verification, compression, text formats and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftledger.functions.workers import shared_folder
from driftledger.operators import integrity, profiles
from driftledger.sources import formats
from driftledger.streaming import flows

from .tables import Tables, sql

CHUNK, VERSION = 1024, 3
EVENT_LOG = "sequence long, transfer_id string, event string, result string, bytes long, elapsed_seconds double, message string"
RESULTS = "system string, dataset string, repeat_index long, line int, goodput double, result string"


def _files(t: Tables):
    return t.documents.select(F.col("doc_id").alias("file_id"), F.col("source").alias("root"), F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("relative_path"), F.encode("text", "UTF-8").alias("content"))


def _damaged(t: Tables):
    """Recorded chunks: every 9th is corrupt, every 10th is lost, and each 5th file has one beyond its content."""
    rows = integrity.crc32c_chunks(_files(t), CHUNK).where((F.col("file_id") + F.col("chunk_id")) % 10 != 0)
    rows = rows.withColumn("crc", F.when((F.col("file_id") + F.col("chunk_id")) % 9 == 0, F.col("crc").bitwiseXOR(1)).otherwise(F.col("crc"))).select("file_id", "chunk_id", "crc")
    return rows.unionByName(t.f1.where("file_id % 5 = 0").select("file_id", F.lit(100_000).cast("long").alias("chunk_id"), F.lit(7).cast("long").alias("crc")))


def _sizes(t: Tables):
    return _files(t).select("file_id", "root", "relative_path", F.length("content").cast("long").alias("size"))


def _samples(t: Tables):
    return integrity.compress_sample(_files(t), 4096)


def _written_manifests(t: Tables, kind: str = "upload") -> str:
    """Where manifests of acknowledged chunks are written as text; each 7th is altered on its way, each 11th of the rest has another version."""
    ident = F.concat(F.lit("t-"), F.col("file_id").cast("string")).alias("transfer_id")
    chunks = t.acks.groupBy("file_id", "chunk_id", "begin", "length").agg((F.max("crc") % 2**32).alias("crc")).select(ident, "chunk_id", "begin", "length", "crc")
    path = lambda p: F.concat(F.lit(f"{p}/"), "file_id")
    paths = [path("in").alias("source_path"), path("out").alias("target_path")] if kind == "download" else [path("out").alias("output_path")]
    transfers = t.f2.select("file_id").distinct().select(ident, *paths, path("tmp").alias("temp_path"), F.lit(7168).cast("long").alias("total_size"), F.lit(CHUNK).cast("long").alias("chunk_size"), F.lit(1).alias("created_ns"), F.lit(2).alias("updated_ns"), F.lit("partial").alias("state"))
    number = F.substring_index("transfer_id", "-", -1).cast("long")
    old = number % 11 == 0
    texts = formats.sink_transfer_manifest(transfers, chunks, F.when(old, VERSION - 1).otherwise(VERSION), kind)
    texts = texts.withColumn("text", F.when(number % 7 == 0, F.replace("text", F.lit("state=partial"), F.lit("state=complete"))).otherwise(F.col("text")))
    path = shared_folder(t.spark, "transfer-manifests")
    formats.write_manifests(texts, path)
    return path


def _listed(rows, *paths: str):
    return rows.select("transfer_id", *paths, "total_size", F.size("chunks").alias("chunks"), F.size("ranges").alias("ranges"), F.aggregate("chunks", F.lit(0).cast("long"), lambda a, x: a + x["crc"]).alias("crc_sum"), "is_valid", "reason")


def _transfer_manifest(t: Tables):
    return _listed(formats.scan_transfer_manifest(t.spark, _written_manifests(t), VERSION), "output_path")


def _download_manifest(t: Tables):
    return _listed(formats.scan_download_manifest(t.spark, _written_manifests(t, "download"), VERSION), "kind", "source_path", "target_path")


def _tree_files(t: Tables):
    return t.f1.select(F.col("dataset").alias("manifest_id"), "relative_path", "size", "mtime_s", "transfer_id", "status", F.lit("").alias("error"))


def _odd_tree_files(t: Tables):
    """Files of which some have an absolute, a repeated path, a bad id or an unknown status."""
    k = F.col("file_id") % 23
    odd = F.when(k == 1, F.concat(F.lit("/"), "relative_path")).when(k == 2, "same").otherwise(F.col("relative_path"))
    return t.f1.select(F.col("dataset").alias("manifest_id"), odd.alias("relative_path"), "size", "mtime_s", F.when(k == 3, "a b").otherwise(F.col("transfer_id")).alias("transfer_id"), F.when(k == 4, "gone").otherwise(F.col("status")).alias("status"), F.lit("").alias("error"))


def _tree_texts(t: Tables):
    return formats.sink_tree_manifest(_tree_files(t), VERSION)


_RECORD = ["manifest_id", "relative_path", "size", "mtime_s", "transfer_id", "status", "is_valid", "reason"]


def _tree_manifest(t: Tables):
    path = shared_folder(t.spark, "tree-manifests")
    formats.write_manifests(formats.sink_tree_manifest(_odd_tree_files(t), VERSION), path)
    return formats.scan_tree_manifest(t.spark, path, VERSION).select(_RECORD)


def _tree_lines(t: Tables):
    """Lines of trees of any size, each with the CRC that its tree's head states."""
    path = shared_folder(t.spark, "tree-lines")
    formats.write_tree_manifest(_tree_files(t), path, VERSION)
    part = F.split("value", "\t")
    lines = t.spark.read.text(f"{path}/records").select(part[0].alias("root"), part[1].cast("long").alias("at"), part[2].alias("record"))
    return lines.join(formats.tree_manifest_check(t.spark, path, VERSION), "root").select("manifest_id", F.col("at").alias("begin"), "record", "bytes", "expected", "broken")


def _tree_lines_read(t: Tables):
    """The odd files as lines; trees named ..7 lose their first line on the way, those named ..5 have another path in it."""
    path, cut = shared_folder(t.spark, "tree-lines"), shared_folder(t.spark, "tree-lines-cut")
    formats.write_tree_manifest(_odd_tree_files(t), path, VERSION)
    t.spark.read.option("lineSep", "\n\n").text(f"{path}/heads").write.option("lineSep", "\n\n").text(f"{cut}/heads")
    first = lambda end: F.col("value").rlike(f"^[0-9a-f]*3{end}\t0\t")
    altered = F.when(first(5), F.regexp_replace("value", "\t0\t(2f)?73", "\t0\t$153")).otherwise(F.col("value"))
    t.spark.read.text(f"{path}/records").where(~first(7)).select(altered).write.text(f"{cut}/records")
    return formats.read_tree_manifest(t.spark, cut, VERSION).select(_RECORD)


def _inventory(t: Tables):
    """Files that Spark writes from the documents, one for each source and language, and some sidecars."""
    path = shared_folder(t.spark, "inventory")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]", " ").alias("text")
    t.documents.select("source", "lang", text).repartition("source", "lang").write.partitionBy("source", "lang").text(path)
    t.documents.where("doc_id % 3 = 0").select(F.concat("source", F.lit(".part.x")).alias("source"), text).write.mode("append").partitionBy("source").text(path)
    found = formats.scan_inventory(t.spark, path).where("relative_path NOT LIKE '\\_%'")
    return found.select(F.regexp_replace("relative_path", r"part-[^/]*$", "part").alias("relative_path"), "size", (F.col("mtime_s") > 0).alias("timed"))


def _log_files(t: Tables, name: str, lines):
    """Lines with a source and an order, written as one text file a source."""
    path = shared_folder(t.spark, name)
    lines.repartition("source").sortWithinPartitions("source", "at").select("source", "line").write.partitionBy("source").text(path)
    return path


def _lines_of(t: Tables, path: str):
    return t.spark.read.option("basePath", path).text(path).select(F.col("source").cast("string").alias("source"), F.col("value").alias("line"))


def _evidence_files(t: Tables):
    """Summaries written as single small files; the index has those allowed, and names that it refuses."""
    path = shared_folder(t.spark, "evidence")
    counts = t.events.groupBy(F.concat(F.col("event_type"), F.lit(".csv")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.select("name", F.concat(F.lit("rows="), "n").alias("line"))
    rows.repartition("name").write.partitionBy("name").text(f"{path}/by-name")
    return path


def _evidence_index(t: Tables):
    """Each file of the evidence is indexed in its own folder; the allow-list names it, a missing and an unsafe one."""
    path = _evidence_files(t)
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(f"{path}/by-name")
    listed = files.select(F.regexp_extract("path", "name=([^/]+)/", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return formats.evidence_index(listed, [*(f"{e}.csv" for e in ("click", "error", "purchase", "signup", "view")), "absent.csv", "../up.csv"])


def _sched_logs(t: Tables):
    """Three logs a run, written and read back; runs by user, some without one of them."""
    base = shared_folder(t.spark, "sched")
    rows = t.events.select(F.col("user_id").alias("run"), "event_id", F.floor("value").alias("value"), "event_type")
    formats.sink_report(rows.groupBy("run").agg(F.sum("value").alias("bytes")), f"{base}/summary")
    rows.where("event_type = 'view' AND run % 3 <> 0").select("run", "event_id", "event_type").write.json(f"{base}/events")
    formats.sink_report(rows.where("event_type = 'click'").select("run", "value"), f"{base}/samples")
    paths, schemas = (f"{base}/summary", f"{base}/events", f"{base}/samples"), ("run long, bytes long", "run long, event_id long, event_type string", "run long, value long")
    # Presence is told as files arrive; what the last batch says of a run holds.
    present = flows.drained(formats.logs_present(formats.scan_sched_logs(t.spark, *paths, schemas, stream=True)), "sched-present", mode="update")
    last = present.groupBy("run").agg(F.max_by("all_present", "batch").alias("all_present"))
    found = [d.join(last, "run") for d in formats.scan_sched_logs(t.spark, *paths, schemas)]
    common = lambda d, name, key, value: d.select(F.lit(name).alias("log"), "run", key.cast("string").alias("entry"), value.cast("long").alias("value"), "all_present")
    none = F.lit(None)
    return common(found[0], "summary", none, F.col("bytes")).unionByName(common(found[1], "event", F.col("event_type"), F.col("event_id"))).unionByName(common(found[2], "sample", none, F.col("value")))


def _client_summary(t: Tables):
    path = shared_folder(t.spark, "client-summary")
    t.f3.select("sequence", "bytes", F.when(F.col("message") != "", F.struct(F.col("message"), F.lit(1).alias("code"))).alias("error")).write.json(path)
    return formats.scan_client_summary(t.spark, path, "sequence long, bytes long, error struct<message: string, code: int>")


def _report(t: Tables):
    """The same summary written as CSV and as JSON lines, and read back."""
    summary, path = t.f4.groupBy("system", "dataset").agg(F.count(F.lit(1)).alias("runs"), F.max("goodput").alias("best")), shared_folder(t.spark, "report")
    for form in ("csv", "json"):
        formats.sink_report(summary, f"{path}/{form}", form)
    schema = "system string, dataset string, runs long, best double"
    rows = formats.scan_results(t.spark, [f"{path}/csv"], schema).drop("_source_csv").withColumn("form", F.lit("csv"))
    return rows.unionByName(t.spark.read.schema(schema).json(f"{path}/json").withColumn("form", F.lit("json")))


def _dataset_manifest(t: Tables):
    """Profile, files, bytes and digest, and each file's entry; entries are rows, so a profile may hold any number."""
    whole = integrity.tree_hash_content(_files(t), CHUNK).select(F.col("root").alias("profile"), "file_count", F.col("bytes").alias("total_bytes"), "tree_hash")
    entry = F.to_json(F.struct(F.col("relative_path").alias("path"), F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256")))
    return _files(t).select(F.col("root").alias("profile"), entry.alias("file")).join(whole, "profile")


def _event_log(t: Tables):
    """The log is read as a stream; each ninth line is cut short, and goes to the side."""
    path = shared_folder(t.spark, "event-log")
    rows = t.f3.select(*(c.split()[0] for c in EVENT_LOG.split(", ")))
    text = F.to_json(F.struct(*rows.columns))
    rows.select(F.when(F.col("sequence") % 9 == 4, F.substring(text, 1, 20)).otherwise(text)).write.text(path)
    read, broken = formats.told_apart(flows.drained(formats.scan_event_log(t.spark, path, EVENT_LOG, stream=True), "event-log").drop("batch"))
    return read.withColumn("broken", F.lit(None).cast("string")).unionByName(broken.withColumnRenamed("_corrupt_record", "broken"), allowMissingColumns=True)


def _results(t: Tables):
    path = shared_folder(t.spark, "results")
    t.f4.select("system", "dataset", "repeat_index", "line", "goodput", F.when(F.col("line") == 7, F.lit("n/a")).otherwise(F.col("result")).alias("result")).write.option("header", True).csv(path)
    return formats.scan_results(t.spark, [path], RESULTS).drop("_source_csv")


def _log_lines(t: Tables):
    """Lines of a transfer log, written as text and read back."""
    stamp = lambda us: F.concat(F.date_format(F.timestamp_micros(us), "yyyyMMddHHmmss.SSSSSS"))
    begin = F.unix_micros(F.col("ts").cast("timestamp"))
    lines = t.events.select(F.concat(F.lit("DATE="), stamp(begin + 1_500_000), F.lit(" START="), stamp(begin), F.lit(" NBYTES="), F.floor(F.col("value") * 1000), F.lit(" CODE=226 STREAMS="), F.col("user_id") % 4 + 1, F.lit(" FILE=/data/"), F.when(F.col("event_type") == "view", "other").otherwise("raw"), F.lit("/u"), "user_id", F.lit("/f")).alias("line"))
    path = shared_folder(t.spark, "transfer-log")
    lines.write.text(path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


def _marked_files(t: Tables):
    body = F.to_json(F.struct(F.col("event_id").alias("id"), F.floor("value").alias("n"), F.lit("x").alias("not_listed")))
    text = F.concat(F.lit("12:00 OBSERVED "), F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(body))
    return _log_files(t, "marked", t.events.select(F.concat(F.lit("u"), F.col("user_id") % 20).alias("source"), F.col("event_id").alias("at"), text.alias("line")))


def _marked_lines(t: Tables):
    return _lines_of(t, _marked_files(t))


def _marked(t: Tables):
    """Records of the log files, each with its file's digest."""
    path = _marked_files(t)
    return formats.marked_json(_lines_of(t, path), "OBSERVED ", "id long, n long").join(formats.source_digests(t.spark, path), "source")


def _blocks(t: Tables):
    """Profiler samples and one lost-sample line for each hundred, written as text blocks and read back."""
    frame = lambda name: F.concat(F.lit("\n\t  7f00ab "), name, F.lit(" (/usr/lib/x.so)"))
    text = F.concat(F.lit("worker  "), "user_id", F.lit("/"), "event_id", F.lit(" [001] "), F.col("event_id").cast("string"), F.lit(".250000000: "), F.floor(F.col("value") * 1000), F.lit(" cpu-clock:"), frame(F.col("event_type")), frame(F.concat(F.lit("tcp_"), F.col("user_id") % 3)), frame(F.lit("main")))
    lost = t.events.where("event_id % 100 = 0").select(F.lit("PERF_RECORD_LOST lost 3").alias("block"))
    path = shared_folder(t.spark, "stacks")
    t.events.select(text.alias("block")).unionByName(lost).select(F.concat("block", F.lit("\n"))).write.text(path)
    return formats.text_blocks(t.spark, path)


def _counters(t: Tables):
    """Snapshots of four families as text blocks: a block for each event, its numbers from the event's."""
    e, v = F.col("event_id"), F.floor("value").cast("long")
    line = lambda *parts: F.concat(F.lit("\n"), *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    hexed = lambda c: F.lower(F.hex(c))
    zeros = F.lit(" 0" * 9)
    family = e % 4
    body = (
        F.when(family == 0, F.concat(line("     rx_bytes: ", v), line("  tx_errors: ", e), line("not a counter")))
        .when(family == 1, F.concat(line(hexed(v), " ", hexed(e), " 1", zeros, " ", hexed(F.lit(5))), line(hexed(e), " 0 ff")))
        .when(family == 2, F.concat(line("TcpExt: Sent Lost"), line("TcpExt: ", v, " ", e), line("IpExt: In Out"), line("IpExt: 1")))
        .otherwise(F.concat(line("           CPU0       CPU1"), line(" 45:  ", v, "   ", e, "  PCI-MSI  eth0")))
    )
    name = F.element_at(F.array(*map(F.lit, ("named", "softnet", "netstat", "interrupts"))), (family + 1).cast("int"))
    path = shared_folder(t.spark, "counters")
    t.events.select(F.concat(F.lit("# e"), e, F.lit(" "), name, body, F.lit("\n"))).write.text(path)
    return flows.drained(formats.scan_counters(t.spark, path, stream=True), "counters").drop("batch")


def _stacks(t: Tables):
    return formats.stacks(_blocks(t)).withColumn("run", F.col("pid") % 5)


def _with_lost(blocks):
    """Samples, and in each row how many lines report lost ones (one number for the whole profile)."""
    return formats.stacks(blocks).withColumn("symbols", F.array_join("symbols", ";")).crossJoin(F.broadcast(formats.lost_samples(blocks)))


def _snapshots(t: Tables):
    """Processes in snapshots of hosts; ticks, bytes and counts from the events' times and numbers."""
    v, e, second = F.floor(F.col("value")).cast("long"), F.col("event_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    ticks = [(second * (k + 1) + e % (7 + k)).alias(c) for k, c in enumerate(profiles.TICKS)]
    return t.events.select((F.col("user_id") % 5).alias("run"), F.col("user_id").alias("pid"), (F.col("user_id") % 8).alias("cpu"), "event_id", "ts", v.alias("cpu_ticks"), (v * 5).alias("read_bytes"), (e % 1009).alias("write_bytes"), (second * 3 + v).alias("tx_bytes"), (second + e).alias("rx_bytes"), (e % 97).alias("rss"), (e % 31).alias("fds"), *ticks, F.element_at(F.array(*map(F.lit, "RSD")), (e % 3 + 1).cast("int")).alias("state"), F.col("event_type").alias("wchan"))


def _leaves(t: Tables):
    """By run, and by thread."""
    whole = profiles.leaves(_stacks(t), 40).withColumn("pid", F.lit(None).cast("long"))
    return whole.unionByName(profiles.leaves(_stacks(t), 3, ("run", "pid")))


#: Categories of symbols that may overlap.  Fixed values.
CATEGORIES = {"network": "tcp_|sock_|recv|send", "publish": "purchase|rename", "main": "^main$|;main$"}

QUERIES = {
    "crc32c_chunks": lambda t: integrity.crc32c_chunks(_files(t), CHUNK),
    "crc32c_combine": lambda t: integrity.crc32c_combine(integrity.crc32c_chunks(_files(t), CHUNK)),
    "tree_hash_content": lambda t: integrity.tree_hash_content(_files(t), CHUNK),
    "tree_hash_chunks": lambda t: integrity.tree_hash_chunks(_sizes(t), integrity.crc32c_chunks(_files(t), 4 * CHUNK)),
    "chunk_verify": lambda t: integrity.chunk_verify(_files(t), _damaged(t), CHUNK),
    "compress_sample": _samples,
    "compress_roundtrip": lambda t: integrity.compress_roundtrip(_files(t), 4096),
    "compress_effective": lambda t: integrity.compress_effective(_samples(t).join(t.f1.select("file_id", "dataset"), "file_id"), "dataset"),
    "scan_transfer_manifest": _transfer_manifest,
    "scan_tree_manifest": _tree_manifest,
    "scan_tree_manifest_lines": _tree_lines_read,
    "scan_download_manifest": _download_manifest,
    "scan_inventory": _inventory,
    "sink_evidence_index": _evidence_index,
    "sink_transfer_manifest": lambda t: t.spark.read.option("lineSep", "\n\n").text(_written_manifests(t)),
    "sink_tree_manifest": _tree_texts,
    "sink_tree_manifest_lines": _tree_lines,
    "scan_event_log": _event_log,
    "scan_sched_logs": _sched_logs,
    "scan_client_summary": _client_summary,
    "sink_report": _report,
    "sink_dataset_manifest": _dataset_manifest,
    "manifest_crc_check": lambda t: formats.manifest_crc_check(t.spark, _written_manifests(t)).select("transfer_id", "ok"),
    "scan_results": _results,
    "scan_transfer_log": lambda t: formats.transfer_log(_log_lines(t), "/raw/"),
    "scan_marked_json": _marked,
    "scan_counters": _counters,
    "scan_stacks": lambda t: _with_lost(_blocks(t)),
    "stack_leaf": _leaves,
    "stack_inclusive": lambda t: profiles.inclusive(_stacks(t), CATEGORIES),
    "stack_caller": lambda t: profiles.callers(_stacks(t), "view", "^tcp_"),
    "host_metrics": lambda t: profiles.host_metrics(_snapshots(t)),
    "cpu_delta": lambda t: profiles.cpu_delta(_snapshots(t)),
    "blocked_threads": lambda t: profiles.blocked(_snapshots(t)),
}

_STACK = "st AS (SELECT user_id AS pid, user_id % 5 AS run, floor(value * 1000)::BIGINT AS period, event_type AS leaf, 'tcp_' || (user_id % 3) AS caller FROM events)"
_SNAP = "sn AS (SELECT user_id % 5 AS run, user_id AS pid, event_id, ts, floor(value)::BIGINT AS v, epoch_us(ts::TIMESTAMP) // 1000000 AS second, user_id % 8 AS cpu, event_id % 97 AS rss, substr('RSD', (event_id % 3 + 1)::INT, 1) AS state, event_type AS wchan FROM events)"
#: Changes of all ticks and of three of them.
_TICKED = "36 * (b.s - a.s) + " + " + ".join(f"b.e % {7 + k} - a.e % {7 + k}" for k in range(8)) + " AS total, 4 * (b.s - a.s) + b.e % 10 - a.e % 10 AS idle, 5 * (b.s - a.s) + b.e % 11 - a.e % 11 AS iowait, 7 * (b.s - a.s) + b.e % 13 - a.e % 13 AS soft"
_RUNS = "SELECT *, chunk_id - row_number() OVER (PARTITION BY file_id ORDER BY chunk_id) AS island FROM c"

#: A table of CRC-32C steps, and the CRC of bytes given as hexadecimal digits, from the polynomial alone.
_CRC_TABLE = "crc_table AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 2197175160) ELSE a >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)))"


def _crc(digits: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all({digits}, '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295)"


_DOCS = "docs AS (SELECT doc_id AS file_id, source AS root, source || '/' || lang || '/' || doc_id || '.txt' AS relative_path, strlen(text) AS size, hex(encode(text)) AS h FROM documents)"
_PARTS = f"{_CRC_TABLE}, {_DOCS}, cut AS (SELECT file_id, unnest(range(0, (size + 1023) // 1024)) AS chunk_id, h FROM docs WHERE size > 0), parts AS (SELECT file_id, chunk_id, substr(h, chunk_id * 2048 + 1, 2048) AS h FROM cut), crcs AS (SELECT file_id, chunk_id, chunk_id * 1024 AS begin, strlen(h) // 2 AS length, {_crc('h')} AS crc FROM parts, crc_table)"
_TREE = f"{_CRC_TABLE}, {_DOCS}, tree AS (SELECT root, string_agg(hex(encode(relative_path)) || '00' || hex(encode(size::VARCHAR)) || '00' || h || '00', '' ORDER BY relative_path) AS h, count(*) AS file_count, sum(size)::BIGINT AS bytes FROM docs GROUP BY 1), hashes AS (SELECT root, 'crc32c:' || printf('%08x', {_crc('h')}) AS tree_hash, file_count, bytes FROM tree, crc_table)"
_VERIFY = f"""{_PARTS}, seen AS (SELECT *, (file_id + chunk_id) % 10 <> 0 AS recorded, (file_id + chunk_id) % 10 <> 0 AND (file_id + chunk_id) % 9 <> 0 AS kept FROM crcs),
 runs AS (SELECT *, chunk_id - row_number() OVER (PARTITION BY file_id, kept ORDER BY chunk_id) AS run FROM seen),
 sums AS (SELECT file_id, count(*) FILTER (kept) AS kept, count(*) FILTER (recorded AND NOT kept) AS removed, count(*) FILTER (NOT recorded) AS missing, coalesce(sum(length) FILTER (kept), 0)::BIGINT AS verified_bytes, count(DISTINCT run) FILTER (kept) AS kept_ranges, count(DISTINCT run) FILTER (NOT kept) AS missing_ranges FROM runs GROUP BY 1)"""


def _manifest_text(kind: str) -> str:
    """The text of a transfer's manifest, its CRC line as ``signed``."""
    paths = "'source_path_hex=' || lower(hex(encode('in/' || file_id))) || chr(10) || 'target_path_hex=' || lower(hex(encode('out/' || file_id)))" if kind == "download" else "'output_path_hex=' || lower(hex(encode('out/' || file_id)))"
    return f"""{_CRC_TABLE}, k AS (SELECT file_id, chunk_id, max(crc) % 4294967296 AS crc FROM acks GROUP BY 1, 2), r AS (SELECT *, chunk_id - row_number() OVER (PARTITION BY file_id ORDER BY chunk_id) AS run FROM k),
 sp AS (SELECT file_id, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM (SELECT file_id, min(chunk_id) * 1024 AS a, (max(chunk_id) + 1) * 1024 AS b FROM r GROUP BY file_id, run) GROUP BY 1),
 ch AS (SELECT file_id, string_agg(chunk_id || ':' || chunk_id * 1024 || ':1024:crc32c:' || printf('%08x', crc), ',' ORDER BY chunk_id) AS list FROM k GROUP BY 1),
 body AS (SELECT file_id, 'manifest_version=' || CASE WHEN file_id % 11 = 0 THEN {VERSION - 1} ELSE {VERSION} END || chr(10) || 'transfer_id=t-' || file_id || chr(10) || {paths} || chr(10) || 'temp_path_hex=' || lower(hex(encode('tmp/' || file_id))) || chr(10) || 'total_size=7168' || chr(10) || 'chunk_size=1024' || chr(10) || 'checksum_algorithm=crc32c' || chr(10) || 'created_at_unix_ns=1' || chr(10) || 'updated_at_unix_ns=2' || chr(10) || 'state=partial' || chr(10) || 'completed_ranges=' || spans || chr(10) || 'verified_chunks=' || list || chr(10) AS body FROM ch JOIN sp USING (file_id)),
 signed AS (SELECT file_id, CASE WHEN file_id % 7 = 0 THEN replace(body, 'state=partial', 'state=complete') ELSE body END || 'manifest_body_crc32c=' || printf('%08x', {_crc('hex(encode(body))')}) AS text FROM body, crc_table)"""


_SCANNED = "total_size, chunks, ranges, crc_sum, file_id % 7 <> 0 AND file_id % 11 <> 0 AS is_valid, CASE WHEN file_id % 7 = 0 THEN 'bad_crc' WHEN file_id % 11 = 0 THEN 'bad_version' END AS reason FROM (SELECT file_id, 7168 AS total_size, count(*) AS chunks, count(DISTINCT island) AS ranges, sum(crc)::BIGINT AS crc_sum FROM r GROUP BY file_id)"
_K = "file_id % 23"
_ODD_TREE = f"o AS (SELECT dataset AS manifest_id, {_K} AS k, CASE {_K} WHEN 1 THEN '/' || relative_path WHEN 2 THEN 'same' ELSE relative_path END AS relative_path, size, mtime_s, CASE WHEN {_K} = 3 THEN 'a b' ELSE transfer_id END AS transfer_id, CASE WHEN {_K} = 4 THEN 'gone' ELSE status END AS status FROM f1), n AS (SELECT *, count(*) OVER (PARTITION BY manifest_id, relative_path) AS n FROM o), w AS (SELECT *, CASE WHEN k = 1 THEN 'bad_path' WHEN n > 1 THEN 'duplicate_path' WHEN k = 3 THEN 'bad_id' WHEN k = 4 THEN 'bad_status' END AS reason FROM n)"
_TREE_RECORD = "lower(hex(encode(relative_path))) || ':' || size || ':' || mtime_s || ':' || transfer_id || ':' || status || ':'"
_TREE_TEXT = f"{_CRC_TABLE}, body AS (SELECT dataset AS manifest_id, 'manifest_version={VERSION}' || chr(10) || 'mode=upload' || chr(10) || 'root_logical_path_hex=' || lower(hex(encode(dataset))) || chr(10) || 'checksum_algorithm=crc32c' || chr(10) || 'created_at_unix_ns=0' || chr(10) || 'updated_at_unix_ns=0' || chr(10) || 'files=' || string_agg({_TREE_RECORD}, ',' ORDER BY relative_path) || chr(10) AS body FROM f1 GROUP BY dataset)"

SQL = {
    "scan_download_manifest": f"WITH c AS (SELECT file_id, chunk_id, max(crc) % 4294967296 AS crc FROM acks GROUP BY 1, 2), r AS ({_RUNS}) SELECT 't-' || file_id AS transfer_id, 'download' AS kind, 'in/' || file_id AS source_path, 'out/' || file_id AS target_path, {_SCANNED}",
    "sink_evidence_index": "WITH n AS (SELECT event_type || '.csv' AS name, 'rows=' || count(*) || chr(10) AS body FROM events GROUP BY event_type) SELECT name, strlen(body) AS bytes, sha256(body) AS sha256, NULL AS reason FROM n UNION ALL SELECT 'absent.csv', NULL, NULL, 'missing' UNION ALL SELECT '../up.csv', NULL, NULL, 'unsafe_name'",
    "scan_inventory": "SELECT 'source=' || source || '/lang=' || lang || '/part' AS relative_path, sum(strlen(regexp_replace(coalesce(text, ''), '[\\r\\n]', ' ', 'g')) + 1)::BIGINT AS size, true AS timed FROM documents GROUP BY source, lang",
    "sink_dataset_manifest": f"WITH {_TREE} SELECT root AS profile, '{{\"path\":\"' || relative_path || '\",\"bytes\":' || size || ',\"sha256\":\"' || sha256(unhex(h)) || '\"}}' AS file, file_count, bytes AS total_bytes, tree_hash FROM docs JOIN hashes USING (root)",
    "sink_tree_manifest": f"WITH {_TREE_TEXT} SELECT manifest_id, body || 'manifest_body_crc32c=' || printf('%08x', {_crc('hex(encode(body))')}) || chr(10) AS text FROM body, crc_table",
    "sink_tree_manifest_lines": f"WITH {_TREE_TEXT}, w AS (SELECT manifest_id, {_crc('hex(encode(body))')} AS crc FROM body, crc_table), r AS (SELECT dataset AS manifest_id, relative_path, {_TREE_RECORD} AS record FROM f1), p AS (SELECT *, coalesce(sum(strlen(record) + 1) OVER (PARTITION BY manifest_id ORDER BY relative_path, record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin, sum(strlen(record) + 1) OVER (PARTITION BY manifest_id)::BIGINT AS bytes FROM r) SELECT manifest_id, begin, record, bytes, printf('%08x', crc) AS expected, NULL::VARCHAR AS broken FROM p JOIN w USING (manifest_id)",
    "sink_transfer_manifest": f"WITH {_manifest_text('upload')} SELECT text AS value FROM signed",
    "chunk_verify": f"WITH {_VERIFY} SELECT d.file_id, coalesce(kept, 0) AS kept, coalesce(removed, 0) + CASE WHEN d.file_id % 5 = 0 THEN 1 ELSE 0 END AS removed_corrupt, coalesce(missing, 0) AS missing, coalesce(verified_bytes, 0) AS verified_bytes, coalesce(kept_ranges, 0) AS kept_ranges, coalesce(missing_ranges, 0) AS missing_ranges FROM docs d LEFT JOIN sums s ON d.file_id = s.file_id",
    "tree_hash_chunks": f"WITH {_TREE} SELECT *, NULL::VARCHAR AS reason FROM hashes",
    "tree_hash_content": f"WITH {_TREE} SELECT * FROM hashes",
    "crc32c_combine": f"WITH {_CRC_TABLE}, {_DOCS} SELECT file_id, size, {_crc('h')} AS crc FROM docs, crc_table WHERE size > 0",
    "crc32c_chunks": f"WITH {_PARTS} SELECT * FROM crcs",
    "scan_sched_logs": "WITH e AS (SELECT user_id AS run, event_id, floor(value)::BIGINT AS v, event_type FROM events), p AS (SELECT run, run % 3 <> 0 AND count(*) FILTER (event_type = 'view') > 0 AND count(*) FILTER (event_type = 'click') > 0 AS all_present FROM e GROUP BY 1), r AS (SELECT 'summary' AS log, run, NULL AS entry, sum(v)::BIGINT AS value FROM e GROUP BY run UNION ALL SELECT 'event', run, event_type, event_id FROM e WHERE event_type = 'view' AND run % 3 <> 0 UNION ALL SELECT 'sample', run, NULL, v FROM e WHERE event_type = 'click') SELECT r.*, all_present FROM r JOIN p USING (run)",
    "scan_client_summary": "SELECT sequence, bytes, CASE WHEN message <> '' THEN message END AS error_message FROM f3",
    "sink_report": "SELECT system, dataset, count(*) AS runs, max(goodput) AS best, form FROM f4, (VALUES ('csv'), ('json')) v(form) GROUP BY 1, 2, 5",
    "manifest_crc_check": "SELECT DISTINCT 't-' || file_id AS transfer_id, file_id % 7 <> 0 AS ok FROM f2",
    "scan_transfer_manifest": f"WITH c AS (SELECT file_id, chunk_id, max(crc) % 4294967296 AS crc FROM acks GROUP BY 1, 2), r AS ({_RUNS}) SELECT 't-' || file_id AS transfer_id, 'out/' || file_id AS output_path, {_SCANNED}",
    "scan_tree_manifest": f"WITH {_ODD_TREE} SELECT manifest_id, relative_path, size, mtime_s, transfer_id, status, reason IS NULL AS is_valid, reason FROM w",
    "scan_tree_manifest_lines": f"WITH {_ODD_TREE}, q AS (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY relative_path, {_TREE_RECORD}) = 1 AS head, right(manifest_id, 1) AS e FROM w), l AS (SELECT * REPLACE (CASE WHEN head AND e = '5' THEN regexp_replace(relative_path, '^(/?)s', '\\1S') ELSE relative_path END AS relative_path, CASE WHEN e = '7' THEN 'bad_bytes' WHEN e = '5' THEN 'bad_crc' ELSE reason END AS reason) FROM q WHERE NOT (head AND e = '7')) SELECT manifest_id, relative_path, size, mtime_s, transfer_id, status, reason IS NULL AS is_valid, reason FROM l",
    "scan_event_log": "SELECT sequence, transfer_id, event, result, bytes, elapsed_seconds, message, NULL::VARCHAR AS broken FROM f3 WHERE sequence % 9 <> 4 UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, substr('{\"sequence\":' || sequence || ',\"transfer_id\":\"' || transfer_id, 1, 20) FROM f3 WHERE sequence % 9 = 4",
    "scan_results": "SELECT system, dataset, repeat_index, line, goodput, CASE WHEN line = 7 THEN 'n/a' ELSE result END AS result FROM f4",
    "scan_transfer_log": "SELECT 'u' || user_id AS run, epoch_us(ts::TIMESTAMP) AS start_us, epoch_us(ts::TIMESTAMP) + 1500000 AS stop_us, floor(value * 1000)::BIGINT AS bytes, 226 AS code, user_id % 4 + 1 AS streams FROM events WHERE event_type <> 'view'",
    "scan_marked_json": """WITH e AS (SELECT 'u' || (user_id % 20) AS source, event_id, event_id % 10 <> 0 AS parsed, floor(value)::BIGINT AS n FROM events),
 h AS (SELECT source, sha256(string_agg('12:00 OBSERVED ' || CASE WHEN parsed THEN '{\"id\":' || event_id || ',\"n\":' || n || ',\"not_listed\":\"x\"}' ELSE '{broken' END || chr(10), '' ORDER BY event_id)) AS sha256 FROM e GROUP BY 1)
 SELECT source, parsed, CASE WHEN parsed THEN event_id END AS id, CASE WHEN parsed THEN n END AS n, sha256 FROM e JOIN h USING (source)""",
    "scan_counters": """WITH e AS (SELECT 'e' || event_id AS source, event_id, floor(value)::BIGINT AS v FROM events)
 SELECT source, 'named' AS family, unnest(['rx_bytes', 'tx_errors']) AS name, unnest([v, event_id]) AS value FROM e WHERE event_id % 4 = 0
 UNION ALL SELECT source, 'softnet', unnest(['5.processed', '5.dropped', '5.time_squeeze', '1.processed', '1.dropped', '1.time_squeeze']), unnest([v, event_id, 1, event_id, 0, 255]) FROM e WHERE event_id % 4 = 1
 UNION ALL SELECT source, 'netstat', unnest(['TcpExt.Sent', 'TcpExt.Lost', 'IpExt']), unnest([v, event_id, NULL]) FROM e WHERE event_id % 4 = 2
 UNION ALL SELECT source, 'interrupts', unnest(['45.CPU0', '45.CPU1']), unnest([v, event_id]) FROM e WHERE event_id % 4 = 3""",
    "scan_stacks": "SELECT user_id AS pid, event_id AS tid, event_id * 1000000000 + 250000000 AS at_ns, floor(value * 1000)::BIGINT AS period, event_type || ';tcp_' || (user_id % 3) || ';main' AS symbols, (SELECT count(*) FROM events WHERE event_id % 100 = 0) AS lost FROM events",
    "stack_leaf": f"WITH {_STACK}, g AS (SELECT run, leaf AS symbol, sum(period)::BIGINT AS cpu_ns FROM st GROUP BY 1, 2), h AS (SELECT run, pid, leaf AS symbol, sum(period)::BIGINT AS cpu_ns FROM st GROUP BY 1, 2, 3) SELECT run, NULL::BIGINT AS pid, symbol, cpu_ns, round(cpu_ns / sum(cpu_ns) OVER (PARTITION BY run), 6) AS fraction FROM g UNION ALL SELECT run, pid, symbol, cpu_ns, fraction FROM (SELECT *, round(cpu_ns / sum(cpu_ns) OVER (PARTITION BY run, pid), 6) AS fraction, row_number() OVER (PARTITION BY run, pid ORDER BY cpu_ns DESC, symbol) AS k FROM h) WHERE k <= 3",
    "stack_inclusive": f"WITH {_STACK}, tot AS (SELECT run, sum(period) AS t FROM st GROUP BY 1), g AS (SELECT run, unnest(CASE WHEN leaf = 'purchase' THEN ['network', 'publish', 'main'] ELSE ['network', 'main'] END) AS category, period FROM st) SELECT g.run, category, sum(period)::BIGINT AS cpu_ns, round(sum(period) / any_value(t), 6) AS fraction FROM g JOIN tot ON g.run = tot.run GROUP BY 1, 2",
    "stack_caller": f"WITH {_STACK} SELECT run, 'one:' || caller AS caller_class, sum(period)::BIGINT AS period FROM st WHERE leaf = 'view' GROUP BY 1, 2",
    "host_metrics": f"WITH {_SNAP}, p AS (SELECT run, pid, max(v) - min(v) AS c, 5 * (max(v) - min(v)) AS r, max(event_id % 1009) - min(event_id % 1009) AS w FROM sn GROUP BY 1, 2), c AS (SELECT run, sum(c)::BIGINT AS cpu_lower_bound, sum(r)::BIGINT AS read_delta, sum(w)::BIGINT AS write_delta FROM p GROUP BY 1), f AS (SELECT run, arg_min({{'s': second, 'e': event_id, 'v': v}}, (ts, event_id)) AS a, arg_max({{'s': second, 'e': event_id, 'v': v}}, (ts, event_id)) AS b, max(rss) AS peak_rss, max(event_id % 31) AS peak_fds, epoch_us(max(ts)::TIMESTAMP) - epoch_us(min(ts)::TIMESTAMP) AS us FROM sn GROUP BY 1), x AS (SELECT *, 3 * (b.s - a.s) + b.v - a.v AS tx, b.s - a.s + b.e - a.e AS rx, {_TICKED} FROM f) SELECT x.run, tx AS tx_delta, rx AS rx_delta, CASE WHEN us > 0 THEN round(tx * 8 / us / 1000, 9) END AS tx_gbps, CASE WHEN us > 0 THEN round(rx * 8 / us / 1000, 9) END AS rx_gbps, cpu_lower_bound, peak_fds, peak_rss, read_delta, write_delta, CASE WHEN total > 0 THEN round((total - idle - iowait) / total, 6) END AS busy_fraction, CASE WHEN total > 0 THEN round(iowait / total, 6) END AS iowait_fraction FROM x JOIN c ON x.run = c.run",
    "cpu_delta": f"WITH {_SNAP}, f AS (SELECT run, cpu, arg_min({{'s': second, 'e': event_id}}, (ts, event_id)) AS a, arg_max({{'s': second, 'e': event_id}}, (ts, event_id)) AS b FROM sn GROUP BY 1, 2), x AS (SELECT *, {_TICKED} FROM f), g AS (SELECT run, cpu, round((total - idle - iowait) / total, 6) AS busy_fraction, round(soft / total, 6) AS softirq_fraction FROM x WHERE total > 0) SELECT *, row_number() OVER (PARTITION BY run ORDER BY busy_fraction DESC, cpu) AS rank FROM g",
    "blocked_threads": f"WITH {_SNAP} SELECT run, wchan, count(*) AS count, round(count(*) FILTER (state IN ('S', 'D')) / count(*), 6) AS blocked_fraction FROM sn GROUP BY 1, 2",
}
SQL = {k: sql(v) for k, v in SQL.items()}
