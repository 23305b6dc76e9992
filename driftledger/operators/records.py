"""Classification, validation and reconciliation of file and run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Error codes and the texts that mean them, in the order in which they are tried: a
#: message matches if it holds a text of each inner tuple.  Fixed values.
ERROR_RULES: list[tuple[str, list[tuple[str, ...]]]] = [
    ("auth_required", [("please login", "auth required")]),
    ("auth_failed", [("login incorrect", "invalid user", "pass rejected", "user rejected", "auth failed", "token")]),
    ("data_tls_required", [("tls",), ("required",), ("data",)]),
    ("tls_required", [("tls",), ("required",)]),
    ("data_tls_failed", [("data",), ("tls", "ssl")]),
    ("tls_failed", [("tls", "ssl", "certificate", "private key")]),
    ("path_rejected", [("path",), ("reject", "escape", "relative", "outside", "directory", "file")]),
    ("manifest_corrupt", [("manifest",), ("corrupt", "checksum", "invalid", "required", "modified")]),
    ("checksum_mismatch", [("checksum",), ("mismatch", "failed")]),
    ("changed_file", [("changed",)]),
    ("remote_sync_failed", [("remote",), ("sync", "artifact")]),
    ("protocol_error", [("protocol", "frame", "unexpected", "rejected", "closed connection")]),
    ("config_error", [("unknown option", "requires a value", "must be", "invalid")]),
    ("io_error", [("io", "read", "write", "open", "stat", "rename", "connect", "recv", "send", "socket", "filesystem", "directory")]),
]
#: Findings and their patterns, from the public descriptions of the credentials' formats.
#: They need no look-around, so that any regular expression engine reads them alike.
HYGIENE = [
    ("pem_private_key", r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----"),
    ("cloud_access_key_id", r"\b(AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("hosting_token", r"\bgh[pousr]_[A-Za-z0-9]{36}\b"),
    ("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("json_web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\."),
    ("password_argument", r"(?i)\bsshpass +-p *[^ -]|--?pass(word)?[ =][^ -]"),
    ("credential_in_url", r"(?i)\b[a-z][a-z0-9+.-]*://[^/\s:@]+:[^/\s:@]+@"),
    ("named_secret", r"(?i)(passwd|password|secret|token|api_?key|access_?key)[a-z_]*['\"]? *[:=] *['\"]?[A-Za-z0-9+/._-]{8,}"),
]
#: Names of files that belong to a transfer, not to its tree.
SIDECARS = (".part.", ".driftledger.")
#: Words, in any case, and signs of lines that stand for a secret and aren't one; text in angle brackets does, too.
STANDS_FOR = ("redacted", "changeme", "placeholder", "***")


def stands_for_secret(line: Column) -> Column:
    """Whether a line holds one of ``STANDS_FOR`` or something named in angle brackets."""
    held = F.lit(False)
    for word in STANDS_FOR:
        held = held | F.lower(line).contains(word)
    return held | line.rlike("<[^<>]+>")



def error_code(message: Column) -> Column:
    """The first matching code; ``ok`` for an empty message, else ``unknown_error``."""
    text = F.lower(message)
    out = F.when(F.coalesce(text, F.lit("")) == "", "ok")
    for code, groups in ERROR_RULES:
        meets = F.lit(True)
        for group in groups:
            some = F.lit(False)
            for part in group:
                some = some | text.contains(part)
            meets = meets & some
        out = out.when(meets, code)
    return out.otherwise("unknown_error")


def error_sql(column: str) -> str:
    cases = " ".join("WHEN " + " AND ".join("(" + " OR ".join(f"contains(lower({column}), '{p}')" for p in g) + ")" for g in groups) + f" THEN '{code}'" for code, groups in ERROR_RULES)
    return f"CASE WHEN coalesce({column}, '') = '' THEN 'ok' {cases} ELSE 'unknown_error' END"


def redact(message: Column) -> Column:
    return F.regexp_replace(message, r"PASS [^\r\n\t ]*", "PASS <redacted>")


def path_reason(path: Column) -> Column:
    """Why a relative path is refused, null if it isn't; the first rule that fails counts."""
    segments = F.split(path, "/")
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "empty")
        .when(path.rlike(r"^[/\\]"), "not_relative")
        .when(path.contains("\\"), "backslash")
        .when(path.rlike(r"[\x00-\x1f\x7f]"), "control_character")
        .when(path.rlike("^[A-Za-z]:"), "drive_prefix")
        .when(F.exists(segments, lambda s: s.isin("", ".", "..")), "bad_segment")
    )


def resolve(base: str, path: Column) -> tuple[Column, Column]:
    """The path below the root after ``.`` and ``..``, and whether it ever left the root."""
    parts = F.split(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base + "/"), path)), "/")
    empty = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        at = acc["at"]
        up = F.struct(F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))).alias("at"), (acc["out"] | (F.size(at) == 0)).alias("out"))
        down = F.struct(F.concat(at, F.array(part)).alias("at"), acc["out"].alias("out"))
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(down)

    end = F.aggregate(parts, empty, step)
    return F.concat(F.lit("/"), F.array_join(end["at"], "/")), end["out"]


def size_bytes(text: Column) -> Column:
    """``64MiB``, ``1g``, ``10kb``: bytes; one letter and ``iB`` are binary, ``b`` alone after it is decimal."""
    number = F.regexp_extract(text, r"^\s*(\d+)", 1).try_cast("long")
    unit = F.lower(F.regexp_extract(text, r"^\s*\d+\s*([A-Za-z]*)\s*$", 1))
    factor = F.when(unit.isin("", "b"), 1)
    for power, letter in enumerate("kmg", 1):
        factor = factor.when(unit.isin(letter, f"{letter}ib"), 1024**power).when(unit == f"{letter}b", 1000**power)
    return number * factor


def without_sidecars(files: DataFrame, names: tuple[str, ...] = SIDECARS) -> DataFrame:
    """``files`` without those whose ``relative_path`` holds one of ``names``."""
    keep = F.lit(True)
    for name in names:
        keep = keep & ~F.col("relative_path").contains(name)
    return files.where(keep)


def without_owned_sidecars(files: DataFrame, manifests: DataFrame, suffix: str) -> DataFrame:
    """The strict form: a file with ``suffix`` goes only if it is a valid manifest of the target that its name says.

    ``manifests`` has ``relative_path``, ``output_path`` and ``is_valid`` of what was read from such files.
    """
    target = F.col("output_path") == F.expr(f"substring(relative_path, 1, length(relative_path) - {len(suffix)})")
    owned = manifests.where(F.col("relative_path").endswith(suffix) & F.col("is_valid") & target).select("relative_path").distinct()
    return files.join(owned, "relative_path", "left_anti")


def hygiene_scan(docs: DataFrame, rules: list[tuple[str, str]] = HYGIENE, denied: tuple[str, ...] = ()) -> DataFrame:
    """Findings by document and line, ``denied_text`` for a line that holds a denied one; lines with a placeholder are skipped."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body")).where(~stands_for_secret(F.col("body")))
    found = [F.when(F.col("body").rlike(p), F.lit(n)) for n, p in rules]
    if denied:
        holds = F.lit(False)
        for text in denied:
            holds = holds | F.col("body").contains(text)
        found.append(F.when(holds, F.lit("denied_text")))
    return lines.select("doc_id", (F.col("line") + 1).cast("int").alias("line_no"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("finding"))


def preflight(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """Manifest against the current inventory by path: unchanged, changed, missing or extra, and what to say of it."""
    a, b = manifest.alias("a"), current.alias("b")
    drift = (F.col("a.size") != F.col("b.size")) | (F.col("a.mtime_s") != F.col("b.mtime_s"))
    verdict = F.when(F.col("b.size").isNull(), "missing").when(F.col("a.size").isNull(), "extra").when(drift, "changed").otherwise("unchanged")
    path = F.coalesce("a.relative_path", "b.relative_path")
    return a.join(b, F.col("a.relative_path") == F.col("b.relative_path"), "full").select(path.alias("path"), verdict.alias("verdict"), F.col("a.size").alias("manifest_size"), F.col("b.size").alias("current_size"), F.when(verdict != "unchanged", F.concat(verdict, F.lit(": "), path)).alias("message"))


def download_preflight(manifest: DataFrame, remote: DataFrame, local: DataFrame) -> DataFrame:
    """Manifest against remote and, for completed files, against local."""
    r = remote.select("relative_path", F.col("size").alias("r_size"), F.col("mtime_s").alias("r_mtime"))
    lo = local.select("relative_path", F.col("size").alias("l_size"))
    rows = manifest.join(r, "relative_path", "left").join(lo, "relative_path", "left")
    verdict = (
        F.when(F.col("r_size").isNull(), "remote_missing")
        .when((F.col("r_size") != F.col("size")) | (F.col("r_mtime") != F.col("mtime_s")), "remote_changed")
        .when((F.col("status") == "completed") & F.col("l_size").isNull(), "local_missing")
        .when((F.col("status") == "completed") & (F.col("l_size") != F.col("size")), "local_changed")
        .otherwise("ok")
    )
    return rows.select(F.col("relative_path").alias("path"), verdict.alias("verdict"))


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def listing(files: DataFrame, folder: str = "") -> DataFrame:
    """Immediate children of a folder (the root if empty): directories have size 0 and their newest file's time."""
    prefix = f"{folder.strip('/')}/" if folder.strip("/") else ""
    inside = files.where(F.col("relative_path").startswith(prefix)) if prefix else files
    parts = F.split(F.substring("relative_path", len(prefix) + 1, 1 << 30), "/")
    rows = inside.select(parts[0].alias("name"), (F.size(parts) > 1).alias("is_dir"), "size", "mtime_s")
    return rows.groupBy("name").agg(F.max("is_dir").alias("is_dir"), F.max(F.when(F.col("is_dir"), 0).otherwise(F.col("size"))).cast("long").alias("size"), F.max("mtime_s").alias("mtime_s"))


def metric_lines(lines: DataFrame) -> DataFrame:
    """The last line of ``name=value`` pairs of each source."""
    pairs = F.map_from_arrays(F.regexp_extract_all("line", F.lit(r"(\w+)=\S+"), 1), F.regexp_extract_all("line", F.lit(r"\w+=(\S+)"), 1))
    return lines.groupBy("source").agg(F.max_by("line", "line_no").alias("line"), F.max("line_no").alias("line_no")).select("source", "line_no", pairs.alias("metrics"))
