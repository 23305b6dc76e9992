"""Stack samples and host snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def leaves(samples: DataFrame, top: int, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """CPU time by leaf symbol, the ``top`` ones of each run, or run and thread (a top-k report), as a share of all of it."""
    sums = samples.groupBy(*by, F.try_element_at("symbols", F.lit(1)).alias("symbol")).agg(F.sum("period").alias("cpu_ns"))
    of = Window.partitionBy(*by)
    rows = sums.withColumn("fraction", F.round(F.col("cpu_ns") / F.sum("cpu_ns").over(of), 6)).withColumn("place", F.row_number().over(of.orderBy(F.desc("cpu_ns"), "symbol")))
    return rows.where(F.col("place") <= top).drop("place")


def inclusive(samples: DataFrame, categories: dict[str, str]) -> DataFrame:
    """CPU time of stacks that hold a symbol of each category; categories may overlap."""
    stack = F.array_join("symbols", ";")
    hits = F.filter(F.array(*(F.when(stack.rlike(p), F.lit(c)) for c, p in categories.items())), lambda x: x.isNotNull())
    totals = samples.groupBy("run").agg(F.sum("period").alias("total"))
    rows = samples.select("run", "period", F.explode(hits).alias("category")).groupBy("run", "category").agg(F.sum("period").alias("cpu_ns"))
    return rows.join(totals, "run").select("run", "category", "cpu_ns", F.round(F.col("cpu_ns") / F.col("total"), 6).alias("fraction"))


def callers(samples: DataFrame, target: str, pattern: str) -> DataFrame:
    """Self time of ``target`` by the callers that match: the one, ``ambiguous`` or ``other``."""
    found = F.array_distinct(F.filter(F.slice("symbols", 2, 1_000_000), lambda s: s.rlike(pattern)))
    kind = F.when(F.size(found) == 1, F.concat(F.lit("one:"), F.try_element_at(found, F.lit(1)))).when(F.size(found) > 1, "ambiguous").otherwise("other")
    return samples.where(F.try_element_at("symbols", F.lit(1)) == target).groupBy("run", kind.alias("caller_class")).agg(F.sum("period").alias("period"))


#: Ticks of a CPU line in their order; guest ticks are already in the first two.  Fixed values.
TICKS = ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal")


def _changes(rows: DataFrame, keys: list[str], columns: tuple[str, ...]) -> DataFrame:
    """What each column gained from the first snapshot of a key to the last."""
    at = F.struct("ts", "event_id")
    return rows.groupBy(*keys).agg(*((F.max_by(c, at) - F.min_by(c, at)).alias(c) for c in columns))


def _shares() -> tuple:
    """Share of ticks that weren't idle or waiting, and of those waiting and in soft interrupts; null without any."""
    total = sum((F.col(c) for c in TICKS[1:]), F.col(TICKS[0]))
    of = lambda x: F.when(total > 0, F.round(x / total, 6))
    return of(total - F.col("idle") - F.col("iowait")), of(F.col("iowait")), of(F.col("softirq"))


def host_metrics(snapshots: DataFrame) -> DataFrame:
    """Net change and rates, peaks, IO and shares of each run; CPU and IO are at least what each process gained.

    A row is a process in a snapshot, with the host's tx_bytes, rx_bytes and ``TICKS`` at the
    time, and the process's cpu_ticks, fds, rss, read_bytes and write_bytes.
    """
    gains = ("cpu_ticks", "read_bytes", "write_bytes")
    each = snapshots.groupBy("run", "pid").agg(*((F.max(c) - F.min(c)).alias(c) for c in gains))
    processes = each.groupBy("run").agg(*(F.sum(c).alias(n) for c, n in zip(gains, ("cpu_lower_bound", "read_delta", "write_delta"), strict=True)))
    peaks = snapshots.groupBy("run").agg(F.max("fds").alias("peak_fds"), F.max("rss").alias("peak_rss"), (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))).alias("us"))
    net = _changes(snapshots, ["run"], ("tx_bytes", "rx_bytes", *TICKS))
    busy, waiting, _ = _shares()
    gbps = lambda c: F.when(F.col("us") > 0, F.round(F.col(c) * 8 / F.col("us") / 1000, 9))
    rows = net.join(peaks, "run").join(processes, "run")
    return rows.select("run", F.col("tx_bytes").alias("tx_delta"), F.col("rx_bytes").alias("rx_delta"), gbps("tx_bytes").alias("tx_gbps"), gbps("rx_bytes").alias("rx_gbps"), "cpu_lower_bound", "peak_fds", "peak_rss", "read_delta", "write_delta", busy.alias("busy_fraction"), waiting.alias("iowait_fraction"))


def cpu_delta(snapshots: DataFrame) -> DataFrame:
    """Busy and soft-interrupt share of each CPU between a run's first snapshot and its last, ranked; CPUs without a tick are left out."""
    busy, _, soft = _shares()
    rows = _changes(snapshots, ["run", "cpu"], TICKS).select("run", "cpu", busy.alias("busy_fraction"), soft.alias("softirq_fraction")).where("busy_fraction IS NOT NULL")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("busy_fraction"), "cpu")))


def blocked(threads: DataFrame) -> DataFrame:
    """Observations of each wait channel, and the share of them asleep or in a disk wait."""
    asleep = F.count_if(F.col("state").isin("S", "D"))
    return threads.groupBy("run", "wchan").agg(F.count(F.lit(1)).alias("count"), F.round(asleep / F.count(F.lit(1)), 6).alias("blocked_fraction"))
