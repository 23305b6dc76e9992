"""Session helpers of the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftledger.functions.workers import shared_folder as folder, ship, stored

__all__ = ["bit_table", "folder", "in_table", "prepare", "small", "stored"]

#: Rows and bytes of one Arrow batch; documents may be long, so batches stay small.
ARROW_ROWS, ARROW_BYTES = 1000, 32 << 20
#: Bits of a table of hashes; fixed, so its size is too (4 MB).
TABLE_BITS = 1 << 25
#: Rows of a few columns that may be broadcast.
SMALL_ROWS = 100_000


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers and bound the session's Arrow batches by rows and bytes, unless bounded closer."""
    ship(spark)
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def small(df: DataFrame) -> DataFrame:
    """``df`` stored, and to be broadcast if it has at most ``SMALL_ROWS`` rows; else Spark chooses the join."""
    df = stored(df, "side")
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def bit_table(hashes: DataFrame) -> Broadcast:
    """A table of ``TABLE_BITS`` bits with that of each hash (the only column, long) set, sent to the tasks.

    The driver gets a row for each 32 bits at most.  Where the table fills up it
    tells fewer apart; what passes must be checked.
    """
    slot = F.col(hashes.columns[0]).bitwiseAND(F.lit(TABLE_BITS - 1))
    words = hashes.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 31 as int)))").alias("bits"))
    table = np.zeros(TABLE_BITS // 32, "<u4")
    for row in words.toLocalIterator():
        table[row["word"]] = row["bits"]
    return hashes.sparkSession.sparkContext.broadcast(table.view(np.uint8))


def in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each unsigned hash is set."""
    slots = hashes & np.uint64(TABLE_BITS - 1)
    return (table[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
