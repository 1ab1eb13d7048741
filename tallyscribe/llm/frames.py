"""Small helpers shared by the operators: inputs without clashes, bounded slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that a task holds unpacked at a time; one longer text makes a slice of its own.
SLICE_BYTES = 4 << 20


def pick(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, null text as empty: other columns can clash with nothing later on."""
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    )


#: Rows of one Arrow batch between Spark and Python for long texts; Spark's own 10,000 are tens of MB in either process.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let the session send at most ``BATCH_ROWS`` rows to Python at a time; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: Rows of a table that a join may send to every task; Spark goes by the size of files, which hold far more rows than the driver.
SENT_ROWS = 1 << 14


def beside(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` as the smaller side of a join: sent to every task if it is known to have few rows, else sorted and merged.

    ``rows`` is at least the number of its rows.
    """
    return F.broadcast(df) if rows is not None and rows <= SENT_ROWS else df.hint("merge")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches where their texts pass ``size`` bytes, so that a task's memory follows the longest text only."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.nan_to_num(n.astype("f8")))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0.0
            to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column one after the other, and where each text starts (one entry more at the end)."""
    col = batch.column(column)
    col = pc.fill_null(col, "").cast(pa.large_string())
    _, offsets, data = col.buffers()
    starts = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]
