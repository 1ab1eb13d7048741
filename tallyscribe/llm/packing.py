"""Packing: concatenate all documents and cut every ``window`` tokens.

Pass one encodes, stores the ids, and keeps the running count of tokens inside each partition. Prefix sums over the
partitions' totals give global offsets. Pass two cuts each document where a window ends and writes a boundary record
per piece. No document moves between tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyscribe.llm.frames import pick, slices
from tallyscribe.llm.tokenizing import encoder
from tallyscribe.sources.storage import cut_lineage

WINDOW = 4096


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before = encoder(path), TaskContext.get().partitionId(), 0
        kind = np.dtype("<u2" if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        tail = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            ids, n, at = [], [], []
            for text in batch.column("text").to_pylist():
                raw = np.frombuffer(enc.encode(text) + tail, "<u4")
                ids.append(raw.astype(kind).tobytes())
                n.append(len(raw))
                at.append(before)
                before += len(raw)
            size = len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([part] * size, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array([kind.itemsize] * size, pa.int32()), pa.array(ids, pa.binary())],
                ["doc_id", "part", "before", "n", "width", "ids"],
            )

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            row, start, length, crc, parts, at = [], [], [], [], [], []
            for i, (raw, width, first) in enumerate(zip(batch.column("ids"), batch.column("width").to_pylist(), batch.column("first").to_pylist(), strict=True)):
                ids = np.frombuffer(raw.as_buffer(), f"<u{width}").astype("<u4")
                cuts = [0, *range(window - first % window, len(ids), window), len(ids)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    piece = ids[a:b].tobytes()
                    row.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(piece))
                    parts.append(piece)
                    at.append(first + a)
            spot = np.array(at, np.int64)
            pick_row = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pick_row), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), batch.column("n").take(pick_row), pa.array(spot // window), pa.array(spot % window), pa.array(parts, pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Boundary records, one per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    ``ids`` are little-endian unsigned 32-bit integers. Documents follow each other in the order of the input's
    partitions; every sequence but the last is full. Null and empty text are ``end_id`` alone, so every row has a piece;
    rows are packed one by one, whatever their ids (null and repeated ones too). An empty table gives no rows.
    """
    rows = pick(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    stored = cut_lineage(
        rows.mapInArrow(_encode(tokenizer_path, end_id), f"doc_id {id_type}, part int, before bigint, n bigint, width int, ids binary"),
        "packing-ids",
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy("part").agg(F.sum("n").alias("_total"))
    offsets = totals.select("part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_first"))
    # One row per input partition, so its size has nothing to do with the rows.
    placed = stored.join(F.broadcast(offsets), "part").select("doc_id", "n", "width", "ids", (F.col("_first") + F.col("before")).alias("first"))
    return placed.mapInArrow(
        _cut(window),
        f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary",
    )


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """``sequence_id, n_tokens, ids``: the pieces of each window joined, padded to ``window`` unless its length is a power of two."""
    joined = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_p"), F.sum("length").alias("n_tokens"))
    ids = F.aggregate("_p", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), (F.lit(window) - F.col("n_tokens")).cast("int")))
    whole = F.bit_count("n_tokens") == 1
    return joined.select("sequence_id", "n_tokens", F.when(whole, ids).otherwise(F.concat(ids, pad)).alias("ids"))
