"""Token files of directly addressable codes.

An id is split into chunks of ``CHUNK_BITS`` bits. Level k holds the k-th chunk of every id that has one, a bitmap says
for each entry whether the id goes on, and a rank directory counts the ones before every ``RANK_BLOCK`` bits. The ids
``[a, b)`` of level 0 continue at ``[rank(a), rank(b))`` of level 1, and so on: any token or range of tokens is read
from a few short stretches of the file, and no block is decoded.

File: header (``HEADER``), entries per level (int64), document ids (int64), first token of each document and the end
(int64), then per level: chunks, bitmap, directory (int64), each padded to 8 bytes. All little-endian.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyscribe.llm.frames import pick, slices
from tallyscribe.llm.tokenizing import encoder
from tallyscribe.sources.storage import cut_lineage, new_path

CHUNK_BITS = 8
RANK_BLOCK = 512
MAGIC = b"DACTOK01"
HEADER = struct.Struct("<8sIIqq")  # magic, bits of a chunk, levels, tokens, documents
NO_ID = -(1 << 63)  # stands for a null document id

#: A file is closed once it has so many tokens; a longer document has a file of its own.
FILE_TOKENS = 4_000_000


def _padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


def write_codes(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray) -> bytes:
    """One file: ``ids`` (uint32) of all documents, and where each document starts (with the end)."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunk, more = rest & ((1 << CHUNK_BITS) - 1), rest >> CHUNK_BITS
        goes_on = more > 0
        block = np.add.reduceat(goes_on, np.arange(0, len(goes_on), RANK_BLOCK), dtype=np.int64) if len(goes_on) else np.zeros(0, np.int64)
        levels.append((chunk.astype(np.uint8), np.packbits(goes_on, bitorder="little"), np.concatenate([[0], np.cumsum(block)]).astype("<i8")))
        rest = more[goes_on]
        if not len(rest):
            break
    out = [HEADER.pack(MAGIC, CHUNK_BITS, len(levels), len(ids), len(doc_ids)), np.array([len(x[0]) for x in levels], "<i8").tobytes()]
    out += [np.asarray(doc_ids, "<i8").tobytes(), np.asarray(starts, "<i8").tobytes()]
    return b"".join(out + [_padded(part.tobytes()) for level in levels for part in level])


class TokenFile:
    """Random access to one file; ``read(offset, n)`` gives bytes of it."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        magic, bits, n_levels, self.n_tokens, self.n_docs = HEADER.unpack(read(0, HEADER.size))
        if magic != MAGIC or bits != CHUNK_BITS:
            raise ValueError("not a token file of this format")
        at = HEADER.size
        sizes = np.frombuffer(read(at, 8 * n_levels), "<i8")
        self.ids_at = at + 8 * n_levels
        at = self.ids_at + 8 * self.n_docs + 8 * (self.n_docs + 1)
        self.levels = []
        for n in map(int, sizes):
            chunks, bits_at = at, at + n + -n % 8
            ranks = bits_at + (b := -(-n // 8)) + -b % 8
            at = ranks + 8 * (1 + -(-n // RANK_BLOCK))
            self.levels.append((chunks, bits_at, ranks))

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        raw = self.read(self.ids_at, 8 * (2 * self.n_docs + 1))
        both = np.frombuffer(raw, "<i8")
        return both[: self.n_docs], both[self.n_docs :]

    def _rank(self, level: int, i: int) -> int:
        """Ones before entry ``i`` of a level: one directory entry and less than a block of the bitmap."""
        _, bits_at, ranks = self.levels[level]
        block = i // RANK_BLOCK
        ones = int(np.frombuffer(self.read(ranks + 8 * block, 8), "<i8")[0])
        if i % RANK_BLOCK:
            raw = np.frombuffer(self.read(bits_at + block * RANK_BLOCK // 8, -(-(i % RANK_BLOCK) // 8)), np.uint8)
            ones += int(np.unpackbits(raw, bitorder="little")[: i % RANK_BLOCK].sum())
        return ones

    def tokens(self, a: int, b: int, level: int = 0) -> np.ndarray:
        """Ids of tokens ``a`` to ``b - 1`` as uint32."""
        if b <= a:
            return np.zeros(0, np.uint32)
        chunks, bits_at, _ = self.levels[level]
        out = np.frombuffer(self.read(chunks + a, b - a), np.uint8).astype(np.uint32)
        raw = np.frombuffer(self.read(bits_at + a // 8, -(-b // 8) - a // 8), np.uint8)
        goes_on = np.unpackbits(raw, bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
        if goes_on.any():
            first = self._rank(level, a)
            more = self.tokens(first, first + int(goes_on.sum()), level + 1)
            out[goes_on] |= more << CHUNK_BITS
        return out


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a path or URI; ``file:/x`` is read as ``file:///x``."""
    if "://" not in uri and not uri.startswith("file:"):
        uri = f"file://{uri}"
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def _writer(folder: str, path: str, end_id: int | None, file_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, (place, top) = encoder(path), store(folder)
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        part, number = TaskContext.get().partitionId(), 0
        doc_ids, sizes, parts = [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal number
            ids = np.frombuffer(b"".join(parts), "<u4")
            name = f"part-{part:06d}-{number:04d}.dac"
            hidden = f"{top}/_{name}.{uuid.uuid4().hex}"
            with place.open_output_stream(hidden) as out:
                out.write(write_codes(ids, np.array(doc_ids, np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)))
            place.move(hidden, f"{top}/{name}")  # a retried task replaces the file by the same content
            row = pa.RecordBatch.from_pydict(
                {"file": [name], "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "docs": [len(doc_ids)], "tokens": [len(ids)]}
            )
            number += 1
            for x in (doc_ids, sizes, parts):
                x.clear()
            return row

        held = 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = enc.encode(text) + tail
                doc_ids.append(NO_ID if doc_id is None else doc_id)
                sizes.append(len(raw) // 4)
                parts.append(raw)
                held += len(raw) // 4
                if held >= file_tokens:
                    yield flush()
                    held = 0
        if doc_ids:
            yield flush()

    return run


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int | None = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_tokens: int = FILE_TOKENS,
) -> DataFrame:
    """Encode ``docs`` and write token files to ``folder`` in ascending id order; returns the manifest.

    The manifest has a row per file: ``file, part, number, docs, tokens, start`` (tokens in all files before it), and is
    stored. Ids are cast to bigint; null ids come first. Null and empty text give ``end_id`` alone. Rows that share an id
    stand side by side, ordered by a hash of their text. An empty table gives no file and an empty manifest.
    """
    rows = pick(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    place, top = store(folder)
    place.create_dir(top, recursive=True)
    sorted_rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    files = sorted_rows.mapInArrow(
        _writer(folder, tokenizer_path, end_id, file_tokens), "file string, part int, number int, docs bigint, tokens bigint"
    )
    files = cut_lineage(files, "token-files")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, top = store(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with place.open_input_file(f"{top}/{name}") as f:
                    raw = f.read()  # of bounded size; single tokens are read by file offsets with read_at
                file = TokenFile(lambda at, n, raw=raw: raw[at : at + n])
                ids, starts = file.documents()
                crc = [zlib.crc32(file.tokens(int(a), int(b)).astype("<u4").tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(starts[:-1] + start), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files of a manifest."""
    spark = manifest.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = manifest.select("file", "start").repartition(tasks)
    return spread.mapInArrow(_reader(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, **options) -> DataFrame:
    """Write ``docs`` to a new folder of the shared place and read every document back."""
    folder = new_path(docs.sparkSession, "tokens")
    return read_documents(write_tokens(docs, folder, tokenizer_path, end_id, **options), folder)
