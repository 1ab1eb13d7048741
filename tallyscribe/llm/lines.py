"""Line deduplication: explode the keys of normalised lines, count distinct documents per key, drop, reassemble."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscribe.llm.frames import LOWER, UPPER, WS, pick, slices

MIN_CHARS = 10
MIN_DOCS = 2
_BLANK = WS.encode()
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """Per line the 128-bit hash of the stripped line with A-Z lower-cased; None if it is shorter than ``min_chars``.

    Lines are cut, stripped and folded as UTF-8: no byte of a longer character is below 0x80. Only lines that have enough bytes
    and may still lack characters are counted.
    """
    out = []
    for line in text.translate(_FOLD).split(b"\n"):
        line = line.strip(_BLANK)
        long = len(line) >= 4 * min_chars or (len(line) >= min_chars and (line.isascii() or len(line.decode()) >= min_chars))
        out.append(blake2b(line, digest_size=16).digest() if long else None)
    return out


def _bytes(part: pa.RecordBatch) -> list[bytes]:
    return part.column("text").cast(pa.binary()).to_pylist()


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, keys = [], []
            for i, text in enumerate(_bytes(part)):
                found = set(line_keys(text, min_chars))
                found.discard(None)
                keys += found
                ids += [i] * len(found)
            key = part.column("key").take(pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), key], ["line", "key"])

    return run


def _rebuild(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n, gone, out = [], [], []
            for text, drop in zip(_bytes(part), part.column("drop").to_pylist(), strict=True):
                lines, dropped = text.count(b"\n") + 1, 0
                if drop:
                    bad = set(drop)
                    kept = [x for x, key in zip(text.split(b"\n"), line_keys(text, min_chars), strict=True) if key not in bad]
                    dropped, text = lines - len(kept), b"\n".join(kept)
                n.append(lines)
                gone.append(dropped)
                out.append(text)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_text"],
            )

    return run


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_dropped, kept_text``.

    Lines end at ``\\n``. A line whose key (stripped, A-Z lower-cased) has at least ``min_chars`` code points and occurs
    in ``min_docs`` documents or more goes, but for those in the document with the smallest id that holds it. All other
    lines stay in place. Null and empty text are one empty line. Rows that share an id are one document when counting,
    and each gets its own result; a null id is smaller than all others. An empty table gives no rows.

    Keys are 128-bit hashes and occur once per document, so counting moves 16 bytes and an id per line, summed before
    the shuffle; a key that a third of all documents hold is one sum per task. Texts move once, by document.
    """
    rows = pick(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    keyed = rows.select(F.struct("doc_id").alias("key"), "text")
    lines = keyed.mapInArrow(_keys(min_chars), f"line binary, key struct<doc_id:{id_type}>")
    if min_docs == 2:  # two different documents hold it: the smallest and the largest id differ
        shared = lines.groupBy("line").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first <> last")
    else:
        once = lines.distinct().groupBy("line").agg(F.count(F.lit(1)).alias("docs"), F.min("key").alias("first"))
        shared = once.where(F.col("docs") >= min_docs)
    drops = (
        lines.join(shared.select("line", "first"), "line")
        .where("key <> first")
        .groupBy("key")
        .agg(F.collect_set("line").alias("drop"))
    )
    work = rows.select("doc_id", F.struct("doc_id").alias("key"), "text").join(drops, "key", "left").drop("key")
    out = f"doc_id {id_type}, n_lines bigint, n_dropped bigint, kept_text string"
    return work.mapInArrow(_rebuild(min_chars), out)
