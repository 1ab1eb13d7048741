"""Exact duplicates by block naming.

A text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and numbered; then the numbers of
adjacent blocks are paired, the distinct pairs sorted and numbered, and so on until a text is down to one number. Two
texts have the same number in the same round exactly if they are identical: numbers stand for sorted contents, so no
hash decides. Length and a 64-bit fingerprint only keep texts out of the naming that cannot have an equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscribe.llm.frames import pick
from tallyscribe.sources.storage import cut_lineage

BLOCK_BYTES = 4096


def _fingerprint() -> list:
    return [F.octet_length("text").alias("n_bytes"), F.xxhash64("text").alias("fp")]


def _numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The distinct values of ``keys``, sorted within each part of a split by hash, with an integer name.

    Equal values meet in one part, so part and place in it are a name that no other value has; no range has to be sampled
    on the driver for that. The names are stored so that a retry can't renumber them.
    """
    named = rows.select(*keys).distinct().sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())
    return cut_lineage(named, name)


def block_names(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(key, round, name, copies)`` of ``(key, text)``: rows of one key hold one text; equal (round, name), equal text."""
    raw = F.col("text").cast("binary")
    n_blocks = F.greatest(F.ceil(F.octet_length("text") / F.lit(block_bytes)), F.lit(1)).cast("int")
    cut = (
        rows.select("key", raw.alias("raw"), n_blocks.alias("blocks"))
        .select("key", "raw", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("pos"))
        .select("key", "blocks", "pos", F.substring("raw", F.col("pos") * block_bytes + 1, F.lit(block_bytes)).alias("block"))
    )
    cut = cut_lineage(cut, "op4-blocks")
    longest = cut.agg(F.max("blocks")).first()[0] or 0
    level = (
        cut.join(_numbered(cut, ["block"], "op4-names"), "block")
        .groupBy("key", "blocks", "pos")
        .agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("copies"))
    )
    done, turn = [], 0
    while True:
        if longest > 1:
            level = cut_lineage(level, "op4-level")
        done.append(level.where(F.col("blocks") == 1).select("key", F.lit(turn).alias("round"), "name", "copies"))
        if longest <= 1:
            break
        left, right = (F.max(F.when(F.col("pos") % 2 == side, F.col("name"))) for side in (0, 1))
        pairs = (
            level.where(F.col("blocks") > 1)
            .groupBy("key", "blocks", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(left.alias("a"), F.coalesce(right, F.lit(-1)).alias("b"), F.max("copies").alias("copies"))
        )
        level = pairs.join(_numbered(pairs, ["a", "b"], "op4-names"), ["a", "b"]).select(
            "key", F.ceil(F.col("blocks") / 2).cast("int").alias("blocks"), "pos", "name", "copies"
        )
        longest, turn = (longest + 1) // 2, turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays (``keep_id``). Null text counts as empty; all empty texts are equal.
    Null ids are smaller than any other; a group of null ids only has a null ``keep_id`` and its rows stay. Repeated
    rows (same id, same text) count in ``group_size`` one by one and stay or go together. An empty table gives no rows;
    other columns are ignored.
    """
    base = pick(docs, id_col, text_col)
    prints = base.select("doc_id", *_fingerprint())
    shared = prints.groupBy("n_bytes", "fp").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    key = F.struct("doc_id", "n_bytes", "fp").alias("key")
    rivals = base.select("*", *_fingerprint()).join(shared, ["n_bytes", "fp"], "left_semi").select(key, "text")
    names = cut_lineage(block_names(rivals, block_bytes), "op4-identity")
    groups = names.groupBy("round", "name").agg(F.max("key.doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    verdict = names.join(groups, ["round", "name"]).select("key", "keep_id", "group_size")
    sha = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    rows = base.select("doc_id", *_fingerprint(), sha).select("doc_id", key, "text_sha256")
    named = rows.join(verdict, "key", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return named.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns."""
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.struct("doc_id", "text_sha256").alias("_key")).distinct()
    sha = F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary"), 256)
    tagged = docs.withColumn("_key", F.struct(F.col(f"`{id_col}`").alias("doc_id"), sha.alias("text_sha256")))
    return tagged.join(kept, "_key", "left_semi").drop("_key")
