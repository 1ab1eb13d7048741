"""Sampling and resampling that any cluster repeats exactly.

Draws are orders by a hash of the key. Positions inside a class or stratum come from
``rank_by_hash``, so one class may hold most of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscribe.functions import hashing
from tallyscribe.operators.skew import rank_by_hash

#: Copies of one row that one task makes in one go.
COPY_CHUNK = 1000


def stratified_sample(df: DataFrame, strata: Sequence[str], frac: float, key: str) -> DataFrame:
    """``round(frac x size)`` rows of every stratum, without replacement."""
    tagged = df.withColumn("_h", hashing.row_hash(df, [key], hashing.SAMPLE))
    ranked = rank_by_hash(tagged, strata, "_h", [key], "_r")
    return ranked.where(F.col("_r") <= F.bround(F.lit(frac) * F.col("_r_of"))).select(df.columns)


def is_train(key: str, p: float = 0.8, df: DataFrame | None = None):
    """True for a share ``p`` of the keys; integer keys unless ``df`` says what they are."""
    draw = hashing.row_hash(df, [key], hashing.SPLIT) if df is not None else hashing.key_hash(F.col(key), hashing.SPLIT)
    return draw < F.lit(int(p * hashing.SPAN))


def train_test_split(df: DataFrame, key: str, p: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(train, test): a filter on the key, no shuffle."""
    return df.where(is_train(key, p, df)), df.where(~is_train(key, p, df))


def upsample(df: DataFrame, label: str, key: str) -> DataFrame:
    """Repeat rows until every class is as large as the largest; adds ``copy_no`` (0 = original).

    Each row gets the whole number of copies that fits, and the rest go to the first rows by hash.
    All originals survive. The copies of a row are made ``COPY_CHUNK`` at a time, dealt over all tasks.
    """
    tagged = df.withColumn("_h", hashing.row_hash(df, [key], hashing.UPSAMPLE))
    largest = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).scalar()
    ranked = rank_by_hash(tagged, [label], "_h", [key], "_r").withColumn("_max", largest)
    whole = F.floor(F.col("_max") / F.col("_r_of"))
    extra = F.when(F.col("_r") <= F.col("_max") - whole * F.col("_r_of"), 1).otherwise(0)
    last = ranked.withColumn("_last", (whole + extra - 1).cast("bigint"))
    chunks = last.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_last") / COPY_CHUNK))))
    first = F.col("_chunk") * COPY_CHUNK
    numbers = F.sequence(first, F.least(first + (COPY_CHUNK - 1), F.col("_last")))
    # A given number of partitions, as their sizes before the copies are made say nothing.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = chunks.repartition(tasks, key, "_chunk").withColumn("_copy", F.explode(numbers))
    return copies.select(*df.columns, F.col("_copy").cast("int").alias("copy_no"))


def assign_folds(df: DataFrame, label: str, key: str | Sequence[str], k: int, group_key: str | None = None) -> DataFrame:
    """Add ``fold`` in 0..k-1, even within each label. ``key`` names the column or columns that tell rows apart.

    With ``group_key`` rows that share it (copies of one document) share a fold.
    """
    if group_key is not None:
        unit = df.groupBy(group_key).agg(F.min(label).alias("_y"))
        unit = unit.withColumn("_h", hashing.row_hash(unit, [group_key], hashing.FOLD))
        folds = rank_by_hash(unit, ["_y"], "_h", [group_key], "_r").select(group_key, ((F.col("_r") - 1) % k).cast("int").alias("fold"))
        return df.join(folds, group_key)
    keys = [key] if isinstance(key, str) else list(key)
    tagged = df.withColumn("_h", hashing.row_hash(df, keys, hashing.FOLD))
    ranked = rank_by_hash(tagged, [label], "_h", keys, "_r")
    return ranked.select(*df.columns, ((F.col("_r") - 1) % k).cast("int").alias("fold"))
