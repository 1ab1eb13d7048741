"""Helpers that keep one hot key from becoming one slow task.

* ``rank_by_hash``: exact row number inside each group, where a group may hold a third
  of the table. Rows are ranked inside (group, hash bucket); bucket offsets come from counts.
* ``join_term_stats``: join a fact table to a per-key table when a few keys own most facts.
  Only keys that own more than 1/``hot_parts`` of the facts are salted, so the salt table
  has fewer than ``hot_parts`` rows whatever the data, and may be broadcast.
* ``text_tasks``, ``fact_tasks``: into how many tasks texts or stored facts are dealt, so that a task's share does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyscribe.functions.hashing import SPAN

HASH_BUCKETS = 4096
HOT_PARTS = 1024
#: Bytes of text that one task takes apart: their tokens and counts are some twenty times as many in memory.
TASK_BYTES = 16 << 20


def text_tasks(df: DataFrame, text: str = "text") -> int:
    """How many tasks the texts are dealt to: the session's shuffle partitions, or more if a task had over ``TASK_BYTES`` of them.

    The sizes are summed now, by a pass over the text column.
    """
    size = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


#: Facts that one task sorts for a join: some hundred bytes each.
TASK_FACTS = 1 << 20


def fact_tasks(facts: DataFrame) -> int:
    """How many tasks a join of ``facts`` is dealt to: the session's shuffle partitions, or more if a task had over ``TASK_FACTS`` rows.

    The rows are counted now; of a stored table that is in its files.
    """
    return max(int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-facts.count() // TASK_FACTS))


def rank_by_hash(
    df: DataFrame,
    group: Sequence[str],
    hash_col: str,
    tie: Sequence[str],
    out: str,
    buckets: int = HASH_BUCKETS,
) -> DataFrame:
    """Add ``out``: the 1-based position of the row in its group by (``hash_col``, ``tie``).

    Also adds ``<out>_of``, the size of the group, which the offsets give for free.
    """
    # One struct holds the group: it is never NULL itself, so the window and the join hash alike and
    # the rows move once, and NULL group values still form a group.
    keys = ["_g", "_b"] if group else ["_b"]
    tagged = df.withColumn("_b", F.floor(F.col(hash_col) * F.lit(buckets) / F.lit(SPAN)).cast("int"))
    if group:
        tagged = tagged.withColumn("_g", F.struct(*group))
    sizes = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys[:-1])
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_of")
    )
    inside = Window.partitionBy(*keys).orderBy(hash_col, *tie)
    ranked = tagged.withColumn("_in", F.row_number().over(inside))
    return ranked.join(offsets, keys).select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.col("_before") + F.col("_in")).alias(out),
        F.col("_of").alias(f"{out}_of"),
    )


def join_term_stats(
    facts: DataFrame,
    stats: DataFrame,
    key: str,
    weight: str,
    spread: Sequence[str],
    how: str = "inner",
    hot_parts: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Equi-join ``facts`` to ``stats`` (one row per ``key``) without hot partitions.

    ``weight`` is the column of ``stats`` that counts the facts of a key; ``spread`` is the
    list of fact columns that scatter a hot key over its salts. ``weight`` may undercount: the split
    is then coarser and the result the same. ``hot_parts`` is at least the session's number of shuffle partitions
    and ``tasks``, the number of tasks of the join (``fact_tasks``; by default left to the session).
    """
    if hot_parts is None:
        hot_parts = max(HOT_PARTS, int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks or 0)
    total = stats.agg(F.sum(weight)).scalar()
    part = F.ceil(F.col(weight) * F.lit(hot_parts) / total).cast("int")
    salted = stats.withColumn("_salts", F.greatest(part, F.lit(1)))
    hot = salted.where(F.col("_salts") > 1).select(key, F.col("_salts").alias("_hot"))
    left = facts.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread), F.coalesce("_hot", F.lit(1))).cast("int")
    )
    right = salted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    if tasks:
        left, right = left.repartition(tasks, key, "_salt"), right.repartition(tasks, key, "_salt")
    return left.join(right, [key, "_salt"], how).drop("_salt", "_salts", "_hot")
