"""Reproducible stand-ins for random draws: a 32-bit hash of the key.

``rand()`` and ``randomSplit`` depend on how rows are partitioned, so a retried task
could draw again. A hash of the key gives the same answer on any cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 4294967296  # 2^32

# One odd multiplier per purpose: with a shared one, test rows and fold rows would be correlated.
SPLIT = 2654435761
FOLD = 2246822519
SAMPLE = 3266489917
UPSAMPLE = 668265263
PERMUTE = 374761393


def key_hash(key: Column, purpose: int) -> Column:
    """Hash of an integer key in [0, 2^32). The inner ``pmod`` keeps the product inside 64 bits."""
    return F.pmod(F.pmod(key.cast("bigint"), F.lit(2147483648)) * F.lit(purpose), F.lit(SPAN))


def text_key(key: Column) -> Column:
    """Integer key in [0, 2^32) for a string id."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def row_hash(df: DataFrame, keys: Sequence[str], purpose: int) -> Column:
    """Hash of the key columns in [0, 2^32): of one integer as is, of anything else through its text.

    Several columns are hashed as a tuple, so (1, 11) and (11, 1) or sums that agree do not meet.
    """
    if len(keys) == 1 and df.schema[keys[0]].dataType.typeName() in ("byte", "short", "integer", "long"):
        return key_hash(F.col(keys[0]), purpose)
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return text_key(F.concat_ws("|", *parts, F.lit(str(purpose))))
