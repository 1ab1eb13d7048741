"""CSV in and out, the event calendar, and external daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALENDAR_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("incident", T.StringType()),
        T.StructField("category", T.StringType()),
    ]
)
DAILY_SCHEMA = T.StructType([T.StructField("date", T.DateType()), T.StructField("pagecount", T.LongType())])


def read_csv_ids(
    spark: SparkSession, path: str, schema: T.StructType, null_value: str = "NA", multi_line: bool = True
) -> DataFrame:
    """Read CSV with a declared schema, so ids stay text and keep every digit.

    Texts may hold line breaks, which makes a file one task; pass ``multi_line=False`` when they do not.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("nullValue", null_value)
        .csv(path)
    )


def write_csv(df: DataFrame, path: str, null_value: str = "NA") -> str:
    """Write quoted CSV with a header."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("nullValue", null_value)
        .csv(path)
    )
    return path


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Incidents: one row per (date, incident)."""
    return read_csv_ids(spark, path, CALENDAR_SCHEMA, multi_line=False)


def read_daily_series(spark: SparkSession, path: str) -> DataFrame:
    """An external count per day."""
    return read_csv_ids(spark, path, DAILY_SCHEMA, multi_line=False)


def pseudonym(key: Column, salt: str) -> Column:
    """Salted hash in place of a personal rater key such as an e-mail address."""
    return F.sha2(F.concat(F.lit(salt), F.lower(F.trim(key))), 256)
