"""Post batches: JSON arrays of posts, one file per batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscribe.schema import POST_SCHEMA
from tallyscribe.sources.storage import cut_lineage

BATCH_FILES = "*_tweets.json"


def read_posts(
    spark: SparkSession,
    path: str,
    schema: T.StructType = POST_SCHEMA,
    pattern: str = BATCH_FILES,
    multi_line: bool = True,
) -> DataFrame:
    """Read every batch whose file name matches, with ids as text.

    The schema is declared, so no file is read twice, nested values that no one uses are never
    decoded, and a column missing from one batch is NULL there. A JSON array spans lines and cannot
    be split: one file is one task. Pass ``multi_line=False`` for one object per line, which splits, and
    use ``read_post_arrays`` for arrays that are too large for a task.
    """
    return (
        spark.read.schema(schema)
        .option("multiLine", multi_line)
        .option("pathGlobFilter", pattern)
        .json(path)
    )


def _count(text: Column, letter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(letter)))


def read_post_arrays(
    spark: SparkSession, path: str, schema: T.StructType = POST_SCHEMA, pattern: str = BATCH_FILES
) -> DataFrame:
    """The rows of ``read_posts`` for arrays of any size, each file read by as many tasks as it has blocks.

    A file is read as pieces that end at a closing brace. Whether a piece begins inside a string, how deep in braces it
    ends and which record it belongs to follow from the pieces before it: each block sums up its own, and sums over the
    blocks of a file carry them on. The pieces of a record are put together and parsed by ``schema``. Braces and quotes
    in strings are text; a record that does not fit the schema has NULLs; what has no closing brace is no record. Nested
    values that the schema takes as text are written without spaces. A record is put together in one task.
    """
    pieces = spark.read.option("lineSep", "}").option("pathGlobFilter", pattern).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # no escaped quotes
    strings = r'"[^"]*("|$)'
    outside = F.regexp_replace(plain, strings, "")
    inside = F.regexp_replace(F.regexp_replace(plain, r'^[^"]*("|$)', ""), strings, "")
    block = ["file", "block"]
    so_far = Window.partitionBy(*block).orderBy("place")
    before = F.col("quotes_to") - F.col("quotes")
    pieces = pieces.select("*", _count(plain, '"').alias("quotes"), _count(outside, "{").alias("open0"), _count(inside, "{").alias("open1"))
    pieces = pieces.withColumn("quotes_to", F.sum("quotes").over(so_far))
    for start in (0, 1):  # the change of depth if the block begins outside or inside a string
        opened = F.when((before + start) % 2 == 0, F.col("open0")).otherwise(F.col("open1"))
        pieces = pieces.withColumn(f"step{start}", opened - F.when((F.col("quotes_to") + start) % 2 == 0, 1).otherwise(0))
    pieces = cut_lineage(pieces.select(*block, "place", "value", "quotes", "quotes_to", "step0", "step1"), "pieces")

    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = pieces.groupBy(*block).agg(*[F.sum(c).alias(c) for c in ("quotes", "step0", "step1")])
    blocks = blocks.withColumn("start", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    blocks = blocks.withColumn("step", F.when(F.col("start") == 0, F.col("step0")).otherwise(F.col("step1")))
    blocks = blocks.select(*block, "start", F.coalesce(F.sum("step").over(earlier), F.lit(0)).alias("depth"))
    step = F.when(F.col("start") == 0, F.col("step0")).otherwise(F.col("step1"))
    known = pieces.join(blocks, block).withColumn("depth_to", F.col("depth") + F.sum(step).over(so_far))
    ends = (F.col("depth_to") == 0) & ((F.col("quotes_to") + F.col("start")) % 2 == 0)
    known = known.select(*block, "place", "value", ends.cast("int").alias("ends"))
    known = known.withColumn("ends_to", F.sum("ends").over(so_far))

    offsets = known.groupBy(*block).agg(F.sum("ends").alias("ends"))
    offsets = offsets.select(*block, F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("records"))
    whole = (
        known.join(offsets, block)
        .groupBy("file", (F.col("records") + F.col("ends_to") - F.col("ends")).alias("record"))
        .agg(F.max("ends").alias("ends"), F.sort_array(F.collect_list(F.struct("block", "place", "value"))).alias("pieces"))
        .where("ends = 1")
    )
    text = F.concat(F.array_join("pieces.value", "}"), F.lit("}"))
    return whole.select(F.from_json(F.regexp_replace(text, r"^[\s,\[\uFEFF]+", ""), schema).alias("post")).select("post.*")


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Lift struct fields to top-level columns with dotted names."""

    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for f in schema.fields:
            here = path + (f.name,)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, here)
            else:
                yield here

    cols = []
    for path in leaves(df.schema, ()):
        source = df[f"`{path[0]}`"]
        for part in path[1:]:
            source = source.getField(part)
        cols.append(source.alias(separator.join(path)))
    return df.select(cols)


def append_batches(batches: list[DataFrame]) -> DataFrame:
    """Stack batches by column name; a column one batch lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)
