"""Tokens and the long document-feature table ``(doc_id, term, n)``.

Terms follow Zipf's law: a few own most rows. Every join on ``term`` therefore goes through
``join_term_stats``, which salts exactly the terms that are too heavy for one partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscribe.functions.stemming import stem_series
from tallyscribe.functions.text import (
    DROPPED_FEATURES,
    STOP_WORDS,
    remove_mentions,
    remove_tags,
    remove_urls,
    repair_encoding,
    split_stops,
    token_array,
)
from tallyscribe.operators.skew import fact_tasks, join_term_stats, text_tasks
from tallyscribe.sources.storage import cut_lineage, drop_stage, load_stage, new_path, save_stage


# Cleaning steps in order. Each is its own projection: nested into one expression, the text would be
# written out again for every guard.
CLEANING = (remove_mentions, remove_tags, repair_encoding, remove_urls, split_stops)


def with_clean_text(df: DataFrame, text: str = "text") -> DataFrame:
    for step in CLEANING:
        df = df.withColumn(text, step(F.col(text)))
    return df


def corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts hash-partitioned by document.

    Moving the raw text once costs less than moving ``(document, term, count)`` rows, and every later
    grouping by document, or by document and term, finds its rows in place without a shuffle. There are as many
    parts as keep the counts of one in memory, so their number grows with the texts and not their size.
    """
    texts = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return texts.repartition(text_tasks(texts), "doc_id")


def tokenize(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per token: ``(doc_id, pos, token)``."""
    return df.select(F.col(doc_id).alias("doc_id"), F.posexplode(token_array(F.col(text))).alias("pos", "token"))


def is_content_word(token: str = "token", stop_words: Sequence[str] = STOP_WORDS, min_len: int = 2):
    return ~F.col(token).isin(*stop_words) & (F.length(token) >= min_len)


def remove_stopwords(
    tokens: DataFrame, stop_words: Sequence[str] = STOP_WORDS, min_len: int = 2, token: str = "token"
) -> DataFrame:
    """Drop stop words and short tokens: a set lookup in the scan stage, no join."""
    return tokens.where(is_content_word(token, stop_words, min_len))


def dfm(tokens: DataFrame) -> DataFrame:
    """Counts per document and term. No shuffle if the tokens come from a ``corpus``."""
    return tokens.groupBy("doc_id", F.col("token").alias("term")).agg(F.count(F.lit(1)).alias("n"))


def stem_map(terms: DataFrame, term: str = "term") -> DataFrame:
    """``(term, stem)`` of the distinct terms: the Python stemmer sees each word once."""
    stem = F.pandas_udf(stem_series, "string")
    return terms.select(term).distinct().withColumn("stem", stem(F.col(term)))


def stem_tokens(counts: DataFrame) -> DataFrame:
    """Document-feature counts with terms replaced by stems."""
    heavy = counts.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    stem = F.pandas_udf(stem_series, "string")
    stems = heavy.select("term", "_df", stem(F.col("term")).alias("stem"))
    joined = join_term_stats(counts, stems, "term", "_df", spread=["doc_id"])
    return joined.groupBy("doc_id", F.col("stem").alias("term")).agg(F.sum("n").alias("n"))


def term_stats(counts: DataFrame) -> DataFrame:
    """Total and document frequency of each term."""
    return counts.groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))


def dfm_trim(counts: DataFrame, min_termfreq: int = 1, min_docfreq: int = 1, ids: DataFrame | None = None) -> DataFrame:
    """Keep terms that are frequent enough overall and in enough documents.

    The counts are written to the shared folder first: the statistics of the terms and the join to them both start there,
    so texts are not taken apart once for each. With ``ids`` only the documents listed there come out, with terms judged by all
    documents; their rows are told apart where the counts of a ``corpus`` lie, and the others are never joined.
    """
    columns = counts.columns
    if ids is not None:
        listed = ids.select("doc_id").distinct().withColumn("_listed", F.lit(True))
        counts = counts.join(listed.hint("shuffle_hash"), "doc_id", "left")
    counts = cut_lineage(counts, "counts")
    # Stored too: the join reads them three times.
    kept = cut_lineage(term_stats(counts).where((F.col("tf") >= min_termfreq) & (F.col("df") >= min_docfreq)), "terms")
    rows = counts if ids is None else counts.where("_listed")
    return join_term_stats(rows, kept, "term", "df", spread=["doc_id"], tasks=fact_tasks(rows)).select(columns)


def dfm_drop(counts: DataFrame, terms: Sequence[str] = DROPPED_FEATURES) -> DataFrame:
    return counts.where(~F.col("term").isin(*terms))


def dfm_tfidf(counts: DataFrame, n_docs: DataFrame, digits: int = 2) -> DataFrame:
    """count x log10(N / document frequency), rounded half to even.

    ``n_docs`` is a one-cell frame: N counts all documents, also those left without a term. ``counts`` should be a stored table.
    """
    stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    joined = join_term_stats(counts, stats, "term", "df", spread=["doc_id"], tasks=fact_tasks(counts))
    weight = F.col("n") * F.log10(n_docs.scalar().cast("double") / F.col("df"))
    return joined.select("doc_id", "term", F.bround(weight, digits).alias("weight"))


def dfm_docs(counts: DataFrame, ids: DataFrame) -> DataFrame:
    """Keep the documents listed in ``ids``."""
    return counts.join(ids.select("doc_id"), "doc_id", "left_semi")


def vocabulary(counts: DataFrame) -> DataFrame:
    """``(term, df)`` of a document-feature table."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def dfm_match(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Keep the features of another table; features missing here are implicit zeros.

    ``vocab`` is ``(term, df)``; its document frequencies only steer the salting.
    """
    return join_term_stats(counts, vocab.select("term", "df"), "term", "df", spread=["doc_id"]).select(counts.columns)


def feature_variants(docs: DataFrame, text: str = "text") -> DataFrame:
    """All tokens, without stop words, stemmed, and tf-idf: ``(variant, doc_id, term, weight)``.

    Texts are tokenized once. Stop-word removal and tf-idf only look at the term, so the counts, the
    first, second and fourth variant, and the stems all come from one join to one term table. The
    joined rows are written to the shared folder, as every variant starts from them, and the counts are dropped then.
    """
    spark = docs.sparkSession
    path = save_stage(dfm(tokenize(corpus(docs, text=text))), new_path(spark, "counts"))
    counts = load_stage(spark, path)
    stem = F.pandas_udf(stem_series, "string")
    terms = cut_lineage(term_stats(counts).withColumn("stem", stem("term")), "terms")
    rows = join_term_stats(counts, terms, "term", "df", spread=["doc_id"], tasks=fact_tasks(counts))
    frequent = (F.col("tf") >= 2) & (F.col("df") >= 2) & ~F.col("term").isin(*DROPPED_FEATURES)
    rows = rows.select("doc_id", "term", "stem", "n", "df", frequent.alias("frequent"), is_content_word("term").alias("content"))
    rows = cut_lineage(rows.where("frequent OR content"), "rows")
    drop_stage(spark, path)
    n_docs = docs.agg(F.count(F.lit(1))).scalar().cast("double")
    n = F.col("n").cast("double")

    def cell(name: str, weight):
        return F.struct(F.lit(name).alias("variant"), weight.alias("weight"))

    plain = F.array(cell("all", n))
    content = F.array(cell("nostop", n), cell("tfidf", F.bround(n * F.log10(n_docs / F.col("df")), 2)))
    empty = F.array().cast("array<struct<variant:string,weight:double>>")
    cells = F.explode(F.concat(plain, F.when(F.col("content"), content).otherwise(empty))).alias("c")
    unstemmed = rows.where("frequent").select("doc_id", "term", cells).select("c.variant", "doc_id", "term", "c.weight")
    stems = rows.where("content").groupBy("doc_id", F.col("stem").alias("term")).agg(F.sum("n").alias("n"))
    stemmed = dfm_trim(stems, 2, 2)
    return unstemmed.unionByName(stemmed.select(F.lit("stem").alias("variant"), "doc_id", "term", F.col("n").cast("double").alias("weight")))
