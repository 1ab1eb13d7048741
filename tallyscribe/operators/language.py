"""Language identification by n-gram rank profiles (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyscribe.operators.skew import text_tasks

PROFILE_SIZE = 300
MAX_N = 5


def _words(text: str):
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)


def ngram_counts(df: DataFrame, key: str, text: str, max_n: int = MAX_N) -> DataFrame:
    """``(key, ngram, n)`` over whole texts, words padded with ``_``.

    Words are counted first and each distinct word is cut into n-grams once.
    """
    words = df.select(key, F.explode(_words(text)).alias("word"))
    counted = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("w"))
    padded = counted.select(key, "w", F.concat(F.lit("_"), "word", F.lit("_")).alias("p"))
    starts = padded.select(key, "w", "p", F.explode(F.sequence(F.lit(1), F.length("p"))).alias("i"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(max_n), F.length("p") - F.col("i") + 1))
    cuts = starts.select(key, "w", "p", "i", F.explode(sizes).alias("k"))
    grams = cuts.select(key, "w", F.substring("p", F.col("i"), F.col("k")).alias("ngram"))
    return grams.groupBy(key, "ngram").agg(F.sum("w").alias("n"))


def ranked(counts: DataFrame, key: str, size: int) -> DataFrame:
    """The ``size`` most frequent n-grams per key with their ranks.

    The row-number limit is pushed below the shuffle, so a language with very many n-grams sends
    at most ``size`` of them per partition.
    """
    order = Window.partitionBy(key).orderBy(F.desc("n"), "ngram")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select(key, "ngram", "rank")


def language_profiles(df: DataFrame, lang: str = "lang", text: str = "text", size: int = PROFILE_SIZE) -> DataFrame:
    """``(lang, ngram, rank)`` learned from texts of known language."""
    return ranked(ngram_counts(df, lang, text), lang, size)


def frequent_ngrams(words: Sequence[str], size: int, max_n: int = MAX_N) -> list[str]:
    """The ``size`` most frequent n-grams of one text's padded words, of equally frequent ones the first in code-point order."""
    counts = Counter(words)
    padded = "".join(f"_{w}_" for w in counts)
    length = np.array([len(w) + 2 for w in counts])
    weight = np.repeat(np.array(list(counts.values())), length)
    room = np.repeat(np.cumsum(length), length) - np.arange(len(padded))
    letters, code = np.unique(np.frombuffer(padded.encode("utf-32-le"), np.uint32), return_inverse=True)
    at = [np.flatnonzero(room >= k) for k in range(1, max_n + 1)]
    start, n = np.concatenate(at), np.repeat(np.arange(1, max_n + 1), [len(x) for x in at])
    # One number per n-gram, in the order of the strings: a letter is a digit from 1 on, and 0 is behind the end.
    base, key, below = len(letters) + 1, np.zeros(len(start), np.int64), 1
    code = np.append(code + 1, np.zeros(max_n, np.int64))
    for k in range(max_n):
        if below * base >= 1 << 62:
            found, key = np.unique(key, return_inverse=True)
            below = len(found)
        key = key * base + np.where(n > k, code[start + k], 0)
        below *= base
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    total = np.add.reduceat(weight[start][order], first)
    best = order[first[np.argsort(-total, kind="stable")[:size]]]
    return [padded[a : a + k] for a, k in zip(start[best].tolist(), n[best].tolist(), strict=True)]


def _nearest(ranks: dict[str, list[int | None]], languages: Sequence[str], size: int):
    """``(doc_id, detected_lang, distance)`` of texts given as their words; a text without words has neither."""
    place = {g: i for i, g in enumerate(ranks)}
    rank_of = np.array([[np.nan if r is None else r for r in x] for x in ranks.values()] + [[np.nan] * len(languages)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, least = [], []
            for text in batch.column("words").to_pylist():
                grams = frequent_ngrams(text.split(), size) if text and not text.isspace() else []
                rows = rank_of[[place.get(g, -1) for g in grams]]
                miss = np.abs(np.arange(1, len(grams) + 1)[:, None] - rows)
                far = np.where(np.isnan(miss), size, miss).sum(axis=0)
                best = min(zip(far.tolist(), languages, strict=True)) if grams else (None, None)
                found.append(best[1])
                least.append(best[0] if best[0] is None else int(best[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(least, pa.int64())], ["doc_id", "detected_lang", "distance"])

    return run


def identify_language(
    df: DataFrame,
    profiles: DataFrame,
    languages: Sequence[str],
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = PROFILE_SIZE,
    lang: str = "lang",
) -> DataFrame:
    """``(doc_id, detected_lang, distance)``: the language with the smallest out-of-place distance.

    Every document of ``df`` is in the answer; both values are NULL for a text without letters and for a null id. Rows that
    share an id are one text. Texts are hash-partitioned by document once; a document's n-grams are counted, ranked and
    scored while it passes, and never become rows. The profiles are read now: at most ``size`` rows per listed language.
    """
    known = (
        profiles.where(F.col(lang).isin(*languages) & (F.col("rank") <= size))
        .groupBy("ngram")
        .agg(F.array(*[F.max(F.when(F.col(lang) == k, F.col("rank"))) for k in languages]).alias("ranks"))
    )
    ranks = {r["ngram"]: r["ranks"] for r in known.collect()}
    texts = df.select(F.col(doc_id).alias("doc_id"), F.array_join(_words(text), " ").alias("words"))
    dealt = texts.where("doc_id IS NOT NULL").repartition(text_tasks(df, text), "doc_id")
    whole = dealt.groupBy("doc_id").agg(F.array_join(F.collect_list("words"), " ").alias("words"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    found = whole.mapInArrow(_nearest(ranks, languages, size), f"doc_id {id_type}, detected_lang string, distance bigint")
    return texts.select("doc_id").join(found, "doc_id", "left").withColumnRenamed("doc_id", doc_id)
