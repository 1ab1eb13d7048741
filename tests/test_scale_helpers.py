"""Skew helpers and resampling: hot groups give the plain answer."""

import random
import re
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyscribe.functions import hashing
from tallyscribe.operators import language, sampling, skew, tokens
from tallyscribe.operators.skew import join_term_stats, rank_by_hash
from tallyscribe.sources import storage


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows; one group holds half of them and one key is NULL."""
    rng = random.Random(5)
    rows = [(i, "hot" if i % 2 else rng.choice(["a", "b", None]), rng.choice([0, 1, 1, 1, 1])) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, g string, y int").withColumn("h", hashing.key_hash(F.col("id"), hashing.SAMPLE)).cache()


def test_rank_equals_row_number(skewed):
    plain = F.row_number().over(Window.partitionBy("g").orderBy("h", "id"))
    size = F.count("*").over(Window.partitionBy("g"))
    want = {r.id: (r.r, r.n) for r in skewed.select("id", plain.alias("r"), size.alias("n")).collect()}
    got = {r.id: (r.r, r.r_of) for r in rank_by_hash(skewed, ["g"], "h", ["id"], "r").collect()}
    assert got == want


def test_global_rank_is_dense(skewed):
    got = [r.r for r in rank_by_hash(skewed, [], "h", ["id"], "r", buckets=16).orderBy("r").collect()]
    assert got == list(range(1, 3001))


@pytest.mark.parametrize("hot_parts", [4, 1024])
def test_salted_join_equals_join(skewed, hot_parts):
    stats = skewed.groupBy("g").agg(F.count("*").alias("n"), F.max("id").alias("top")).where(F.col("g").isNotNull())
    got = join_term_stats(skewed, stats, "g", "n", ["id"], hot_parts=hot_parts)
    want = skewed.join(stats, "g")
    cols = ["id", "g", "y", "n", "top"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_salted_join_spreads_the_hot_key(skewed):
    """The hot key must meet several salts: its rows may not share one join key."""
    stats = skewed.groupBy("g").agg(F.count("*").alias("n"))
    total = stats.agg(F.sum("n")).first()[0]
    salts = {r.g: -(-r.n * 16 // total) for r in stats.collect()}
    assert salts["hot"] >= 8
    joined = join_term_stats(skewed, stats, "g", "n", ["id"], hot_parts=16)
    assert joined.where("g = 'hot'").count() == 1500


def test_undercounted_weights_change_nothing(skewed):
    stats = skewed.where(F.col("g").isNotNull()).groupBy("g").agg(F.lit(1).cast("long").alias("n"))
    assert join_term_stats(skewed, stats, "g", "n", ["id"]).count() == skewed.where(F.col("g").isNotNull()).count()


def test_sample_sizes(skewed):
    got = {r.g: r.n for r in sampling.stratified_sample(skewed, ["g"], 0.3, "id").groupBy("g").agg(F.count("*").alias("n")).collect()}
    sizes = {r.g: r.n for r in skewed.groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert got == {g: round(0.3 * n) for g, n in sizes.items()}


def test_split_partitions_the_rows(skewed):
    train, test = sampling.train_test_split(skewed, "id")
    assert train.count() + test.count() == 3000
    assert abs(train.count() / 3000 - 0.8) < 0.03


def test_upsample_balances_and_keeps_originals(skewed):
    up = sampling.upsample(skewed, "y", "id")
    sizes = [r.n for r in up.groupBy("y").agg(F.count("*").alias("n")).collect()]
    assert len(set(sizes)) == 1
    assert up.where("copy_no = 0").count() == 3000
    assert up.groupBy("id", "copy_no").count().where("count > 1").count() == 0


def test_folds_are_even_within_labels(skewed):
    folds = sampling.assign_folds(skewed, "y", "id", 7)
    per = folds.groupBy("y", "fold").count().collect()
    for y in (0, 1):
        counts = [r["count"] for r in per if r.y == y]
        assert len(counts) == 7 and max(counts) - min(counts) <= 1
    assert folds.count() == 3000


def test_copies_share_a_fold(skewed):
    up = sampling.upsample(skewed, "y", "id")
    folds = sampling.assign_folds(up, "y", "id", 5, group_key="id")
    assert folds.count() == up.count()
    assert folds.groupBy("id").agg(F.count_distinct("fold").alias("k")).where("k > 1").count() == 0


def test_texts_are_dealt_by_their_size(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "some words here " * 50) for i in range(100)], "doc_id int, text string")
    assert tokens.corpus(docs).rdd.getNumPartitions() == 4  # the session's shuffle partitions
    monkeypatch.setattr(skew, "TASK_BYTES", 2000)
    dealt = tokens.corpus(docs)
    assert dealt.rdd.getNumPartitions() == 40
    assert tokens.dfm(tokens.tokenize(dealt)).where("n <> 50").count() == 0
    assert skew.text_tasks(docs.where("false")) == 4


def test_frequent_ngrams_of_one_text():
    words = "bär ab ab 中文字 𝒳y a".split()
    count = {}
    for w in words:
        p = f"_{w}_"
        for i in range(len(p)):
            for k in range(1, min(5, len(p) - i) + 1):
                count[p[i : i + k]] = count.get(p[i : i + k], 0) + 1
    want = sorted(count, key=lambda g: (-count[g], g))
    assert language.frequent_ngrams(words, 10_000) == want
    assert language.frequent_ngrams(words, 7) == want[:7]
    many = ["".join(chr(0x4E00 + (i * 7 + j) % 20_000) for j in range(9)) for i in range(5000)]  # more letters than fit one number
    counted = {}
    for w in many:
        p = f"_{w}_"
        for i in range(len(p)):
            for k in range(1, min(5, len(p) - i) + 1):
                counted[p[i : i + k]] = counted.get(p[i : i + k], 0) + 1
    assert language.frequent_ngrams(many, 500) == sorted(counted, key=lambda g: (-counted[g], g))[:500]


def test_language_of_repeated_and_null_ids(spark):
    profiles = spark.createDataFrame([("x", "_a", 1), ("x", "a", 2), ("y", "_b", 1), ("y", "b", 2)], "lang string, ngram string, rank int")
    rows = [(1, "a"), (1, "b b b"), (2, "A!"), (3, "12"), (4, None), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    found = language.identify_language(docs, profiles, ["x", "y"])
    got = sorted(((r.doc_id, r.detected_lang) for r in found.collect()), key=str)
    assert got == [(1, "y"), (1, "y"), (2, "x"), (3, None), (4, None), (None, None)]
    assert "Generate" not in found._jdf.queryExecution().toString()  # n-grams of documents never become rows


def dealt(df):
    """Into how many parts the rows of a join by term and salt are dealt."""
    return set(re.findall(r"RepartitionByExpression \[term#\d+, _salt#\d+\], (\d+)", df._jdf.queryExecution().optimizedPlan().toString()))


def test_joins_of_stored_facts_get_more_tasks(spark, monkeypatch, tmp_path):
    """The tasks of a trim follow the rows of the counts, also with few shuffle partitions; the rows are the same."""
    rows = [(i, f"t{(i * 7 + k) % 90}", 1 + k % 2) for i in range(200) for k in range(5)]
    spark.createDataFrame(rows, "doc_id long, term string, n long").write.parquet(str(tmp_path / "counts"))
    counts = spark.read.parquet(str(tmp_path / "counts"))
    want = sorted(map(tuple, tokens.dfm_trim(counts, 14, 11).collect()))
    monkeypatch.setattr(skew, "TASK_FACTS", 100)
    assert skew.fact_tasks(counts) == 10
    trimmed = tokens.dfm_trim(counts, 14, 11)
    assert dealt(trimmed) == {"10"}
    assert sorted(map(tuple, trimmed.collect())) == want and 0 < len(want) < 1000
    assert dealt(tokens.dfm_tfidf(counts, spark.range(200).selectExpr("count(*)"))) == {"10"}


def test_trimming_for_some_documents_judges_terms_by_all(spark):
    """Repeated and missing ids in the table or the list; only rows of listed documents come out, as many as before."""
    rows = [(d, f"w{k}", 1 + (d or 0) % 3) for d in [*range(40), 3, None] for k in range(12) if (d or 0) % (k + 1) == 0]
    counts = spark.createDataFrame(rows, "doc_id bigint, term string, n bigint")
    ids = spark.createDataFrame([(2,), (3,), (3,), (6,), (99,), (None,)], "doc_id bigint")
    whole = tokens.dfm_trim(counts, 14, 11)
    got = tokens.dfm_trim(counts, 14, 11, ids)
    assert got.columns == counts.columns
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(got) == order(whole.where("doc_id IN (2, 3, 6)")) != []


def test_cross_validation_trims_by_all_documents_and_joins_labelled_ones_only(spark, tmp_path, monkeypatch):
    from tallyscribe.operators import bayes
    from tallyscribe.plans import registry

    texts = [(d, " ".join(f"word{'abcdefgh'[(d * j) % 8]}" for j in range(1, 9)) + f" pair{d // 2} only{d}") for d in range(60)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, d % 2) for d in range(0, 60, 3)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, whole = [], bayes.nb_cross_validate
    monkeypatch.setattr(bayes, "nb_cross_validate", lambda counts, *more: seen.append(counts) or whole(counts, *more))
    out = registry.QUERIES["k1_naive_bayes_folds"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == list(range(0, 60, 3))
    assert {r.doc_id for r in seen[0].select("doc_id").collect()} == set(range(0, 60, 3))
    # Of the two documents that hold such a term one is labelled; a term of one document alone is trimmed.
    assert {r.term for r in seen[0].where("term LIKE 'pair%' OR term LIKE 'only%'").collect()} == {f"pair{d // 2}" for d in range(0, 60, 3)}


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_a_stored_stage_leaves_no_shuffle_behind(spark, tmp_path):
    """What a stage has shuffled is deleted once its files are written; the setting for that is put back, also after a failure."""
    before, setting = _shuffle_files(spark), spark.conf.get(storage.CLEANUP, None)
    path = storage.save_stage(spark.range(10_000).repartition(4, "id").withColumn("k", F.col("id") % 7).groupBy("k").count(), str(tmp_path / "stage"))
    with pytest.raises(Exception, match="wrong"):
        storage.save_stage(spark.range(3).select(F.raise_error(F.lit("wrong"))), str(tmp_path / "wrong"))
    for _ in range(50):
        left = _shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(storage.CLEANUP, None) == setting
    assert storage.load_stage(spark, path).count() == 7


def test_variants_join_the_counts_once(spark, monkeypatch):
    """The rows with their term statistics are stored, so no variant joins them again, and the counts they came from are dropped."""
    dropped = []
    monkeypatch.setattr(tokens, "drop_stage", lambda s, path: (dropped.append(path), storage.drop_stage(s, path)))
    docs = spark.createDataFrame([(1, "the cat runs, cats run"), (2, "a cat ran the mile"), (3, None), (None, "cat the cat")], "doc_id long, text string")
    variants = tokens.feature_variants(docs)
    plan = variants.where("variant <> 'stem'")._jdf.queryExecution().optimizedPlan().toString()
    assert len(dropped) == 1 and "Join" not in plan
    got = {(r.variant, r.doc_id, r.term): r.weight for r in variants.collect()}
    assert got["all", 1, "the"] == 1 and got["all", None, "the"] == 1 and ("nostop", 1, "the") not in got
    assert got["nostop", None, "cat"] == 2 and got["stem", 1, "cat"] == 2 and got["tfidf", 1, "cat"] == pytest.approx(0.12)
