"""Files in and out."""

import json

import pytest
from pyspark.sql import types as T

from tallyscribe.sources import posts, storage, tables

BIG = 1234567890123456789


@pytest.fixture
def folder(tmp_path):
    first = [
        {"id": BIG, "text": "line one\nline \"two\"", "lang": "en", "created_at": "2019-01-01 10:00:00", "place": {"x": 1}},
        {"id": BIG + 1, "text": 42, "lang": None, "retweeted_status": {"id": 7}},
    ]
    (tmp_path / "1_tweets.json").write_text(json.dumps(first, indent=1))
    (tmp_path / "2_tweets.json").write_text(json.dumps([{"id": BIG + 2, "text": "x", "extra": 1}], indent=1))
    (tmp_path / "other.json").write_text(json.dumps([{"id": 1, "text": "not a batch"}]))
    return str(tmp_path)


def test_json_arrays_keep_long_ids(spark, folder):
    got = {r.id: r for r in posts.read_posts(spark, folder).collect()}
    assert set(got) == {str(BIG), str(BIG + 1), str(BIG + 2)}
    assert got[str(BIG)].text == 'line one\nline "two"'
    assert got[str(BIG + 1)].text == "42" and json.loads(got[str(BIG + 1)].retweeted_status) == {"id": 7}
    assert got[str(BIG + 2)].lang is None


def test_arrays_are_split_at_records(spark, folder, tmp_path):
    """Blocks of 64 bytes, with braces, brackets, quotes and backslashes in texts and nested originals."""
    odd = ['}{ "', "\\", 'a\\"}', "},{", '[{"id": 1}]', "", "{" * 40, "}" * 40, '"' * 9, "é😀}\u2028{", "line\nbreak }\r\n"]
    records = [{"id": BIG + 10 + k, "text": odd[k % len(odd)] * (1 + k % 3), "retweeted_status": {"id": k, "user": {"t": odd[-k % len(odd)]}}} for k in range(200)]
    (tmp_path / "3_tweets.json").write_text(json.dumps(records))
    (tmp_path / "4_tweets.json").write_text(json.dumps(records[:7], indent=2, ensure_ascii=False))
    (tmp_path / "5_tweets.json").write_text("[]")
    (tmp_path / "6_tweets.json").write_text("")

    def rows(df):
        """Nested values as parsed: one reader keeps their layout, the other writes them anew."""
        return sorted(str(dict(r.asDict(), retweeted_status=json.loads(r.retweeted_status or "null"))) for r in df.collect())

    want = rows(posts.read_posts(spark, folder))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        pieces = spark.read.option("lineSep", "}").text(str(tmp_path / "3_tweets.json"))
        assert pieces.rdd.getNumPartitions() > 50
        got = posts.read_post_arrays(spark, folder)
        assert got.schema == posts.read_posts(spark, folder).schema
        assert rows(got) == want and len(want) == 210
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert rows(posts.read_post_arrays(spark, folder)) == want


def test_flatten_gives_dotted_names(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('urls', 'u', 'geo', named_struct('lat', 2.5D)) AS entities")
    assert posts.flatten(df).columns == ["id", "entities.urls", "entities.geo.lat"]


def test_batches_with_different_columns(spark):
    a = spark.sql("SELECT 1 AS id, 'a' AS text")
    b = spark.sql("SELECT 'en' AS lang, 2 AS id")
    assert sorted(map(tuple, posts.append_batches([a, b]).collect())) == [(1, "a", None), (2, None, "en")]


def test_csv_round_trip(spark, tmp_path):
    schema = "id string, text string, n int"
    rows = [(str(BIG), 'a "quoted", text\nsecond line', 1), (str(BIG + 1), None, None), ("0012", "", 2)]
    path = tables.write_csv(spark.createDataFrame(rows, schema), str(tmp_path / "out"))
    struct = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())])
    got = {r.id: (r.text, r.n) for r in tables.read_csv_ids(spark, path, struct).collect()}
    assert got[str(BIG)] == ('a "quoted", text\nsecond line', 1)
    assert got[str(BIG + 1)] == (None, None)
    assert set(got) == {str(BIG), str(BIG + 1), "0012"}


def test_stage_partitions_are_pruned(spark, tmp_path):
    df = spark.sql("SELECT id, DATE '2024-01-01' + CAST(id % 3 AS INT) AS date FROM range(9)")
    path = storage.save_stage(df, str(tmp_path / "stage"), partition_by="date")
    back = storage.load_stage(spark, path).where("date = DATE '2024-01-02'")
    assert back.count() == 3
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_stages_go_to_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = storage.new_path(spark, "x")
    assert named is None or path.startswith(named)
    assert spark.sparkContext.applicationId in path
    assert storage.new_path(spark, "x") != path
    assert storage.cut_lineage(spark.range(5), "ids").count() == 5


class _Session:
    """A cluster session that names no shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_a_cluster_must_name_the_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(_Session)
