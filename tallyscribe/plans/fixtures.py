"""The study's inputs, derived from the test tables by DataFrame code, and the same views in SQL.

``Inputs`` feeds the queries; ``VIEWS`` holds independent SQL for the oracle. Both read whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_RATERS = 10
RATERS = tuple(range(N_RATERS))
COMPLETE = tuple(range(N_RATERS - 1))
LANGUAGES = ("de", "en", "es", "fr")

# Further indicators of the posts view, as SQL that both engines read.
FLAGS = {
    "x3_insult": "CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END",
    "x3_mocking": "CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END",
    "x3_disparagement": "CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END",
    "x3_violence": "CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END",
    "x3_prejudice": "CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END",
    "x4_age": "CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END",
    "x4_gender": "CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 1 ELSE 0 END",
    "x4_manipulation": "CASE WHEN user_id % 4 = 0 THEN 1 ELSE 0 END",
    "x4_climatechange": "CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 1 ELSE 0 END",
    "x4_mentalphysicalcapacity": "CASE WHEN event_id % 8 = 0 THEN 1 ELSE 0 END",
    "x4_class": "CASE WHEN user_id % 6 = 0 THEN 1 ELSE 0 END",
    "x4_race": "CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END",
    "x5_explicitlanguage": "CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END",
    "x5_implicitlanguage": "CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END",
}
TYPES = [c for c in FLAGS if c.startswith("x3_")]
SUBJECTS = [c for c in FLAGS if c.startswith("x4_")]
LANGUAGE = [c for c in FLAGS if c.startswith("x5_")]

VIEWS = {
    "posts": """
        SELECT event_id AS post_id, CAST(ts AS DATE) AS date, user_id,
          CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS flag,
          CASE WHEN user_id % 19 = 0 THEN NULL ELSE CAST(1 + CAST(floor(value) AS BIGINT) % 5 AS INT) END AS scale,
          value / 100 AS scale_m, """
    + ", ".join(f"{sql} AS {name}" for name, sql in FLAGS.items())
    + """, user_id % 11 AS reposts, user_id % 17 AS favourites
        FROM events""",
    "docs": """
        SELECT d.doc_id, d.text,
          CASE WHEN d.doc_id % 23 = 0 THEN NULL WHEN d.doc_id % 17 = 0 THEN 'und' ELSE d.lang END AS lang,
          d.lang AS true_lang, DATE '2024-01-01' + CAST(d.doc_id % 30 AS INT) AS date, l.toxic, l.quality,
          CASE WHEN l.doc_id IS NULL THEN NULL ELSE CAST(1 + d.doc_id % 5 AS INT) END AS degree,
          CASE WHEN l.doc_id IS NULL THEN NULL ELSE d.n_chars / 1000.0::DOUBLE END AS size_k
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "ratings": """
        SELECT l.doc_id AS subject, r.rater AS rater,
          CASE WHEN (l.doc_id * 11 + r.rater * 5) % 37 = 0 THEN NULL
               ELSE CAST(least(5, 1 + 2 * l.toxic + l.doc_id % 3
                    + CASE WHEN (l.doc_id * 13 + r.rater * 7) % 10 < 2 THEN 1 ELSE 0 END) AS INT) END AS scale
        FROM labels l, (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) AS r(rater)
        WHERE NOT (r.rater = 9 AND l.doc_id % 2 = 1)""",
    "raters": """
        SELECT r.rater AS rater, CASE WHEN r.rater % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
          CASE WHEN r.rater % 3 = 0 THEN 'native' ELSE 'nonnative' END AS native
        FROM (SELECT DISTINCT rater FROM ratings) r""",
    "calendar": """
        SELECT date, CONCAT('incident ', CAST(day(date) AS VARCHAR)) AS incident,
          CASE day(date) % 5 WHEN 0 THEN 'event' WHEN 1 THEN 'offline action other' WHEN 2 THEN 'online action other'
               WHEN 3 THEN 'offline action subject' ELSE 'online action subject' END AS category
        FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events) t WHERE day(date) % 4 = 1""",
    "external_series": """
        SELECT CAST(ts AS DATE) AS date, count(*) AS pagecount FROM events WHERE event_type = 'view' GROUP BY 1""",
    "full_ratings": """
        SELECT subject, rater, CAST(scale AS DOUBLE) AS rating FROM ratings
        WHERE rater < 9 AND subject IN (
          SELECT subject FROM ratings WHERE rater < 9 AND scale IS NOT NULL GROUP BY 1 HAVING count(*) = 9)""",
    "daily": """
        SELECT date, CAST(sum(flag) AS BIGINT) AS positives, count(*) - CAST(sum(flag) AS BIGINT) AS negatives,
          count(*) AS total, CAST(sum(flag) AS DOUBLE) / count(*) AS positive_share,
          avg(scale) AS mean_scale, avg(scale_m) AS mean_scale_m
        FROM posts GROUP BY date""",
    "positive_posts": """
        SELECT * FROM posts WHERE flag = 1 OR scale > 1 OR scale_m > 1""",
    "daily_cat": "SELECT date, count(*) AS n_positive, "
    + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in FLAGS)
    + " FROM positive_posts GROUP BY date",
}
NEEDS = {
    "raters": ["ratings"],
    "full_ratings": ["ratings"],
    "daily": ["posts"],
    "positive_posts": ["posts"],
    "daily_cat": ["positive_posts"],
}


def register(name: str, sql: str, *needs: str) -> None:
    """Add a named view for the oracles of a query module."""
    VIEWS[name] = sql
    NEEDS[name] = list(needs)


def with_views(names: str, body: str) -> str:
    """``WITH`` clause that defines the named views (and what they need) in front of ``body``."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, []):
            visit(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        visit(name)
    ctes = ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in order)
    if not ctes:
        return body
    own = body.strip()
    return f"WITH {ctes}, {own[5:]}" if own.startswith("WITH ") else f"WITH {ctes} {own}"


class Inputs:
    """The derived inputs as DataFrames over one directory of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def posts(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            F.col("event_id").alias("post_id"),
            F.to_date("ts").alias("date"),
            "user_id",
            F.when(F.col("event_type") == "error", 1).otherwise(0).alias("flag"),
            F.when(F.col("user_id") % 19 != 0, 1 + F.floor("value").cast("bigint") % 5).cast("int").alias("scale"),
            (F.col("value") / 100).alias("scale_m"),
            *[F.expr(sql).alias(name) for name, sql in FLAGS.items()],
            (F.col("user_id") % 11).alias("reposts"),
            (F.col("user_id") % 17).alias("favourites"),
        )

    def docs(self) -> DataFrame:
        d, labels = self.table("documents"), self.table("labels").withColumn("_l", F.lit(1))
        known = F.col("_l").isNotNull()
        return d.join(labels, "doc_id", "left").select(
            "doc_id",
            "text",
            F.when(F.col("doc_id") % 23 == 0, None).when(F.col("doc_id") % 17 == 0, "und").otherwise(F.col("lang")).alias("lang"),
            F.col("lang").alias("true_lang"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("date"),
            "toxic",
            "quality",
            F.when(known, 1 + F.col("doc_id") % 5).cast("int").alias("degree"),
            F.when(known, F.col("n_chars") / 1000.0).alias("size_k"),
        )

    def ratings(self) -> DataFrame:
        labels = self.table("labels")
        asked = labels.withColumn("rater", F.explode(F.sequence(F.lit(0), F.lit(N_RATERS - 1))))
        noise = F.when((F.col("doc_id") * 13 + F.col("rater") * 7) % 10 < 2, 1).otherwise(0)
        answer = F.least(F.lit(5), 1 + 2 * F.col("toxic") + F.col("doc_id") % 3 + noise).cast("int")
        return asked.where(~((F.col("rater") == 9) & (F.col("doc_id") % 2 == 1))).select(
            F.col("doc_id").alias("subject"),
            "rater",
            F.when((F.col("doc_id") * 11 + F.col("rater") * 5) % 37 != 0, answer).alias("scale"),
        )

    def raters(self) -> DataFrame:
        return self.ratings().select("rater").distinct().select(
            "rater",
            F.when(F.col("rater") % 2 == 0, "Female").otherwise("Male").alias("gender"),
            F.when(F.col("rater") % 3 == 0, "native").otherwise("nonnative").alias("native"),
        )

    def calendar(self) -> DataFrame:
        dates = self.table("events").select(F.to_date("ts").alias("date")).distinct().where(F.day("date") % 4 == 1)
        kinds = ["event", "offline action other", "online action other", "offline action subject", "online action subject"]
        kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.day("date") % 5 + 1)
        return dates.select("date", F.concat(F.lit("incident "), F.day("date").cast("string")).alias("incident"), kind.alias("category"))

    def external_series(self) -> DataFrame:
        views = self.table("events").where(F.col("event_type") == "view")
        return views.groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("pagecount"))
