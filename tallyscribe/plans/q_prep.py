"""Queries for sources, filters, expressions, merging and column-wise mapping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscribe.functions import nulls
from tallyscribe.operators import merge, prep
from tallyscribe.plans.fixtures import FLAGS, SUBJECTS, TYPES, Inputs, register
from tallyscribe.plans.registry import query, r6, s6
from tallyscribe.schema import INTERSECTIONS, SENTINEL, LabelScheme
from tallyscribe.sources import posts as post_files
from tallyscribe.sources import storage, tables

SCHEME = LabelScheme()
BIG = 9007199254740993  # the first integer that a double cannot hold
DEGREE_SQL = {
    f"x1_hate{k}": f"CASE WHEN {k} = 5 AND (subject + rater) % 31 = 0 THEN NULL WHEN scale = {k} THEN 1 ELSE 0 END" for k in range(1, 6)
}
ANSWERS = {
    **DEGREE_SQL,
    "x1_dontknow": "CASE WHEN scale IS NULL THEN 1 ELSE 0 END",
    "x2_subject": "CASE WHEN (subject + rater) % 2 = 0 THEN 1 ELSE 0 END",
    "x3_insult": "CASE WHEN (subject * 3 + rater) % 4 = 0 THEN 1 ELSE 0 END",
    "x4_age": "CASE WHEN (subject + rater) % 3 = 0 THEN 1 ELSE 0 END",
    "x5_explicitlanguage": "CASE WHEN (subject + rater) % 5 = 0 THEN NULL WHEN rater % 2 = 0 THEN 1 ELSE 0 END",
    "relevant": "CASE WHEN scale IS NULL THEN NULL ELSE CAST(1 + (subject + rater) % 3 AS INT) END",
    "hateful": "CASE WHEN scale IS NULL THEN NULL WHEN scale >= 4 THEN 1 ELSE 0 END",
    "offensive": "CASE WHEN scale >= 2 THEN 1 WHEN rater = 3 THEN NULL ELSE 0 END",
    "neither": "CASE WHEN scale = 1 THEN 1 ELSE 0 END",
    "note": "CASE WHEN (subject + rater) % 5 = 0 THEN 'note ' || CAST(rater AS VARCHAR(9)) WHEN (subject + rater) % 5 = 1 THEN '' END",
    "batch": "CASE WHEN subject % 29 = 0 THEN NULL ELSE 'batch ' || CAST(subject % 4 AS VARCHAR(9)) END",
}
register("annotations", "SELECT subject, rater, scale, " + ", ".join(f"{v} AS {k}" for k, v in ANSWERS.items()) + " FROM ratings", "ratings")


def annotations(x: Inputs):
    return x.ratings().select("subject", "rater", "scale", *[F.expr(v).alias(k) for k, v in ANSWERS.items()])


# ---- sources -----------------------------------------------------------------------------


def _post_json(x: Inputs):
    """Posts as they arrive: ids too large for a double, nested values, no language for some."""
    d = x.docs()
    return d.select(
        (F.col("doc_id") + F.lit(BIG)).alias("id"),
        "text",
        "lang",
        F.concat(F.col("date").cast("string"), F.lit("T10:00:00")).alias("created_at"),
        (F.col("doc_id") % 11).cast("int").alias("retweets_count"),
        F.struct(F.col("true_lang").alias("place_lang"), F.struct(F.col("doc_id").alias("n")).alias("geo")).alias("entities"),
    )


@query(
    "s1_read_posts",
    "docs",
    f"""SELECT CAST({BIG} + doc_id AS VARCHAR) AS id, text, lang, CAST(date AS VARCHAR) || 'T10:00:00' AS created_at,
        CAST(doc_id % 11 AS INT) AS retweets_count FROM docs""",
)
def _(x):
    path = storage.new_path(x.spark, "posts")
    _post_json(x).write.json(path)
    read = post_files.read_posts(x.spark, path, pattern="*.json", multi_line=False)
    return read.select("id", "text", "lang", "created_at", "retweets_count")


@query(
    "s1_read_arrays",
    "docs",
    f"""SELECT CAST({BIG} + doc_id AS VARCHAR) AS id, coalesce(text, '') || ' }}{{ "' || chr(92) AS text, lang, CAST(date AS VARCHAR) || 'T10:00:00' AS created_at,
        CAST(doc_id % 11 AS INT) AS retweets_count, CASE WHEN doc_id % 3 = 0 THEN CAST({BIG} + doc_id - 1 AS VARCHAR) END AS original_id,
        CASE WHEN doc_id % 3 = 0 THEN 'RT }}, {{ ' || lang END AS original_text FROM docs""",
)
def _(x):
    """Files of one array each, of some 5000 posts, as they arrive: several lines, some posts with the original inside."""
    original = F.struct((F.col("id") - 1).cast("decimal(20,0)").alias("id"), F.concat(F.lit("RT }, { "), "lang").alias("text"))
    number = F.col("id") - F.lit(BIG)
    posts = _post_json(x).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(' }{ "'), F.lit("\\")))
    posts = posts.withColumn("retweeted_status", F.when(number % 3 == 0, original))
    batch = Window.partitionBy("batch").orderBy("id")
    items = posts.select(F.floor(number / 5000).alias("batch"), "id", F.to_json(F.struct(*posts.columns)).alias("json"))
    head = F.when(F.lag("id").over(batch).isNull(), "[\n ").otherwise(",\n ")
    tail = F.when(F.lead("id").over(batch).isNull(), "\n]").otherwise("")
    path = storage.new_path(x.spark, "arrays")
    items.select("batch", F.concat(head, "json", tail).alias("value")).write.partitionBy("batch").text(path)
    read = post_files.read_post_arrays(x.spark, path, pattern="part-*")
    original = F.from_json("retweeted_status", "id string, text string")
    return read.select("id", "text", "lang", "created_at", "retweets_count", original["id"].alias("original_id"), original["text"].alias("original_text"))


@query(
    "s1_flatten",
    "docs",
    """SELECT doc_id AS id, true_lang AS entities_place_lang, doc_id AS entities_geo_n FROM docs""",
)
def _(x):
    flat = post_files.flatten(_post_json(x), separator="_")
    return flat.select((F.col("id") - F.lit(BIG)).alias("id"), "entities_place_lang", "entities_geo_n")


@query("s2_pick_batches", "docs", f"SELECT CAST({BIG} + doc_id AS VARCHAR) AS id, lang FROM docs WHERE lang = 'en' OR lang IS NULL")
def _(x):
    path = storage.new_path(x.spark, "batches")
    posts = _post_json(x).select("id", "lang")
    posts.where(F.col("lang").isNull() | (F.col("lang") == "en")).write.json(path)
    posts.where(F.col("lang") != "en").select("lang").write.mode("append").text(path)  # other files in the folder
    return post_files.read_posts(x.spark, path, pattern="*.json", multi_line=False).select("id", "lang")


@query(
    "s3_append_batches",
    "docs",
    """SELECT doc_id, lang, CASE WHEN lang IS NULL THEN NULL ELSE quality END AS quality, CASE WHEN lang IS NULL THEN toxic END AS toxic FROM docs""",
)
def _(x):
    d = x.docs()
    tagged = d.where(F.col("lang").isNotNull()).select("doc_id", "lang", "quality")
    untagged = d.where(F.col("lang").isNull()).select("toxic", "doc_id")
    return post_files.append_batches([tagged, untagged]).select("doc_id", "lang", "quality", "toxic")


CSV_SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("toxic", T.IntegerType())])


@query("s4_read_csv_ids", "docs", f"SELECT CAST({BIG} + doc_id AS VARCHAR) AS id, text, toxic FROM docs")
def _(x):
    rows = x.docs().select((F.col("doc_id") + F.lit(BIG)).cast("string").alias("id"), "text", "toxic")
    path = tables.write_csv(rows, storage.new_path(x.spark, "csv"))
    return tables.read_csv_ids(x.spark, path, CSV_SCHEMA)


@query("s5_write_csv", "posts", "SELECT CAST(post_id AS VARCHAR) AS post_id, CAST(date AS VARCHAR) AS date, CAST(scale AS VARCHAR) AS scale FROM posts")
def _(x):
    path = tables.write_csv(x.posts().select("post_id", "date", "scale"), storage.new_path(x.spark, "csv"))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("post_id", "date", "scale")])
    return tables.read_csv_ids(x.spark, path, schema, multi_line=False)


@query("s6_stage", "docs", "SELECT doc_id, date, lang, toxic FROM docs")
def _(x):
    path = storage.save_stage(x.docs().select("doc_id", "date", "lang", "toxic"), storage.new_path(x.spark, "stage"))
    return storage.load_stage(x.spark, path)


@query(
    "s7_side_inputs",
    "calendar external_series",
    "SELECT e.date, e.pagecount, c.incident, c.category FROM external_series e LEFT JOIN calendar c USING (date)",
)
def _(x):
    calendar = tables.write_csv(x.calendar(), storage.new_path(x.spark, "calendar"))
    daily = tables.write_csv(x.external_series(), storage.new_path(x.spark, "daily"))
    return tables.read_daily_series(x.spark, daily).join(tables.read_calendar(x.spark, calendar), "date", "left")


# ---- filters -----------------------------------------------------------------------------


@query("f1_filter_language", "docs", "SELECT doc_id, lang FROM docs WHERE lang = 'en' OR lang = 'und' OR (true_lang = 'en' AND lang IS NULL)")
def _(x):
    d = x.docs().select("doc_id", "lang", "true_lang")
    return prep.filter_language(d, detected="true_lang").select("doc_id", "lang")


register(
    "reposted",
    """SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'RT ' || text WHEN doc_id % 5 = 0 THEN 'RTs ' || text ELSE text END AS text,
       CASE WHEN doc_id % 11 = 0 THEN '{}' END AS retweeted_status FROM documents""",
)


@query("f2_drop_reposts", "reposted", "SELECT doc_id, text FROM reposted WHERE NOT regexp_matches(text, '^RT /*') AND retweeted_status IS NULL")
def _(x):
    d, i = x.table("documents"), F.col("doc_id")
    text = F.when(i % 13 == 0, None).when(i % 7 == 0, F.concat(F.lit("RT "), "text")).when(i % 5 == 0, F.concat(F.lit("RTs "), "text")).otherwise(F.col("text"))
    posts = d.select("doc_id", text.alias("text"), F.when(i % 11 == 0, "{}").alias("retweeted_status"))
    return prep.drop_reposts(posts).select("doc_id", "text")


@query("f3_drop_matching", "posts", "SELECT post_id, date, flag, scale, scale_m, x5_explicitlanguage, x5_implicitlanguage, reposts FROM posts")
def _(x):
    return prep.drop_matching(x.posts(), names=["user_id", "favourites"], patterns=["^x3_", "x4_"])


@query("f4_select_matching", "posts", f"SELECT post_id, scale, scale_m, {', '.join(TYPES)} FROM posts")
def _(x):
    posts = x.posts()
    names = prep.matching(posts, prefix="x3_") + prep.matching(posts, regex="^scale")
    return posts.select([c for c in posts.columns if c == "post_id" or c in names])


@query("f4_select_negated", "posts", "SELECT post_id, date, user_id, flag, scale, scale_m, reposts, favourites FROM posts")
def _(x):
    return prep.select_matching(x.posts(), regex="^x[0-9]", negate=True)


@query("f5_rename_all", "annotations", "SELECT subject AS post, rater AS coder, " + ", ".join(f"{k} AS {k[3:]}" for k in DEGREE_SQL) + " FROM annotations")
def _(x):
    a = annotations(x).select("subject", "rater", *DEGREE_SQL)
    return prep.rename_all(a, {"subject": "post", "rater": "coder", **{k: k[3:] for k in DEGREE_SQL}})


@query(
    "f6_with_date",
    "",
    """SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS created_at_date, CAST(ts AS DATE) AS date FROM events
       WHERE CAST(ts AS DATE) < DATE '2024-01-20'""",
)
def _(x):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at")
    dated = prep.with_date(x.table("events").select("event_id", text), "created_at", before="2024-01-20")
    return dated.select("event_id", F.col("created_at_date").cast("timestamp_ntz").alias("created_at_date"), "date")


@query("f8_scope_filter", "docs", "SELECT doc_id, toxic, quality FROM docs WHERE toxic IS NULL OR toxic = 0 OR (toxic = 1 AND quality = 1)")
def _(x):
    return prep.scope_filter(x.docs().select("doc_id", "toxic", "quality"), "toxic", "quality")


@query("f9_split_labelled", "docs", "SELECT doc_id, CASE WHEN toxic IS NULL THEN 'unlabelled' ELSE 'labelled' END AS part FROM docs")
def _(x):
    known, unknown = prep.split_labelled(x.docs().select("doc_id", "toxic"), "toxic")
    parts = known.select("doc_id", F.lit("labelled").alias("part"))
    return parts.unionByName(unknown.select("doc_id", F.lit("unlabelled").alias("part")))


@query("f10_label_valid", "docs", "SELECT doc_id, degree * 2 AS degree FROM docs WHERE degree * 2 IN (0, 1, 2, 3, 4, 5)")
def _(x):
    d = x.docs().select("doc_id", (F.col("degree") * 2).alias("degree"))
    return prep.where_label_valid(d, "degree")


@query("f11_exclude_batch", "annotations", "SELECT subject, rater, batch FROM annotations WHERE batch <> 'batch 2'")
def _(x):
    return prep.exclude_batch(annotations(x).select("subject", "rater", "batch"), "batch", "batch 2")


@query(
    "f14_extract_notes",
    "annotations",
    "SELECT subject, rater, note FROM annotations WHERE note <> '' AND rater < 5 UNION ALL SELECT subject, rater, note FROM annotations WHERE note <> '' AND rater >= 5",
)
def _(x):
    a = annotations(x)
    notes = prep.extract_notes(a.where(F.col("rater") < 5), "note", ["subject", "rater"])
    return merge.union_by_name(notes, prep.extract_notes(a.where(F.col("rater") >= 5), "note", ["subject", "rater"]))


@query("f15_drop_incomplete", "posts", "SELECT post_id, scale, x4_gender FROM posts WHERE scale IS NOT NULL AND x4_gender IS NOT NULL")
def _(x):
    return prep.drop_incomplete(x.posts().select("post_id", "scale", "x4_gender"))


# ---- expressions -------------------------------------------------------------------------


@query("c1_na_if_else", "posts", "SELECT post_id, CASE WHEN scale IS NULL THEN NULL WHEN scale > 3 THEN 'high' ELSE 'low' END AS level FROM posts")
def _(x):
    return x.posts().select("post_id", nulls.na_if_else(F.col("scale") > 3, "high", "low").alias("level"))


def _nested(last: str, values: dict[str, int]) -> str:
    out = last
    for name, value in values.items():
        out = f"CASE WHEN {name} IS NULL THEN NULL WHEN {name} = 1 THEN {value} ELSE {out} END"
    return out


_SCALE = {f"x1_hate{k}": k for k in range(1, 6)}
_BINARY = {f"x1_hate{k}": 0 if k == 1 else 1 for k in range(1, 6)}


@query(
    "c2_indicators_to_scale",
    "annotations",
    f"""SELECT subject, rater, {_nested("NULL", _SCALE)} AS scale5,
        {_nested("CASE WHEN x1_dontknow = 1 THEN 0 END", _SCALE)} AS scale6 FROM annotations""",
)
def _(x):
    return annotations(x).select(
        "subject",
        "rater",
        nulls.indicators_to_scale(SCHEME.degree, SCHEME.degree_dont_know).alias("scale5"),
        nulls.indicators_to_scale(SCHEME.degree, SCHEME.degree_dont_know, 0).alias("scale6"),
    )


@query(
    "c3_indicators_to_binary",
    "annotations",
    f"""SELECT subject, rater, {_nested("NULL", _BINARY)} AS binary_na,
        {_nested("CASE WHEN x1_dontknow = 1 THEN 0 END", _BINARY)} AS binary_zero FROM annotations""",
)
def _(x):
    return annotations(x).select(
        "subject",
        "rater",
        nulls.indicators_to_binary(SCHEME.degree, SCHEME.degree_dont_know).alias("binary_na"),
        nulls.indicators_to_binary(SCHEME.degree, SCHEME.degree_dont_know, 0).alias("binary_zero"),
    )


@query(
    "c4_flags_to_category",
    "annotations",
    f"""SELECT subject, rater, {_nested("0", {"neither": 0, "offensive": 1, "hateful": 2})} AS three,
        {_nested("0", {"neither": 0, "offensive": 1, "hateful": 1})} AS two FROM annotations""",
)
def _(x):
    h, o, n = F.col("hateful"), F.col("offensive"), F.col("neither")
    return annotations(x).select(
        "subject",
        "rater",
        nulls.flags_to_category([(h, 2), (o, 1), (n, 0)]).alias("three"),
        nulls.flags_to_category([(h, 1), (o, 1), (n, 0)]).alias("two"),
    )


@query("c5_recode", "annotations", "SELECT subject, rater, CASE relevant WHEN 1 THEN 1 WHEN 2 THEN 2 END AS relevant FROM annotations")
def _(x):
    return annotations(x).select("subject", "rater", nulls.recode(F.col("relevant"), {1: 1, 2: 2, 3: None}).alias("relevant"))


_KEEP = ["x1_hate1", "x1_dontknow", "x2_subject", "x3_insult", "x5_explicitlanguage"]
_EMPTY = ["x1_hate2", "x1_hate3", "x1_hate4", "x1_hate5"]


@query(
    "c6_invalidate_labels",
    "annotations",
    "SELECT subject, rater, x4_age, CASE WHEN rater IN (3, 7) AND scale <> 1 THEN NULL ELSE scale END AS scale, "
    + ", ".join(f"CASE WHEN rater IN (3, 7) AND {c} <> 1 THEN NULL ELSE {c} END AS {c}" for c in _KEEP)
    + ", "
    + ", ".join(f"CASE WHEN rater IN (3, 7) THEN NULL ELSE {c} END AS {c}" for c in _EMPTY)
    + " FROM annotations",
)
def _(x):
    a = annotations(x).select("subject", "rater", "scale", "x4_age", *_KEEP, *_EMPTY)
    return prep.invalidate_labels(a, stale=[3, 7], keep_one=_KEEP, null=_EMPTY, scale="scale")


_COMBOS = {k: v for k, v in INTERSECTIONS.items() if set(v) <= set(SUBJECTS)}


@query(
    "c7_intersect_flags",
    "posts",
    "SELECT post_id, "
    + ", ".join(
        f"CASE WHEN {' OR '.join(f'{p} = 0' for p in parts)} THEN 0 WHEN {' AND '.join(f'{p} = 1' for p in parts)} THEN 1 END AS {name}"
        for name, parts in _COMBOS.items()
    )
    + " FROM posts",
)
def _(x):
    return prep.with_intersections(x.posts(), _COMBOS).select("post_id", *_COMBOS)


@query("c9_fill_sentinel", "posts", f"SELECT post_id, coalesce(scale, {SENTINEL}) AS scale, coalesce(x4_gender, {SENTINEL}) AS x4_gender FROM posts")
def _(x):
    return x.posts().select("post_id", "scale", "x4_gender").fillna(SENTINEL, subset=["scale", "x4_gender"])


@query("c10_clamp", "docs", f"SELECT doc_id, {s6('CASE WHEN size_k > 5 THEN 5 WHEN size_k < 1 THEN 1 ELSE size_k END', 'size_k')} FROM docs")
def _(x):
    return x.docs().select("doc_id", r6(nulls.clamp(F.col("size_k"), 1.0, 5.0)).alias("size_k"))


@query(
    "c11_half_even",
    "annotations",
    "SELECT subject, round_even(median(scale) , 0) AS consensus, round_even(sum(scale) / 4.0::DOUBLE, 0) AS quarter FROM annotations GROUP BY subject",
)
def _(x):
    votes = annotations(x).groupBy("subject").agg(F.median("scale").alias("m"), (F.sum("scale") / 4.0).alias("q"))
    return votes.select("subject", nulls.half_even(F.col("m")).alias("consensus"), nulls.half_even(F.col("q")).alias("quarter"))


@query("c12_factor_code", "docs", "SELECT doc_id, CAST(degree AS INT) - 1 AS code, CAST(degree AS VARCHAR) AS level FROM docs")
def _(x):
    # A factor is its value; the code of level k is k - 1 and is derived only where a report needs it.
    return x.docs().select("doc_id", (F.col("degree") - 1).alias("code"), F.col("degree").cast("string").alias("level"))


@query(
    "c17_strip_copy_suffix",
    "docs",
    r"""SELECT DISTINCT regexp_replace(id, '\.[0-9]*', '') AS id FROM (
        SELECT CAST(doc_id AS VARCHAR) AS id FROM docs UNION ALL SELECT CAST(doc_id AS VARCHAR) || '.' || CAST(doc_id % 3 AS VARCHAR) FROM docs
        UNION ALL SELECT 'a.12.5.' || CAST(doc_id AS VARCHAR) FROM docs) t""",
)
def _(x):
    i = F.col("doc_id").cast("string")
    copies = F.explode(F.array(i, F.concat(i, F.lit("."), (F.col("doc_id") % 3).cast("string")), F.concat(F.lit("a.12.5."), i)))
    return x.docs().select(copies.alias("id")).select(nulls.strip_copy_suffix(F.col("id")).alias("id")).distinct()


# ---- joins, sets, mapping ----------------------------------------------------------------


@query(
    "j3_merge_posts_labels",
    "docs",
    """SELECT DISTINCT coalesce(p.doc_id, l.doc_id) AS doc_id, p.lang, l.toxic FROM
         (SELECT doc_id, lang FROM docs UNION ALL SELECT doc_id, lang FROM docs) p
         FULL JOIN (SELECT doc_id * 2 AS doc_id, toxic FROM labels) l ON p.doc_id = l.doc_id""",
)
def _(x):
    # Posts are listed twice, as reposts are; doubled ids leave some labels without a post.
    posts = x.docs().select("doc_id", "lang")
    labels = x.table("labels").select((F.col("doc_id") * 2).alias("doc_id"), F.lit("label").alias("lang"), "toxic")
    return merge.merge_posts_labels(posts.unionByName(posts), labels, "doc_id", text="lang")


@query("j8_listed_or", "docs", "SELECT doc_id FROM docs WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) OR lang = 'fr'")
def _(x):
    keys = x.table("labels").where(F.col("quality") == 0)
    return merge.keep_listed_or(x.docs().select("doc_id", "lang"), keys, "doc_id", F.col("lang") == "fr").select("doc_id")


@query("j9_anti_join", "docs", "SELECT doc_id, lang FROM docs d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def _(x):
    return merge.anti_join(x.docs().select("doc_id", "lang"), x.table("labels").where(F.col("toxic") == 1), "doc_id")


@query("a19_distinct", "posts", "SELECT DISTINCT user_id, date, flag FROM posts")
def _(x):
    return x.posts().select("user_id", "date", "flag").distinct()


@query("u1_union_by_name", "docs", "SELECT doc_id, lang FROM docs UNION ALL SELECT doc_id, true_lang FROM docs WHERE toxic = 1")
def _(x):
    d = x.docs()
    return merge.union_by_name(d.select("doc_id", "lang"), d.where(F.col("toxic") == 1).select(F.col("true_lang").alias("lang"), "doc_id"))


@query("u2_union_allow_missing", "docs", "SELECT doc_id, lang, NULL::INT AS toxic FROM docs WHERE toxic IS NULL UNION ALL SELECT doc_id, NULL, toxic FROM docs WHERE toxic IS NOT NULL")
def _(x):
    d = x.docs()
    a, b = d.where(F.col("toxic").isNull()).select("doc_id", "lang"), d.where(F.col("toxic").isNotNull()).select("doc_id", "toxic")
    return merge.union_by_name(a, b, allow_missing=True)


@query(
    "w4_mark_duplicates",
    "",
    "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY source, n_chars % 50 ORDER BY doc_id) > 1 THEN 1 ELSE 0 END AS is_copy FROM documents",
)
def _(x):
    d = x.table("documents").select("doc_id", "source", (F.col("n_chars") % 50).alias("size"))
    return prep.mark_duplicates(d, ["source", "size"], ["doc_id"]).select("doc_id", "is_copy")


@query("x1_map_columns", "posts", "SELECT post_id, " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in FLAGS) + " FROM posts")
def _(x):
    posts = x.posts().select("post_id", *FLAGS)
    return prep.map_columns(posts, prep.matching(posts, regex="^x[0-9]"), lambda c: c.cast("string"))
