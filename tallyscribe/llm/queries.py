"""Named queries of the numbered operators, and the SQL that some of them are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscribe.llm import bpe, exact, fim, langid, lines, lm, minhash, packing, quality, spelling, suffix, tokenfiles, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WORD = r"[^\x20\x09-\x0D]+"
SQL_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def query(name: str, sql: str | None = None):
    """Register a function of ``(spark, sf_dir)``."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query(
    "op2_line_dedup",
    f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, {SQL_WS}), {SQL_FOLD}) AS line_key FROM l),
s AS (SELECT line_key, min(doc_id) AS first_doc FROM k WHERE length(line_key) >= 10 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 2)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE s.first_doc IS NOT NULL AND s.first_doc <> k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE s.first_doc IS NULL OR s.first_doc = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN s USING (line_key) GROUP BY k.doc_id""",
)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query(
    "op4_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
  count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents""",
)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir))


def _any_sql(rules) -> str:
    return " OR ".join(r.sql() for r in rules)


@query(
    "op7_quality_rules",
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM b),
g AS (SELECT doc_id, pos, n, concat_ws(' ', w, lead(w, 1) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p, lead(w, 4) OVER p) AS gram
  FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos FROM g WHERE pos <= n - 4 QUALIFY count(*) OVER (PARTITION BY doc_id, gram) >= 2),
c AS (SELECT doc_id, count(DISTINCT pos + o) AS n_repeat_words FROM r, (SELECT unnest(range(5)) AS o) GROUP BY doc_id),
m AS (SELECT b.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(t, '!')) AS n_exclaims, len(ls) AS n_lines,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  len(list_filter(ws, lambda x: list_contains({list(quality.STOP_WORDS)}, lower(x)))) AS n_stop_words,
  coalesce(c.n_repeat_words, 0) AS n_repeat_words FROM b LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_any_sql(quality.BASE_RULES)}) AS base_failed,
  NOT ({_any_sql((*quality.BASE_RULES, *quality.RULES))}) AS kept FROM m""",
)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2).drop("ids")


@query("op6_bpe_codec")
def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), digests=True)


@query(
    "op1_minhash_dedup",
    f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {SQL_FOLD}), '{WORD}') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM d),
g AS (SELECT doc_id, n, pos, w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS gram, w FROM w),
s AS (SELECT DISTINCT doc_id, CASE WHEN n = 1 THEN w ELSE gram END AS gram FROM g WHERE n = 1 OR pos < n),
z AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS same FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN z zx ON zx.doc_id = x JOIN z zy ON zy.doc_id = y WHERE 100 * same >= 80 * (zx.size + zy.size - same)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reached)
SELECT doc_id, coalesce(max(size), 0) AS n_shingles, min(reached) AS component_id, doc_id = min(reached) AS kept
FROM r LEFT JOIN z USING (doc_id) GROUP BY doc_id""",
)
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(documents(spark, sf_dir), shingle=2, similarity=80)


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir), form="sha256").drop("others").withColumnRenamed("kept", "kept_sha256")


@query("op8_lm_scoring")
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    docs = documents(spark, sf_dir)
    model, counts = lm.fit(docs.where(fold != 2))
    return lm.score(docs, model, counts).select("doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def toxicity_index(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Index:
    """The index of ``docs``, learnt from the labels of the rows whose crc32 of the id leaves no 1 when divided by 3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    return toxicity.fit(docs, labels)


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    out = toxicity.score(docs, toxicity_index(spark, docs, sf_dir))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


def _fim_sql() -> str:
    """Tokens as a list, numbers from the hex digest, parts as slices of the list."""
    p, s, m = fim.PREFIX, fim.SUFFIX, fim.MIDDLE
    marked = " OR ".join(f"contains(t, '{x}')" for x in (p, s, m))
    draw = lambda k: f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)"
    part = lambda a, b: f"array_to_string(list_slice(ts, {a} + 1, {b}), '')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{fim.SEED}:' || doc_id) AS h FROM documents),
k AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS ts FROM d),
f AS (SELECT *, len(ts) AS n, CASE WHEN t = '' OR {marked} OR {draw(2)} % 100 >= {fim.RATE} THEN 'plain'
  WHEN {draw(3)} % 100 < {fim.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM k),
c AS (SELECT *, least({draw(0)} % (n + 1), {draw(1)} % (n + 1)) AS a, greatest({draw(0)} % (n + 1), {draw(1)} % (n + 1)) AS b FROM f),
p AS (SELECT *, {part(0, 'a')} AS pre, {part('a', 'b')} AS mid, {part('b', 'n')} AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || pre || '{s}' || suf || '{m}' || mid ELSE '{s}' || suf || '{p}' || pre || '{m}' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""


@query("op11_fill_in_middle", _fim_sql())
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(documents(spark, sf_dir))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restored()).alias("restored_sha256")
    )


DROP_EVERY = 199


def _spelling_sql() -> str:
    """crc32 byte by byte from its table; near words by equal strings after one deletion; roots by recursion."""
    return f"""WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), {SQL_FOLD}) AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS times FROM r WHERE length(run) >= {spelling.MIN_CHARS} GROUP BY doc_id, run),
x AS (SELECT *, hex(encode(doc_id || ':' || run)) AS hx FROM u),
h AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(hx), 2), lambda k: CAST('0x' || substr(hx, k, 2) AS BIGINT))),
    lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM x, tab),
o AS (SELECT times, CASE WHEN h % {DROP_EVERY} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
v AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM o WHERE length(word) >= {spelling.MIN_CHARS} GROUP BY word HAVING sum(times) >= {spelling.MIN_COUNT}),
g AS (SELECT word, n, k, left(word, k - 1) || substr(word, k + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM v)),
near AS (SELECT a.word, b.word AS other, b.n FROM g a JOIN g b ON a.less = b.less AND a.k = b.k AND a.word <> b.word
  UNION SELECT g.word, v.word, v.n FROM g JOIN v ON g.less = v.word UNION SELECT v.word, g.word, g.n FROM g JOIN v ON g.less = v.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {spelling.RATIO} * v.n THEN most END AS form_n FROM v LEFT JOIN best USING (word)),
l AS (SELECT f.*, (SELECT min(other) FROM near WHERE near.word = f.word AND near.n = f.form_n) AS form FROM f),
chain(word, last) AS (SELECT word, word FROM l UNION ALL SELECT chain.word, l.form FROM chain JOIN l ON l.word = chain.last WHERE l.form IS NOT NULL)
SELECT l.word, l.form, c.last AS root, l.n, l.n_near, l.form_n FROM l JOIN chain c ON c.word = l.word
WHERE NOT EXISTS (SELECT 1 FROM l e WHERE e.word = c.last AND e.form IS NOT NULL)"""


@query("op12_spelling_variants", _spelling_sql())
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir), drop_every=DROP_EVERY)


@query("op13_language_id")
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = langid.fit(docs.where(~held_out), public_tokenizers.path("piece_bpe_32k.model"))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
