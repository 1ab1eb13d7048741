"""Text queries: cleaning, tokens, document-feature tables, language identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyscribe.functions import text as tx
from tallyscribe.operators import language, tokens
from tallyscribe.operators.models import term_index, to_vectors
from tallyscribe.plans.fixtures import LANGUAGES, Inputs, register
from tallyscribe.plans.registry import query
from tallyscribe.sources.storage import cut_lineage

# ---- cleaning ----------------------------------------------------------------------------

register(
    "messy",
    """SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, '@Éric_9 ' || text || ' donâ€™t <b>x</b> <a href> see http://t.co/' || CAST(doc_id AS VARCHAR)
         || '), shttps://ex.org/é?a=1. pic.twitter.com/a' || CAST(doc_id AS VARCHAR) || '! ðŸ€ end,@x' AS text FROM documents
       UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR), url || ' ' || html FROM pages""",
)

GRAPH = r"[^\s\p{Z}\p{Cc}]"
SQL_STEPS = {
    "mentions": lambda t: f"regexp_replace({t}, '@{GRAPH}*', '', 'g')",
    "tags": lambda t: f"regexp_replace({t}, '<{GRAPH}*>', ' ', 'g')",
    "encoding": lambda t: f"translate(replace({t}, 'â€™', ''''), 'ðŸ€™â¤£˜ªï', '')",
    "urls": lambda t: rf"regexp_replace(regexp_replace({t}, '(s?)(f|ht)tp(s?)://\S*[\p{{L}}\p{{N}}_]', ' ', 'g'), 'pic.twitter.com/\S*[\p{{L}}\p{{N}}_]', ' ', 'g')",
    "stops": lambda t: f"translate({t}, '.,', '  ')",
}


def _clean_sql() -> str:
    out = "text"
    for step in SQL_STEPS.values():
        out = step(out)
    return out


def messy(x: Inputs):
    d, p = x.table("documents"), x.table("pages")
    i = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit("@Éric_9 "), "text", F.lit(" donâ€™t <b>x</b> <a href> see http://t.co/"), i,
        F.lit("), shttps://ex.org/é?a=1. pic.twitter.com/a"), i, F.lit("! ðŸ€ end,@x"),
    )
    posts = d.select(F.concat(F.lit("d"), i).alias("id"), text.alias("text"))
    pages = p.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.concat("url", F.lit(" "), "html").alias("text"))
    return posts.unionByName(pages)


def _cleaning(name: str, key: str, fn):
    @query(name, "messy", lambda: f"SELECT id, {SQL_STEPS[key]('text')} AS text FROM messy")
    def _(x):
        return messy(x).select("id", fn(F.col("text")).alias("text"))


_cleaning("t1_remove_mentions", "mentions", tx.remove_mentions)
_cleaning("t2_remove_tags", "tags", tx.remove_tags)
_cleaning("t3_repair_encoding", "encoding", tx.repair_encoding)
_cleaning("t4_remove_urls", "urls", tx.remove_urls)
_cleaning("t5_split_stops", "stops", tx.split_stops)


@query("t5_clean_text", "messy", lambda: f"SELECT id, {_clean_sql()} AS text FROM messy")
def _(x):
    return tokens.with_clean_text(messy(x))


@query(
    "t6_tokenize_turns",
    "",
    lambda: f"""SELECT conv_id, turn, unnest(toks) AS token, CAST(generate_subscripts(toks, 1) - 1 AS INT) AS pos FROM (
        SELECT conv_id, turn, {TOKENS_SQL.replace('text', _clean_sql())} AS toks FROM conversations) t""",
)
def _(x):
    turns = tokens.with_clean_text(x.table("conversations")).withColumn("doc_id", F.struct("conv_id", "turn"))
    return tokens.tokenize(turns).select("doc_id.conv_id", "doc_id.turn", "token", "pos")


# ---- tokens ------------------------------------------------------------------------------

TOKENS_SQL = r"regexp_extract_all(lower(regexp_replace(text, '(https?|ftp)://\S+', ' ', 'g')), '[\p{N}#_]*\p{L}[\p{L}\p{N}#_]*(?:''[\p{L}\p{N}#_]+)*')"
STOPS_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in tx.STOP_WORDS)

register(
    "toks",
    f"""SELECT doc_id, unnest(toks) AS token, CAST(generate_subscripts(toks, 1) - 1 AS INT) AS pos FROM (
        SELECT doc_id, {TOKENS_SQL} AS toks FROM documents) t""",
)
register("content_toks", f"SELECT * FROM toks WHERE token NOT IN ({STOPS_SQL}) AND length(token) >= 2", "toks")
register("counts", "SELECT doc_id, token AS term, count(*) AS n FROM toks GROUP BY 1, 2", "toks")
register("content", "SELECT doc_id, token AS term, count(*) AS n FROM content_toks GROUP BY 1, 2", "content_toks")
TRIMMED = """SELECT doc_id, term, n FROM {frm} WHERE term IN
    (SELECT term FROM {frm} GROUP BY term HAVING sum(n) >= 2 AND count(*) >= 2) AND term NOT IN ('', 'amp')"""
register("trimmed_all", TRIMMED.format(frm="counts"), "counts")
register("trimmed", TRIMMED.format(frm="content"), "content")
register(
    "tfidf",
    """SELECT doc_id, term, round_even(n * log10((SELECT count(*) FROM documents)::DOUBLE / df), 2) AS weight FROM trimmed
       JOIN (SELECT term, count(*) AS df FROM trimmed GROUP BY term) s USING (term)""",
    "trimmed",
)


def counts(x: Inputs):
    return tokens.dfm(tokens.tokenize(tokens.corpus(x.table("documents"))))


def content(x: Inputs):
    return tokens.dfm(tokens.remove_stopwords(tokens.tokenize(tokens.corpus(x.table("documents")))))


def trimmed(x: Inputs, ids=None):
    """Of all documents, or of those listed in ``ids`` with terms trimmed by all."""
    return tokens.dfm_drop(tokens.dfm_trim(content(x), 2, 2, ids))


@query("t6_tokenize", "toks", "SELECT doc_id, pos, token FROM toks")
def _(x):
    return tokens.tokenize(x.table("documents"))


@query("t7_remove_stopwords", "content_toks", "SELECT doc_id, pos, token FROM content_toks")
def _(x):
    return tokens.remove_stopwords(tokens.tokenize(x.table("documents")))


@query("t8_stem_tokens")
def _(x):
    return tokens.stem_tokens(content(x))


@query("t8_stem_vocabulary")
def _(x):
    return tokens.stem_map(content(x))


@query("t9_dfm", "counts", "SELECT doc_id, term, n FROM counts")
def _(x):
    return counts(x)


@query(
    "t10_dfm_trim",
    "content",
    """SELECT doc_id, term, n FROM content WHERE term IN (SELECT term FROM content GROUP BY term HAVING sum(n) >= 2 AND count(*) >= 2)""",
)
def _(x):
    return tokens.dfm_trim(content(x), 2, 2)


@query("t11_dfm_drop", "content", "SELECT doc_id, term, n FROM content WHERE term NOT IN ('', 'amp', 'nbsp', 'tion')")
def _(x):
    return tokens.dfm_drop(content(x), [*tx.DROPPED_FEATURES, "nbsp", "tion"])


@query("t12_dfm_tfidf", "tfidf", "SELECT doc_id, term, weight + 0.0 AS weight FROM tfidf")
def _(x):
    n_docs = x.table("documents").agg(F.count(F.lit(1)))
    return tokens.dfm_tfidf(cut_lineage(trimmed(x), "features"), n_docs).withColumn("weight", F.col("weight") + F.lit(0.0))


@query("t13_dfm_docs", "content", "SELECT doc_id, term, n FROM content WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(x):
    return tokens.dfm_docs(content(x), x.table("labels").where(F.col("toxic") == 1))


@query(
    "t14_dfm_match",
    "content",
    """SELECT doc_id, term, n FROM (
         SELECT c.doc_id, c.term, c.n, l.doc_id IS NOT NULL AS labelled, max(CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY c.term) AS known
         FROM content c LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = c.doc_id) t WHERE NOT labelled AND known = 1""",
)
def _(x):
    c, labels = cut_lineage(content(x), "counts"), x.table("labels")
    vocab = tokens.vocabulary(tokens.dfm_docs(c, labels))
    return tokens.dfm_match(c.join(labels, "doc_id", "left_anti"), vocab)


@query("t15_feature_variants")
def _(x):
    return tokens.feature_variants(x.table("documents"))


@query(
    "t15_feature_variants_unstemmed",
    "trimmed_all trimmed tfidf",
    """SELECT 'all' AS variant, doc_id, term, n::DOUBLE AS weight FROM trimmed_all UNION ALL SELECT 'nostop', doc_id, term, n::DOUBLE FROM trimmed
       UNION ALL SELECT 'tfidf', doc_id, term, weight + 0.0 FROM tfidf""",
)
def _(x):
    variants = tokens.feature_variants(x.table("documents")).where(F.col("variant") != "stem")
    return variants.withColumn("weight", F.col("weight") + F.lit(0.0))


# ---- language ----------------------------------------------------------------------------

register(
    "grams",
    r"""SELECT doc_id, true_lang, substr(p, i, k) AS ngram, CAST(sum(c) AS BIGINT) AS n FROM (
         SELECT doc_id, true_lang, p, c, k, unnest(range(1, length(p) - k + 2)) AS i FROM (
           SELECT doc_id, true_lang, p, c, unnest([1, 2, 3, 4, 5]) AS k FROM (
             SELECT doc_id, true_lang, '_' || w || '_' AS p, count(*) AS c FROM (
               SELECT doc_id, true_lang, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM docs) a
             GROUP BY ALL) b) d WHERE length(p) >= k) e GROUP BY 1, 2, 3""",
    "docs",
)
register(
    "profiles",
    """SELECT lang, ngram, rank FROM (SELECT true_lang AS lang, ngram, row_number() OVER (PARTITION BY true_lang ORDER BY sum(n) DESC, ngram) AS rank
       FROM grams GROUP BY true_lang, ngram) t WHERE rank <= 300""",
    "grams",
)
register(
    "detected",
    """SELECT doc_id, arg_min(lang, d * 100 + li) AS detected_lang, CAST(min(d) AS BIGINT) AS distance FROM (
         SELECT g.doc_id, l.lang, l.li, sum(coalesce(abs(g.rank - p.rank), 300)) AS d FROM
           (SELECT * FROM (SELECT doc_id, ngram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ngram) AS rank FROM grams) t WHERE rank <= 300) g
           JOIN (VALUES ('de', 0), ('en', 1), ('es', 2), ('fr', 3)) AS l(lang, li) ON TRUE
           LEFT JOIN profiles p ON p.ngram = g.ngram AND p.lang = l.lang GROUP BY 1, 2, 3) u GROUP BY doc_id""",
    "grams",
    "profiles",
)


def _profiles(x: Inputs):
    return language.language_profiles(x.docs(), lang="true_lang").withColumnRenamed("true_lang", "lang")


def detected(x: Inputs):
    return language.identify_language(x.docs(), _profiles(x), LANGUAGES)


@query("t16_language_profiles", "profiles", "SELECT lang, ngram, CAST(rank AS INT) AS rank FROM profiles")
def _(x):
    return _profiles(x)


@query(
    "t16_identify_language",
    "docs detected",
    """SELECT doc_id, CASE WHEN doc_id % 50 <> 0 THEN detected_lang END AS detected_lang, CASE WHEN doc_id % 50 <> 0 THEN distance END AS distance
       FROM docs LEFT JOIN detected USING (doc_id)""",
)
def _(x):
    # Every fiftieth document has no letter: it stays, without a language.
    letters = F.when(F.col("doc_id") % 50 == 0, F.lit("12 34 !")).otherwise(F.col("text"))
    return language.identify_language(x.docs().withColumn("text", letters), _profiles(x), LANGUAGES)


@query(
    "f1_filter_detected",
    "docs detected",
    """SELECT doc_id, lang, detected_lang FROM docs LEFT JOIN detected USING (doc_id) WHERE lang = 'en' OR lang = 'und' OR (detected_lang = 'en' AND lang IS NULL)""",
)
def _(x):
    from tallyscribe.operators.prep import filter_language

    d = x.docs()
    # Posts tagged with another language fail on their tag; the rest get a detected language beside theirs.
    found = language.identify_language(d.where(F.col("lang").isNull() | F.col("lang").isin("en", "und")), _profiles(x), LANGUAGES)
    return filter_language(d.select("doc_id", "lang").join(found, "doc_id", "left")).select("doc_id", "lang", "detected_lang")


@query(
    "t17_to_vectors",
    "docs trimmed",
    """WITH v AS (SELECT term, row_number() OVER (ORDER BY ('0x' || substr(md5(term), 1, 8))::BIGINT, term) - 1 AS idx, count(*) OVER () AS size FROM (SELECT DISTINCT term FROM trimmed) t)
       SELECT d.doc_id, CAST((SELECT any_value(size) FROM v) AS INT) AS size, CAST(v.idx AS INT) AS idx, t.n::DOUBLE AS value
       FROM docs d LEFT JOIN trimmed t USING (doc_id) LEFT JOIN v USING (term)""",
)
def _(x):
    """The cells of all vectors, read off the lists a vector is stored as; an empty vector is one row without a cell."""
    feats = cut_lineage(trimmed(x), "features")
    index = term_index(tokens.vocabulary(feats))
    vectors = to_vectors(feats, index, x.table("documents").select("doc_id")).select("doc_id", F.unwrap_udt("features").alias("v"))
    cells = vectors.select("doc_id", "v.size", F.explode_outer(F.arrays_zip("v.indices", "v.values")).alias("c"))
    return cells.select("doc_id", "size", F.col("c.indices").alias("idx"), F.col("c.values").alias("value"))
