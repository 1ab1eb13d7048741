"""Queries over ratings: complete designs, majority vote, agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyscribe.functions import nulls
from tallyscribe.operators import prep, raters
from tallyscribe.operators.merge import left_join
from tallyscribe.plans.fixtures import COMPLETE, RATERS, Inputs, register
from tallyscribe.plans.registry import query, rounded, s6
from tallyscribe.sources.storage import cut_lineage

M = len(COMPLETE)

register(
    "sized",
    f"SELECT *, (SELECT count(DISTINCT subject) FROM full_ratings)::DOUBLE AS n, {M}::DOUBLE AS m FROM full_ratings",
    "full_ratings",
)
register(
    "binary_ratings", "SELECT subject, rater, CASE WHEN rating > 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS rating FROM full_ratings", "full_ratings"
)
register(
    "squares",
    f"""SELECT n, m, msr, msc, (q - centre - ss / m + centre - rs / n + centre) / ((n - 1) * (m - 1)) AS mse FROM (
          SELECT n, m, q, ss, rs, t * t / (n * m) AS centre, (ss / m - t * t / (n * m)) / (n - 1) AS msr,
            (rs / n - t * t / (n * m)) / (m - 1) AS msc FROM (
            SELECT count(DISTINCT subject)::DOUBLE AS n, {M}::DOUBLE AS m, sum(rating) AS t, sum(rating * rating) AS q,
              (SELECT sum(s * s) FROM (SELECT sum(rating) AS s FROM full_ratings GROUP BY subject) a) AS ss,
              (SELECT sum(s * s) FROM (SELECT sum(rating) AS s FROM full_ratings GROUP BY rater) b) AS rs FROM full_ratings) c) d""",
    "full_ratings",
)


def _r(x: Inputs):
    return raters.ratings_of(x.ratings(), COMPLETE, "subject", "rater", "scale")


def fleiss_sql(frm: str, digits: int = 6) -> str:
    return f"""SELECT round((pa - pe) / (1 - pe), {digits}) + 0.0 AS value FROM (SELECT
        (SELECT (sum(nij * nij) - n * m) / (n * m * (m - 1)) FROM (SELECT count(*)::DOUBLE AS nij FROM {frm} GROUP BY subject, rating) a, z GROUP BY n, m) AS pa,
        (SELECT sum(p * p - v / (m - 1)) FROM (SELECT rating, sum(c / n) / any_value(m) AS p,
            sum(c * c / (n * n)) / any_value(m) - (sum(c / n) / any_value(m)) * (sum(c / n) / any_value(m)) AS v, any_value(m) AS m
          FROM (SELECT rating, rater, count(*)::DOUBLE AS c FROM {frm} GROUP BY rating, rater) b, z GROUP BY rating) e) AS pe) f"""


def light_sql(frm: str, digits: int = 6) -> str:
    return f"""SELECT round(avg(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END), {digits}) + 0.0 AS value FROM (
        SELECT a.r, a.s, a.po, e.pe FROM
          (SELECT x.rater AS r, y.rater AS s, avg(CASE WHEN x.rating = y.rating THEN 1.0::DOUBLE ELSE 0.0 END) AS po
             FROM {frm} x JOIN {frm} y ON x.subject = y.subject AND x.rater < y.rater GROUP BY 1, 2) a
          JOIN (SELECT p.rater AS r, q.rater AS s, sum(p.c * q.c / (n * n)) AS pe FROM
             (SELECT rater, rating, count(*)::DOUBLE AS c FROM {frm} GROUP BY 1, 2) p
             JOIN (SELECT rater, rating, count(*)::DOUBLE AS c FROM {frm} GROUP BY 1, 2) q ON p.rating = q.rating AND p.rater < q.rater, z
             GROUP BY 1, 2) e ON a.r = e.r AND a.s = e.s) t"""


def icc_sql(digits: int = 6) -> str:
    return f"SELECT round((msr - mse) / (msr + (msc - mse) / n), {digits}) + 0.0 AS value FROM squares"


def kendall_sql(digits: int = 6) -> str:
    return f"""SELECT round(12 * dev / (m * m * (n * n * n - n) - m * ties), {digits}) + 0.0 AS value FROM (SELECT
        (SELECT sum((s - mu) * (s - mu)) FROM (SELECT s, avg(s) OVER () AS mu FROM (SELECT subject, sum(rk) AS s FROM (
           SELECT subject, rank() OVER (PARTITION BY rater ORDER BY rating) + (count(*) OVER (PARTITION BY rater, rating) - 1) / 2.0::DOUBLE AS rk
           FROM full_ratings) a GROUP BY subject) b) c) AS dev,
        (SELECT sum(t * t * t - t) FROM (SELECT count(*)::DOUBLE AS t FROM full_ratings GROUP BY rater, rating) d) AS ties, n, m FROM z) e"""


def alpha_sql(digits: int = 6) -> str:
    return f"""SELECT round({M} / ({M} - 1.0::DOUBLE) * (1 - (SELECT sum(v) FROM (SELECT var_samp(rating) AS v FROM full_ratings GROUP BY rater) a)
        / (SELECT var_samp(s) FROM (SELECT sum(rating) AS s FROM full_ratings GROUP BY subject) b)), {digits}) + 0.0 AS value"""


def percent_sql(frm: str, tol: int, digits: int = 6) -> str:
    return f"""SELECT round(100 * avg(CASE WHEN d <= {tol} THEN 1.0::DOUBLE ELSE 0.0 END), {digits}) + 0.0 AS value FROM
        (SELECT max(rating) - min(rating) AS d FROM {frm} GROUP BY subject) t"""


Z = f"WITH z AS (SELECT count(DISTINCT subject)::DOUBLE AS n, {M}::DOUBLE AS m FROM full_ratings) "


# ---- votes and tables --------------------------------------------------------------------


@query(
    "a1_complete_raters",
    "ratings",
    "SELECT rater, count(*) AS n_items FROM ratings GROUP BY rater HAVING count(*) = (SELECT count(*) FROM labels)",
)
def _(x):
    n = x.table("labels").count()
    return raters.complete_raters(x.ratings(), n)


@query(
    "a2_majority_vote",
    "ratings raters",
    """SELECT subject, gender, CAST(round_even(median(scale), 0) AS DOUBLE) AS scale,
         CAST(round_even(median(CASE WHEN scale > 1 THEN 1 WHEN scale = 1 THEN 0 END), 0) AS DOUBLE) AS binary FROM (
         SELECT subject, 'all' AS gender, scale FROM ratings UNION ALL
         SELECT subject, gender, scale FROM ratings JOIN raters USING (rater) UNION ALL
         SELECT subject, native, scale FROM ratings JOIN raters USING (rater) UNION ALL
         SELECT subject, native || lower(gender), scale FROM ratings JOIN raters USING (rater)) t GROUP BY subject, gender""",
)
def _(x):
    rated = left_join(x.ratings(), x.raters(), "rater").withColumn(
        "binary", F.when(F.col("scale") > 1, 1).when(F.col("scale") == 1, 0)
    )
    both = [(n, g) for n in ("native", "nonnative") for g in ("Female", "Male")]
    groups = {
        "all": F.lit("all"),
        "gender": F.col("gender"),
        "native": F.col("native"),
        "both": nulls.cross_label(F.col("native"), F.col("gender"), both),
    }
    # The four votes read the ratings once: each rating is tagged with the groups it belongs to.
    tagged = rated.select("subject", "scale", "binary", F.explode(F.array(*groups.values())).alias("gender"))
    return raters.majority_vote(
        tagged, ["subject", "gender"], ["scale", "binary"], levels={"scale": range(1, 6), "binary": (0, 1)}
    )


@query(
    "a3_crosstab_na",
    "ratings raters",
    "SELECT gender, coalesce(CAST(scale AS VARCHAR), 'NA') AS scale, count(*) AS n FROM ratings JOIN raters USING (rater) GROUP BY 1, 2",
)
def _(x):
    table = raters.crosstab_na(left_join(x.ratings(), x.raters(), "rater"), "gender", "scale")
    return table.select("gender", F.coalesce(F.col("scale").cast("string"), F.lit("NA")).alias("scale"), "n")


@query("j1_join_raters", "ratings raters", "SELECT r.subject, r.rater, r.scale, d.gender, d.native FROM ratings r LEFT JOIN raters d USING (rater)")
def _(x):
    return left_join(x.ratings(), x.raters(), "rater").select("subject", "rater", "scale", "gender", "native")


@query(
    "c8_cross_label",
    "ratings raters",
    "SELECT subject, rater, native || lower(gender) AS demographic FROM ratings JOIN raters USING (rater)",
)
def _(x):
    both = [(n, g) for n in ("native", "nonnative") for g in ("Female", "Male")]
    rated = left_join(x.ratings(), x.raters(), "rater")
    return rated.select("subject", "rater", nulls.cross_label(F.col("native"), F.col("gender"), both).alias("demographic"))


@query(
    "j2_attach_text",
    "ratings",
    """WITH a AS (SELECT r.subject, r.rater, r.scale, d.lang || ' seen by ' || CAST(r.rater AS VARCHAR) AS text,
           'batch ' || CAST(r.subject % 3 AS VARCHAR) AS batch FROM ratings r JOIN documents d ON r.subject = d.doc_id
           WHERE r.scale IS NOT NULL)
       SELECT v.subject, v.scale, t.text, t.batch FROM
         (SELECT subject, CAST(round_even(median(scale), 0) AS DOUBLE) AS scale FROM ratings GROUP BY subject) v
         LEFT JOIN (SELECT subject, arg_min(text, rater) AS text, arg_min(batch, rater) AS batch FROM a GROUP BY subject) t USING (subject)""",
)
def _(x):
    ratings = x.ratings()
    seen = ratings.where(F.col("scale").isNotNull()).join(
        x.table("documents").select(F.col("doc_id").alias("subject"), "lang"), "subject"
    )
    shown = seen.select(
        "subject",
        "rater",
        F.concat("lang", F.lit(" seen by "), F.col("rater").cast("string")).alias("text"),
        F.concat(F.lit("batch "), (F.col("subject") % 3).cast("string")).alias("batch"),
    )
    return raters.attach_text(raters.majority_vote(ratings, ["subject"], ["scale"]), shown, "subject", "rater", ["text", "batch"])


@query("j8_semi_join", "ratings", "SELECT subject, rater, scale FROM ratings WHERE rater IN (SELECT rater FROM ratings GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM labels))")
def _(x):
    return raters.keep_complete_raters(x.ratings(), x.table("labels").count()).select("subject", "rater", "scale")


@query(
    "x3_agg_numeric",
    "ratings",
    f"SELECT rater, {s6('avg(subject)', 'subject')}, {s6('avg(scale)', 'scale')} FROM ratings GROUP BY rater",
)
def _(x):
    return rounded(prep.agg_numeric(x.ratings(), ["rater"], F.avg), ["subject", "scale"])


@query(
    "p1_pivot_raters",
    "ratings",
    "SELECT subject, " + ", ".join(f"max(CASE WHEN rater = {k} THEN scale END) AS rater_{k}" for k in RATERS) + " FROM ratings GROUP BY subject",
)
def _(x):
    return raters.pivot_raters(x.ratings(), RATERS, rating="scale")


# ---- agreement ---------------------------------------------------------------------------


@query(
    "a4_percent_agreement",
    "full_ratings",
    "SELECT 0 AS tol, value FROM (" + percent_sql("full_ratings", 0) + ") a UNION ALL SELECT 1, value FROM (" + percent_sql("full_ratings", 1) + ") b",
)
def _(x):
    r = _r(x)
    out = raters.percent_agreement(r, 0).withColumn("tol", F.lit(0))
    return rounded(out.unionByName(raters.percent_agreement(r, 1).withColumn("tol", F.lit(1))).select("tol", "value"), ["value"])


@query("a5_fleiss_exact", "full_ratings", Z + fleiss_sql("full_ratings"))
def _(x):
    return rounded(raters.fleiss_exact(_r(x)), ["value"])


@query("a6_light_kappa", "full_ratings", Z + light_sql("full_ratings"))
def _(x):
    return rounded(raters.light_kappa(_r(x), COMPLETE), ["value"])


@query(
    "j10_rater_pairs",
    "full_ratings",
    """SELECT x.rater AS r, y.rater AS s, count(*) AS n, CAST(sum(CASE WHEN x.rating = y.rating THEN 1 ELSE 0 END) AS BIGINT) AS hit
       FROM full_ratings x JOIN full_ratings y ON x.subject = y.subject AND x.rater < y.rater GROUP BY 1, 2""",
)
def _(x):
    pairs = raters.pair_agreement(_r(x), COMPLETE)
    return pairs.select(F.col("pos").alias("r"), F.col("other").alias("s"), "n", "hit")


@query(
    "a7_fleiss_by_category",
    "sized",
    """SELECT rating AS category, round(1 - (m * s1 - s2) / (n * m * (m - 1) * p * (1 - p)), 6) + 0.0 AS value FROM (
         SELECT rating, sum(nij) AS s1, sum(nij * nij) AS s2, n, m, sum(nij) / (n * m) AS p FROM
           (SELECT subject, rating, n, m, count(*)::DOUBLE AS nij FROM sized GROUP BY ALL) a GROUP BY rating, n, m) b""",
)
def _(x):
    return rounded(raters.fleiss_by_category(_r(x)), ["value"])


@query("a8_icc", "squares", icc_sql())
def _(x):
    return rounded(raters.icc_a_k(_r(x)), ["value"])


@query(
    "a9_finn",
    "squares full_ratings",
    "SELECT round(1 - 12 * mse / (k * k - 1), 6) + 0.0 AS value FROM squares, (SELECT count(DISTINCT rating)::DOUBLE AS k FROM full_ratings) l",
)
def _(x):
    return rounded(raters.finn(_r(x)), ["value"])


@query("a10_kendall_w", "full_ratings", Z + kendall_sql())
def _(x):
    return rounded(raters.kendall_w(_r(x)), ["value"])


@query(
    "w7_avg_rank",
    "full_ratings",
    """SELECT subject, rater, rank() OVER (PARTITION BY rater ORDER BY rating) + (count(*) OVER (PARTITION BY rater, rating) - 1) / 2.0::DOUBLE AS rank
       FROM full_ratings""",
)
def _(x):
    return raters.avg_rank(_r(x)).select("subject", "rater", "rank")


@query("a11_cronbach_alpha", "full_ratings", alpha_sql())
def _(x):
    return rounded(raters.cronbach_alpha(_r(x)), ["value"])


@query("a11_cronbach_alpha_checked", "full_ratings", alpha_sql())
def _(x):
    # Raters 2 and 5 are turned round, so the check has something to reverse; then alpha is that of the ratings as they were.
    turned = _r(x).withColumn("rating", F.when(F.col("rater").isin(2, 5), 6 - F.col("rating")).otherwise(F.col("rating")))
    return rounded(raters.cronbach_alpha_checked(turned, COMPLETE), ["value"])


def _tables(x: Inputs):
    """Both tables from ratings stored once: a table reads them a dozen times."""
    r = cut_lineage(_r(x), "ratings")
    binary = r.withColumn("rating", F.when(F.col("rating") > 2, 1.0).otherwise(0.0))
    return [
        raters.agreement_table(binary, COMPLETE, "nominal", "nominal"),
        raters.agreement_table(r, COMPLETE, "scale", "scale"),
    ]


def _table_sql() -> str:
    rows = [
        ("nominal", "Agreement", percent_sql("binary_ratings", 0, 9)),
        ("nominal", "Fleiss kappa", fleiss_sql("binary_ratings", 9)),
        ("nominal", "Light kappa", light_sql("binary_ratings", 9)),
        ("scale", "Agreement", percent_sql("full_ratings", 1, 9)),
        ("scale", "ICC", icc_sql(9)),
        ("scale", "Kendall", kendall_sql(9)),
        ("scale", "Cronbach alpha", alpha_sql(9)),
    ]
    return " UNION ALL ".join(f"SELECT '{s}' AS scheme, '{m}' AS measure, round_even(value, 2) AS value FROM ({q}) t" for s, m, q in rows)


@query("a12_agreement_table", "full_ratings binary_ratings squares", Z + _table_sql())
def _(x):
    nominal, scale = _tables(x)
    return nominal.unionByName(scale)


@query(
    "j11_agreement_report",
    "full_ratings binary_ratings squares",
    Z + "SELECT measure, max(CASE WHEN scheme = 'nominal' THEN value END) AS nominal, max(CASE WHEN scheme = 'scale' THEN value END) AS scale FROM ("
    + _table_sql()
    + ") u GROUP BY measure",
)
def _(x):
    return raters.agreement_report(_tables(x), ["nominal", "scale"])
