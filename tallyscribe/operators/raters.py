"""Raters: complete designs, majority vote, agreement statistics.

Ratings stay long, ``(subject, rater, rating)``. Each statistic is built from counts or sums that
combine map-side; nothing larger than a rater-by-rater table is ever gathered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscribe.functions.nulls import half_even
from tallyscribe.operators.skew import join_term_stats


def complete_raters(df: DataFrame, n: int, rater: str = "rater") -> DataFrame:
    """Raters with exactly ``n`` items."""
    return df.groupBy(rater).agg(F.count(F.lit(1)).alias("n_items")).where(F.col("n_items") == n)


def keep_complete_raters(df: DataFrame, n: int, rater: str = "rater") -> DataFrame:
    return df.join(complete_raters(df, n, rater).select(rater), rater, "left_semi")


def _median_of_levels(counts: str, levels: Sequence[int]) -> Column:
    """Median from an array of counts per level (ascending): the mean of the two middle answers."""
    below = [sum((F.element_at(counts, j + 1) for j in range(i + 1)), F.lit(0)) for i in range(len(levels))]
    n = below[-1]

    def at(position: Column) -> Column:
        out = F.lit(None).cast("double")
        for i in range(len(levels) - 1, -1, -1):
            out = F.when(below[i] >= position, F.lit(float(levels[i]))).otherwise(out)
        return out

    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor((n + 2) / 2))) / 2)


def majority_vote(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    digits: int = 0,
    levels: Mapping[str, Sequence[int]] | None = None,
) -> DataFrame:
    """Median of each column per key, missing answers ignored, rounded half to even.

    For a column whose possible answers are listed in ``levels`` the vote is one sum per answer, which
    stays in the hash aggregate with a fixed state per key; an answer that is not listed is an error.
    Other columns use the exact median aggregate, which keeps a counter per distinct value.
    """
    levels = {c: sorted(v) for c, v in (levels or {}).items()}
    aggs, out = [], []
    for c in cols:
        if c in levels:
            aggs.append(F.array(*[F.sum(F.when(F.col(c) == v, 1).otherwise(0)) for v in levels[c]]).alias(c))
            aggs.append(F.sum(F.when(F.col(c).isNotNull() & ~F.col(c).isin(*levels[c]), 1).otherwise(0)).alias(f"_bad_{c}"))
            problem = F.raise_error(F.lit(f"{c} has an answer that is not among its levels"))
            median = F.when(F.col(f"_bad_{c}") > 0, problem.cast("double")).otherwise(_median_of_levels(c, levels[c]))
            out.append(half_even(median, digits).alias(c))
        else:
            aggs.append(half_even(F.median(c), digits).alias(c))
            out.append(F.col(c))
    return df.groupBy(*keys).agg(*aggs).select(*keys, *out)


def crosstab_na(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two-way frequencies; a missing value is a category of its own."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def attach_text(consensus: DataFrame, annotations: DataFrame, key: str, rater: str, cols: Sequence[str]) -> DataFrame:
    """Give each consensus row the text and batch tag seen by its first rater."""
    first = annotations.groupBy(key).agg(F.min_by(F.struct(*cols), rater).alias("_t"))
    return consensus.join(first, key, "left").select(*consensus.columns, *[F.col(f"_t.{c}").alias(c) for c in cols])


def pivot_raters(df: DataFrame, raters: Sequence, subject: str = "subject", rater: str = "rater", rating: str = "rating") -> DataFrame:
    """One column per rater, for output."""
    wide = df.groupBy(subject).pivot(rater, list(raters)).agg(F.first(rating))
    return wide.select(subject, *[F.col(f"`{r}`").alias(f"rater_{r}") for r in raters])


# ---- agreement ---------------------------------------------------------------------------


def ratings_of(df: DataFrame, raters: Sequence, subject: str, rater: str, rating: str) -> DataFrame:
    """Subjects that every listed rater answered, as ``(subject, rater, rating)``.

    Rows with a missing answer leave with their whole subject, as all statistics below need complete rows.
    """
    known = df.where(F.col(rater).isin(*raters) & F.col(rating).isNotNull())
    full = known.groupBy(subject).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") == len(raters))
    return known.join(full.select(subject), subject, "left_semi").select(
        F.col(subject).alias("subject"), F.col(rater).alias("rater"), F.col(rating).cast("double").alias("rating")
    )


def _one(value: Column, name: str) -> Column:
    return value.cast("double").alias(name)


def percent_agreement(r: DataFrame, tol: int = 0) -> DataFrame:
    """Percent of subjects on which all raters are within ``tol``."""
    spread = r.groupBy("subject").agg((F.max("rating") - F.min("rating")).alias("d"))
    return spread.agg(_one(100 * F.avg(F.when(F.col("d") <= tol, 1.0).otherwise(0.0)), "value"))


def fleiss_exact(r: DataFrame) -> DataFrame:
    """Exact Fleiss kappa (Conger) from subject-category and rater-category counts."""
    per_subject = r.groupBy("subject", "rating").agg(F.count(F.lit(1)).alias("nij"))
    squares = per_subject.agg(F.sum(F.col("nij") * F.col("nij")).cast("double").alias("sq"))
    size = r.agg(F.count_distinct("subject").alias("n"), F.count_distinct("rater").alias("m"))
    by_rater = r.groupBy("rating", "rater").agg(F.count(F.lit(1)).alias("c"))
    # A rater who never uses a category has share 0 there, so second moments are sums over the shares seen.
    by_cat = by_rater.groupBy("rating").agg(
        F.sum("c").cast("double").alias("s1"), F.sum(F.col("c") * F.col("c")).cast("double").alias("s2")
    )
    moments = by_cat.agg(F.sum(F.col("s1") * F.col("s1")).alias("a"), F.sum("s2").alias("b"))
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    p_sq = F.col("a") / (n * n * m * m)
    var = F.col("b") / (n * n * m) - p_sq
    pa = (F.col("sq") - n * m) / (n * m * (m - 1))
    pe = p_sq - var / (m - 1)
    return _side_by_side(size, squares, moments).select(_one(F.try_divide(pa - pe, 1 - pe), "value"))


def fleiss_by_category(r: DataFrame) -> DataFrame:
    """Fleiss kappa of each category against the rest."""
    per_subject = r.groupBy("subject", "rating").agg(F.count(F.lit(1)).alias("nij"))
    size = r.agg(F.count_distinct("subject").alias("n"), F.count_distinct("rater").alias("m"))
    shape = size.select(F.struct("n", "m")).scalar()
    cats = per_subject.groupBy("rating").agg(
        F.sum("nij").cast("double").alias("s1"), F.sum(F.col("nij") * F.col("nij")).cast("double").alias("s2")
    ).withColumn("_z", shape)
    n, m = F.col("_z.n").cast("double"), F.col("_z.m").cast("double")
    p = F.col("s1") / (n * m)
    split = m * F.col("s1") - F.col("s2")
    kappa = 1 - F.try_divide(split, n * m * (m - 1) * p * (1 - p))
    return cats.select(F.col("rating").alias("category"), _one(kappa, "value"))


def _side_by_side(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Put one-row frames next to each other as scalar subqueries."""
    out = first
    for i, frame in enumerate(others):
        cols = frame.columns
        out = out.withColumn(f"_s{i}", frame.select(F.struct(*cols)).scalar())
        out = out.select("*", *[F.col(f"_s{i}.{c}").alias(c) for c in cols]).drop(f"_s{i}")
    return out


def _rows_of_all(r: DataFrame, raters: Sequence) -> DataFrame:
    """One row per subject: the ratings in the order of ``raters``."""
    each = [F.max(F.when(F.col("rater") == x, F.col("rating"))) for x in raters]
    return r.groupBy("subject").agg(F.array(*each).alias("all"))


def pair_agreement(r: DataFrame, raters: Sequence) -> DataFrame:
    """``(pos, other, n, hit)``: how often each pair of raters agrees, raters named by position.

    Agreements of one rater with each other rater are summed side by side, m rows of m sums per
    subject, so the pairs of a subject are never written out as rows.
    """
    m = len(raters)
    same = [F.sum(F.when(F.col("own") == F.element_at("all", s + 1), 1).otherwise(0)) for s in range(m)]
    return (
        _rows_of_all(r, raters)
        .select(F.posexplode("all").alias("pos", "own"), "all")
        .groupBy("pos")
        .agg(F.count(F.lit(1)).alias("n"), F.array(*same).alias("hits"))
        .select("pos", "n", F.posexplode("hits").alias("other", "hit"))
        .where(F.col("pos") < F.col("other"))
    )


def light_kappa(r: DataFrame, raters: Sequence) -> DataFrame:
    """Mean Cohen kappa over rater pairs."""
    m = len(raters)
    agree = pair_agreement(r, raters)
    index = F.create_map(*[x for i, k in enumerate(raters) for x in (F.lit(k), F.lit(i))])
    used = r.groupBy(index[F.col("rater")].alias("who"), "rating").agg(F.count(F.lit(1)).alias("c"))
    marginal = used.groupBy("rating").agg(
        F.array(*[F.coalesce(F.sum(F.when(F.col("who") == i, F.col("c"))), F.lit(0)) for i in range(m)]).alias("cs")
    )
    # Expected agreement per pair: again one row per rater and category, holding the products with all others.
    expected = (
        marginal.select(F.posexplode("cs").alias("pos", "c"), "cs")
        .groupBy("pos")
        .agg(F.array(*[F.sum(F.col("c").cast("double") * F.element_at("cs", s + 1)) for s in range(m)]).alias("es"))
        .select("pos", F.posexplode("es").alias("other", "e"))
        .where(F.col("pos") < F.col("other"))
    )
    n = F.col("n").cast("double")
    po, pe = F.col("hit") / n, F.col("e") / (n * n)
    pairs = agree.join(expected, ["pos", "other"]).select(F.try_divide(po - pe, 1 - pe).alias("k"))
    return pairs.agg(_one(F.avg("k"), "value"))


def _mean_squares(r: DataFrame) -> DataFrame:
    """One row: n, m and the mean squares of subjects, raters and residual."""
    subjects = r.groupBy("subject").agg(F.sum("rating").alias("s"))
    raters = r.groupBy("rater").agg(F.sum("rating").alias("s"))
    total = r.agg(F.sum("rating").alias("t"), F.sum(F.col("rating") * F.col("rating")).alias("q"))
    left = subjects.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"))
    right = raters.agg(F.count(F.lit(1)).cast("double").alias("m"), F.sum(F.col("s") * F.col("s")).alias("rs"))
    one = _side_by_side(left, right, total)
    n, m = F.col("n"), F.col("m")
    centre = F.col("t") * F.col("t") / (n * m)
    ssr, ssc = F.col("ss") / m - centre, F.col("rs") / n - centre
    sse = F.col("q") - centre - ssr - ssc
    return one.select(
        "n", "m", (ssr / (n - 1)).alias("msr"), (ssc / (m - 1)).alias("msc"), (sse / ((n - 1) * (m - 1))).alias("mse")
    )


def icc_a_k(r: DataFrame) -> DataFrame:
    """Intraclass correlation: two-way, agreement, average of the raters."""
    value = F.try_divide(F.col("msr") - F.col("mse"), F.col("msr") + (F.col("msc") - F.col("mse")) / F.col("n"))
    return _mean_squares(r).select(_one(value, "value"))


def finn(r: DataFrame, levels: int | None = None) -> DataFrame:
    """Finn coefficient, two-way; ``levels`` defaults to the number of distinct ratings."""
    k = F.lit(levels).cast("double") if levels else r.agg(F.count_distinct("rating").cast("double")).scalar()
    return _mean_squares(r).select(_one(1 - F.try_divide(12 * F.col("mse"), k * k - 1), "value"))


def avg_rank(r: DataFrame) -> DataFrame:
    """Rank of each rating within its rater, ties sharing the mean rank.

    Ranks come from the rater's counts per rating, so a rater with a third of all ratings is a few
    count rows and not one long sort.
    """
    counts = r.groupBy("rater", "rating").agg(F.count(F.lit(1)).alias("ties"))
    below = Window.partitionBy("rater").orderBy("rating").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select(
        "rater",
        "rating",
        "ties",
        (F.coalesce(F.sum("ties").over(below), F.lit(0)) + (F.col("ties") + 1) / F.lit(2.0)).alias("rank"),
    )
    key = F.struct("rater", "rating")
    ranks = ranks.select(key.alias("_key"), "ties", "rank")
    return join_term_stats(r.withColumn("_key", key), ranks, "_key", "ties", spread=["subject"]).drop("_key")


def kendall_w(r: DataFrame) -> DataFrame:
    """Kendall's coefficient of concordance with tie correction."""
    counts = r.groupBy("rater", "rating").agg(F.count(F.lit(1)).cast("double").alias("t"))
    ties = counts.agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"), F.count_distinct("rater").cast("double").alias("m"))
    sums = avg_rank(r).groupBy("subject").agg(F.sum("rank").alias("s"))
    one = _side_by_side(sums.agg(F.count(F.lit(1)).cast("double").alias("n"), F.var_pop("s").alias("v")), ties)
    n, m = F.col("n"), F.col("m")
    value = F.try_divide(12 * n * F.col("v"), m * m * (n * n * n - n) - m * F.col("ties"))
    return one.select(_one(value, "value"))


def cronbach_alpha(r: DataFrame) -> DataFrame:
    """Cronbach's alpha with the raters as items."""
    items = r.groupBy("rater").agg(F.var_samp("rating").alias("v"))
    sums = r.groupBy("subject").agg(F.sum("rating").alias("s"))
    one = _side_by_side(
        items.agg(F.sum("v").alias("vi"), F.count(F.lit(1)).cast("double").alias("m")), sums.agg(F.var_samp("s").alias("vs"))
    )
    m = F.col("m")
    return one.select(_one(m / (m - 1) * (1 - F.try_divide(F.col("vi"), F.col("vs"))), "value"))


def reversal_signs(r: DataFrame, raters: Sequence) -> list[int]:
    """+1 or -1 per rater: the sign of the rater's loading on the first principal component.

    Spark sums the m x m cross products; only that matrix reaches the driver.
    """
    m = len(raters)
    sums = (
        _rows_of_all(r, raters)
        .select(F.posexplode("all").alias("pos", "own"), "all")
        .groupBy("pos")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("own").alias("s"),
            F.array(*[F.sum(F.col("own") * F.element_at("all", j + 1)) for j in range(m)]).alias("xx"),
        )
        .orderBy("pos")
        .collect()
    )
    n = sums[0]["n"]
    s = np.array([row["s"] for row in sums])
    cov = np.array([row["xx"] for row in sums]) / n - np.outer(s, s) / n**2
    sd = np.sqrt(np.diag(cov))
    sd[sd == 0] = 1.0
    _, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    first = vectors[:, -1] * (1 if vectors[:, -1].sum() >= 0 else -1)
    return [1 if x >= -1e-12 else -1 for x in first]


def cronbach_alpha_checked(r: DataFrame, raters: Sequence) -> DataFrame:
    """Cronbach's alpha after reversing raters who answer against the common direction."""
    signs = dict(zip(raters, reversal_signs(r, raters), strict=True))
    against = [k for k, v in signs.items() if v < 0]
    if against:
        flipped = F.when(F.col("rater").isin(*against), -F.col("rating")).otherwise(F.col("rating"))
        r = r.withColumn("rating", flipped)
    return cronbach_alpha(r)


def agreement_table(r: DataFrame, raters: Sequence, kind: str, scheme: str, digits: int = 2) -> DataFrame:
    """Named measures of one rating scheme: ``(scheme, measure, value)``."""
    if kind == "nominal":
        parts = {
            "Agreement": percent_agreement(r, 0),
            "Fleiss kappa": fleiss_exact(r),
            "Light kappa": light_kappa(r, raters),
        }
    else:
        parts = {
            "Agreement": percent_agreement(r, 1),
            "ICC": icc_a_k(r),
            "Kendall": kendall_w(r),
            "Cronbach alpha": cronbach_alpha_checked(r, raters),
        }
    out = None
    for name, frame in parts.items():
        row = frame.select(F.lit(scheme).alias("scheme"), F.lit(name).alias("measure"), half_even(F.col("value"), digits).alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def agreement_report(tables: Sequence[DataFrame], schemes: Sequence[str]) -> DataFrame:
    """One row per measure, one column per rating scheme."""
    long = tables[0]
    for t in tables[1:]:
        long = long.unionByName(t)
    return long.groupBy("measure").pivot("scheme", list(schemes)).agg(F.first("value"))
