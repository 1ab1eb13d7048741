"""Agreement, regression and series statistics against NumPy or identities."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscribe.operators import raters, regression, series


def long(spark, matrix):
    rows = [(i, r, float(v)) for i, row in enumerate(matrix) for r, v in enumerate(row)]
    return spark.createDataFrame(rows, "subject int, rater int, rating double").cache()


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(3)
    base = rng.integers(1, 6, size=(40, 1))
    return np.clip(base + rng.integers(-1, 2, size=(40, 4)), 1, 5)


@pytest.fixture(scope="module")
def ratings(spark, matrix):
    return long(spark, matrix)


def value(df):
    return df.first()["value"]


def cohen(a, b):
    po = np.mean(a == b)
    pe = sum(np.mean(a == c) * np.mean(b == c) for c in set(a) | set(b))
    return po, pe


def test_light_kappa(ratings, matrix):
    pairs = [cohen(matrix[:, i], matrix[:, j]) for i, j in itertools.combinations(range(4), 2)]
    assert value(raters.light_kappa(ratings, range(4))) == pytest.approx(np.mean([(o - e) / (1 - e) for o, e in pairs]))


def test_fleiss_exact_is_the_pooled_pair_kappa(ratings, matrix):
    pairs = [cohen(matrix[:, i], matrix[:, j]) for i, j in itertools.combinations(range(4), 2)]
    po, pe = np.mean([o for o, _ in pairs]), np.mean([e for _, e in pairs])
    assert value(raters.fleiss_exact(ratings)) == pytest.approx((po - pe) / (1 - pe))


def test_category_kappas_average_to_fleiss(ratings, matrix):
    n, m = matrix.shape
    counts = np.array([[np.sum(row == c) for c in range(1, 6)] for row in matrix])
    p = counts.sum(0) / (n * m)
    pa = (np.sum(counts**2) - n * m) / (n * m * (m - 1))
    overall = (pa - np.sum(p**2)) / (1 - np.sum(p**2))
    kappas = {r.category: r.value for r in raters.fleiss_by_category(ratings).collect()}
    weights = p * (1 - p)
    assert sum(kappas[c + 1.0] * weights[c] for c in range(5)) / weights.sum() == pytest.approx(overall)


def mean_squares(x):
    n, m = x.shape
    grand = x.mean()
    msr = m * np.sum((x.mean(1) - grand) ** 2) / (n - 1)
    msc = n * np.sum((x.mean(0) - grand) ** 2) / (m - 1)
    mse = np.sum((x - x.mean(1, keepdims=True) - x.mean(0) + grand) ** 2) / ((n - 1) * (m - 1))
    return n, m, msr, msc, mse


def test_icc_finn_alpha(ratings, matrix):
    n, m, msr, msc, mse = mean_squares(matrix)
    assert value(raters.icc_a_k(ratings)) == pytest.approx((msr - mse) / (msr + (msc - mse) / n))
    assert value(raters.finn(ratings)) == pytest.approx(1 - 12 * mse / 24)
    assert value(raters.finn(ratings, 7)) == pytest.approx(1 - 12 * mse / 48)
    # alpha equals the consistency form of the intraclass correlation
    assert value(raters.cronbach_alpha(ratings)) == pytest.approx((msr - mse) / msr)


def test_alpha_reverses_contrary_raters(spark, ratings, matrix):
    turned = matrix.copy()
    turned[:, 2] = 6 - turned[:, 2]
    df = long(spark, turned)
    assert raters.reversal_signs(df, range(4)) == [1, 1, -1, 1]
    assert value(raters.cronbach_alpha_checked(df, range(4))) == pytest.approx(value(raters.cronbach_alpha(ratings)))


def test_kendall(spark):
    same = long(spark, [[v] * 3 for v in (1, 2, 2, 4, 5)])
    assert value(raters.kendall_w(same)) == pytest.approx(1.0)
    rng = np.random.default_rng(8)
    ranks = np.array([rng.permutation(10) for _ in range(3)]).T
    rho = np.mean([np.corrcoef(ranks[:, i], ranks[:, j])[0, 1] for i, j in itertools.combinations(range(3), 2)])
    assert value(raters.kendall_w(long(spark, ranks))) == pytest.approx((rho * 2 + 1) / 3)


def test_perfect_agreement_and_single_category(spark):
    perfect = long(spark, [[v] * 3 for v in (1, 2, 3)])
    assert value(raters.fleiss_exact(perfect)) == pytest.approx(1.0)
    assert value(raters.light_kappa(perfect, range(3))) == pytest.approx(1.0)
    assert value(raters.percent_agreement(perfect)) == 100.0
    single = long(spark, [[2] * 3 for _ in range(4)])
    assert value(raters.fleiss_exact(single)) is None
    assert value(raters.light_kappa(single, range(3))) is None


def test_ratings_of_drops_incomplete_subjects(spark):
    rows = [(1, 0, 1), (1, 1, 2), (2, 0, 1), (2, 1, None), (3, 0, 1), (4, 0, 1), (4, 1, 1), (4, 9, 5)]
    df = spark.createDataFrame(rows, "s int, r int, v int")
    got = raters.ratings_of(df, [0, 1], "s", "r", "v").collect()
    assert sorted({x.subject for x in got}) == [1, 4] and len(got) == 4


def test_majority_vote(spark):
    rows = [("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", None), ("c", 4), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = {r.k: r.v for r in raters.majority_vote(df, ["k"], ["v"]).collect()}
    assert got == {"a": 2.0, "b": 2.0, "c": 4.0, "d": None}


def test_vote_by_levels_equals_median(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), None if v == 0 else int(v)) for k, v in zip(rng.integers(0, 60, 500), rng.integers(0, 6, 500), strict=True)]
    df = spark.createDataFrame([*rows, (99, None)], "k int, v int")
    plain = raters.majority_vote(df, ["k"], ["v"])
    counted = raters.majority_vote(df, ["k"], ["v"], levels={"v": [5, 3, 1, 2, 4]})
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, counted.collect()))


def test_unlisted_answer_is_an_error(spark):
    df = spark.createDataFrame([("a", 1), ("a", 7)], "k string, v int")
    with pytest.raises(Exception, match="not among its levels"):
        raters.majority_vote(df, ["k"], ["v"], levels={"v": [1, 2, 3]}).collect()


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(11)
    n = 200
    x = rng.normal(size=(n, 2))
    g = rng.integers(0, 6, size=n)
    y = 1.5 + x @ np.array([2.0, -1.0]) + g + rng.normal(size=n) * (1 + np.abs(x[:, 0]))
    kind = rng.choice(["base", "p", "q"], size=n)
    rows = [(float(a), float(b), float(c), int(d), str(k)) for (a, b), c, d, k in zip(x, y, g, kind, strict=True)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 1, "base")], "a double, b double, y double, g int, kind string").cache()
    return df, x, y, g, kind


def hc1(design, y):
    n, k = design.shape
    inv = np.linalg.inv(design.T @ design)
    b = inv @ design.T @ y
    e = y - design @ b
    return b, inv, e, n / (n - k) * inv @ (design.T * e**2) @ design @ inv


def test_ols_with_factors(sample):
    df, x, y, _, kind = sample
    design = np.column_stack([np.ones(len(y)), x, kind == "p", kind == "q"]).astype(float)
    b, inv, e, robust = hc1(design, y)
    n, k = design.shape
    plain = regression.ols(df, "y", ["a", "b"], {"kind": ("base", ["p", "q"])})
    assert plain.n == 200 and plain.names == ["(intercept)", "a", "b", "kind=p", "kind=q"]
    np.testing.assert_allclose(plain.coef, b)
    np.testing.assert_allclose(plain.cov, e @ e / (n - k) * inv)
    assert plain.r2 == pytest.approx(1 - e @ e / np.sum((y - y.mean()) ** 2))
    np.testing.assert_allclose(regression.ols(df, "y", ["a", "b"], {"kind": ("base", ["p", "q"])}, cov="HC1").cov, robust)


def test_panel(sample):
    df, x, y, g, _ = sample
    dummies = np.array([g == k for k in range(6)]).T.astype(float)
    full = np.column_stack([x, dummies])
    b = np.linalg.lstsq(full, y, rcond=None)[0][:2]
    fit = regression.panel_within(df, "y", ["a", "b"], "g", cluster="g")
    np.testing.assert_allclose(fit.coef, b)
    xd = x - np.array([x[g == k].mean(0) for k in g])
    e = (y - np.array([y[g == k].mean() for k in g])) - xd @ b
    inv = np.linalg.inv(xd.T @ xd)
    scores = np.array([(xd[g == k] * e[g == k, None]).sum(0) for k in range(6)])
    n = len(y)
    np.testing.assert_allclose(fit.cov, 6 / 5 * (n - 1) / (n - 2) * inv @ scores.T @ scores @ inv)


@pytest.mark.parametrize(("t", "df", "p"), [(2.228, 10, 0.05), (0.0, 5, 1.0), (1.96, 100000, 0.05), (12.706, 1, 0.05), (0.7, 10, 0.4998)])
def test_t_distribution(t, df, p):
    assert regression.t_two_sided(t, df) == pytest.approx(p, abs=2e-4)


def test_linear_fit_of_constant_has_no_r2(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0), (None, 5.0)], "x double, y double")
    row = regression.linear_fit(df, "y", "x").first()
    assert (row.slope, row.intercept, row.r2, row.n) == (0.0, 2.0, None, 3)


def test_series_identities(spark):
    rows = [(f"2024-01-{d:02d}", 1 + d % 3, 2 + d % 5) for d in range(1, 15)]
    daily = spark.createDataFrame(rows, "d string, a int, b int").select(F.to_date("d").alias("date"), "a", "b")
    assert all(math.isclose(r.a + r.b, 1.0) for r in series.compose(daily, ["a", "b"]).collect())
    off = series.share_deviation(daily, ["a", "b"]).groupBy("type").agg(F.avg("freq").alias("m")).collect()
    assert all(abs(r.m) < 1e-12 for r in off)
    moved = series.share_change(daily, ["a", "b"]).groupBy("date").agg(F.sum("freq").alias("s")).collect()
    assert all(r.s is None or abs(r.s) < 1e-12 for r in moved)


def test_strict_day_is_missing(spark):
    rows = [("2024-01-01", 1, 2, 1.0), ("2024-01-01", 0, None, 2.0), ("2024-01-02", 1, 3, 1.0)]
    df = spark.createDataFrame(rows, "d string, flag int, scale int, scale_m double").withColumn("date", F.to_date("d"))
    loose = {str(r.date): r for r in series.daily_counts(df).collect()}
    strict = {str(r.date): r for r in series.daily_counts(df, strict=True).collect()}
    assert loose["2024-01-01"].mean_scale == 2.0 and loose["2024-01-01"].n_missing == 1
    assert strict["2024-01-01"].mean_scale is None and strict["2024-01-01"].positives == 1
    assert strict["2024-01-02"].mean_scale == 3.0


def test_calendar_collect(spark):
    daily = spark.sql("SELECT DATE '2024-01-01' AS date, 5 AS n UNION ALL SELECT DATE '2024-01-02', 6")
    cal = spark.sql("SELECT DATE '2024-01-01' AS date, 'b' AS incident, 'x' AS category UNION ALL SELECT DATE '2024-01-01', 'a', 'y'")
    assert series.join_calendar(daily, cal).count() == 3
    first = {str(r.date): r.incident for r in series.join_calendar(daily, cal, collect="first").collect()}
    assert first == {"2024-01-01": "a", "2024-01-02": None}
    assert series.join_calendar(daily, cal, collect="list").count() == 2


def test_lead_lag_over_a_gap(spark):
    daily = spark.sql("SELECT DATE '2024-01-01' AS date, 5 AS n UNION ALL SELECT DATE '2024-01-03', 6")
    rows = series.with_lead_lag(daily, "n").orderBy("date").collect()
    assert rows[0].next_n == 6 and rows[1].prev_n == 5
    rows = series.with_lead_lag(daily, "n", calendar=True).orderBy("date").collect()
    assert rows[0].next_n is None and rows[1].prev_n is None


def test_least_squares_keeps_digits_and_rank(spark):
    """Shifted columns give the same slopes; unused levels and multiples get no coefficient and cost no degree of freedom."""
    import numpy as np

    from tallyscribe.operators import regression

    rng = np.random.default_rng(8)
    x, e = rng.normal(0, 1, 30), rng.normal(0, 1, 30)
    rows = [(float(a), float(a + 1.7e9), float(2 * a), float(1 + 0.5 * a + b), "u" if k % 2 else "v", k % 5) for k, (a, b) in enumerate(zip(x, e))]
    df = spark.createDataFrame(rows, "x double, far double, twice double, y double, f string, g int")
    plain, far = (regression.ols(df, "y", [c], cov="HC1") for c in ("x", "far"))
    assert np.allclose(plain.coef[1], far.coef[1], rtol=1e-5) and np.allclose(plain.cov[1, 1], far.cov[1, 1], rtol=1e-5)
    design = np.column_stack([np.ones(30), x])
    beta = np.linalg.lstsq(design, np.array([r[3] for r in rows]), rcond=None)[0]
    assert np.allclose(plain.coef, beta)
    double = regression.ols(df, "y", ["x", "twice"], {"f": ("u", ["v", "never"])})
    single = regression.ols(df, "y", ["x"], {"f": ("u", ["v"])})
    assert double.df_resid == single.df_resid == 27 and np.isnan(double.coef[[2, 4]]).all()
    assert np.allclose(double.coef[[0, 1, 3]], single.coef) and np.allclose(double.cov[1, 1], single.cov[1, 1])
    assert double.table(spark).where("estimate IS NULL AND std_error IS NULL").count() == 2
    tiny = regression.ols(df.limit(2), "y", ["x"])
    assert tiny.table(spark).where("std_error IS NOT NULL").count() == 0
    panel, moved = (regression.panel_within(df, "y", [c], "g", cluster="g") for c in ("x", "far"))
    assert np.allclose(panel.coef, moved.coef, rtol=1e-5) and np.allclose(panel.cov, moved.cov, rtol=1e-4)


def test_naive_bayes_leaves_out_classes_that_never_occur(spark):
    from tallyscribe.operators import bayes

    counts = spark.createDataFrame([(1, "a", 90), (1, "b", 10), (2, "b", 95), (2, "a", 5), (3, "a", 3), (4, "b", 3)], "doc_id long, term string, n long")
    labels = spark.createDataFrame([(1, 1), (2, 2)], "doc_id long, y int")
    model = bayes.nb_fit(counts, labels, [1, 2, 3, 4, 5])
    got = bayes.nb_predict(model, counts, spark.createDataFrame([(3,), (4,)], "doc_id long"))
    assert {r.doc_id: r.yhat for r in got.collect()} == {3: 1, 4: 2}


def test_draws_on_text_ids_and_pairs(spark):
    """Text ids work like numbers; folds of copies do not depend on partitions; copies leave one task."""
    from tallyscribe.operators import sampling

    df = spark.createDataFrame([(f"p{k}", k % 2 if k else 7, "s") for k in range(200)], "doc_id string, y int, s string")
    assert sampling.stratified_sample(df, ["s"], 0.3, "doc_id").count() == 60
    train, test = sampling.train_test_split(df, "doc_id")
    assert train.count() + test.count() == 200 and 130 < train.count() < 190
    up = sampling.upsample(df, "y", "doc_id")
    assert {r["count"] for r in up.groupBy("y").count().collect()} == {100}
    pairs = spark.range(400).selectExpr("id % 100 * 7919 AS doc_id", "cast(id DIV 100 AS int) AS copy_no", "cast(id % 2 AS int) AS y")
    folds = [sorted(map(tuple, sampling.assign_folds(pairs.repartition(n), "y", ["doc_id", "copy_no"], 5).collect())) for n in (1, 5, 8)]
    assert folds[0] == folds[1] == folds[2]
    big = spark.range(50_001).selectExpr("id AS doc_id", "cast(id = 0 AS int) AS y")
    parts = sampling.upsample(big, "y", "doc_id").where("y = 1").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == 50_000 and len(parts) > 1
