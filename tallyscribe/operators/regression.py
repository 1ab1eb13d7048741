"""Least squares on Spark sums.

One pass takes means and spreads, a second the sums of products of the centred, scaled columns, a third the residuals
with the coefficients as literals; the k x k solve is all that happens on the driver. So columns far from zero keep
their digits. Columns that depend on earlier ones are left out and get no coefficient, and all factors use the rank.
Pass a stored frame if the rows are expensive to derive.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscribe.operators.skew import join_term_stats

INTERCEPT = "(intercept)"


def linear_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    """Simple regression: slope, intercept, r2, n and the standard error of the slope, one row."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    yy, xx = F.col(y).cast("double"), F.col(x).cast("double")
    fit = df.where(both).agg(
        F.regr_slope(yy, xx).alias("slope"),
        F.regr_intercept(yy, xx).alias("intercept"),
        F.when(F.regr_syy(yy, xx) > 0, F.regr_r2(yy, xx)).alias("r2"),
        F.count(F.lit(1)).alias("n"),
        F.regr_sxx(yy, xx).alias("_sxx"),
        F.regr_syy(yy, xx).alias("_syy"),
        F.regr_sxy(yy, xx).alias("_sxy"),
    )
    sse = F.greatest(F.col("_syy") - F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx")), F.lit(0.0))
    se = F.when(F.col("n") > 2, F.sqrt(F.try_divide(F.try_divide(sse, F.col("n") - 2), F.col("_sxx"))))
    return fit.select("slope", "intercept", "r2", "n", se.alias("se"))


def design(df: DataFrame, y: str, x: Sequence[str], factors: Mapping[str, tuple[str, Sequence[str]]] | None = None):
    """Response and regressors as double columns, factors as dummies, incomplete rows dropped.

    ``factors`` maps a column to (baseline, other levels). Returns the frame and the regressor names.
    """
    cols: dict[str, Column] = {c: F.col(c).cast("double") for c in x}
    for name, (_, levels) in (factors or {}).items():
        for level in levels:
            cols[f"{name}={level}"] = F.when(F.col(name).isNotNull(), (F.col(name) == F.lit(level)).cast("double"))
    keep = [c for c in df.columns]
    frame = df.select(*keep, F.col(y).cast("double").alias("_y"), *[v.alias(f"_x{i}") for i, v in enumerate(cols.values())])
    return frame.na.drop(subset=["_y"] + [f"_x{i}" for i in range(len(cols))]), list(cols)


def cross_products(frame: DataFrame, k: int, intercept: bool = True) -> DataFrame:
    """One row with n, y'y, X'y and the upper triangle of X'X."""
    xs = ([F.lit(1.0)] if intercept else []) + [F.col(f"_x{i}") for i in range(k)]
    y = F.col("_y")
    sums = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("s_y"), F.sum(y * y).alias("yy")]
    for i, a in enumerate(xs):
        sums.append(F.sum(a * y).alias(f"xy_{i}"))
        sums += [F.sum(a * xs[j]).alias(f"xx_{i}_{j}") for j in range(i, len(xs))]
    return frame.agg(*sums)


@dataclass
class Fit:
    """Coefficients with their covariance."""

    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    n: int
    df_resid: int
    r2: float

    def table(self, spark: SparkSession) -> DataFrame:
        """Table of estimate, standard error, t and two-sided p; NULL where there is none."""
        rows = []
        for i, name in enumerate(self.names):
            estimate, var = float(self.coef[i]), float(self.cov[i, i])
            se = math.sqrt(max(var, 0.0)) if math.isfinite(var) else None
            t = estimate / se if se else None
            p = t_two_sided(t, self.df_resid) if t is not None and self.df_resid > 0 else None
            r2 = float(self.r2) if math.isfinite(self.r2) else None
            rows.append((name, estimate if math.isfinite(estimate) else None, se, t, p, int(self.n), r2))
        return spark.createDataFrame(
            rows, "term string, estimate double, std_error double, t double, p double, n bigint, r2 double"
        )


def t_two_sided(t: float, df: int) -> float:
    """Two-sided p value of Student's t by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value = 1.0
    for m in range(200, 0, -1):  # evaluate the fraction from the far end
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        value = 1 + odd / (1 + even / value)
    beta = front / value
    return 1 - beta if swap else beta


ALIASED = 1e-10  # a column is left out if this share of its sum of squares, or less, is its own


@dataclass
class _Solved:
    """Least squares on the columns ``used``, in units of the centred and scaled columns."""

    used: list[int]
    inverse: np.ndarray
    coef: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    y_mean: float
    n: int
    syy: float


def _solve(frame: DataFrame, k: int, centre: bool) -> _Solved:
    """Solve for ``_y`` on ``_x0``, ``_x1`` ...; with ``centre`` there is an intercept, else the columns have mean zero."""
    cols = ["_y"] + [f"_x{i}" for i in range(k)]
    stats = frame.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}{c}") for c in cols for f in (F.avg, F.stddev_pop)]).first()
    n = stats["n"]
    mean = np.array([(stats[f"avg_x{i}"] or 0.0) if centre else 0.0 for i in range(k)])
    scale = np.array([stats[f"stddev_pop_x{i}"] or 1.0 for i in range(k)])
    y_mean = (stats["avg_y"] or 0.0) if centre else 0.0
    z = _scaled(k, mean, scale)
    y = F.col("_y") - F.lit(float(y_mean))
    sums = [F.sum(y * y).alias("yy")] + [F.sum(z[i] * y).alias(f"xy_{i}") for i in range(k)]
    sums += [F.sum(z[i] * z[j]).alias(f"m_{i}_{j}") for i in range(k) for j in range(i, k)]
    row = frame.agg(*sums).first()
    if not n:
        return _Solved([], np.zeros((0, 0)), np.zeros(0), mean, scale, y_mean, 0, 0.0)
    xx, xy = _symmetric(row, k), np.array([row[f"xy_{i}"] for i in range(k)])
    used: list[int] = []
    for i in range(k):
        if len(used) + centre >= n:
            break
        own = xx[i, i]
        if used:
            own -= xx[i, used] @ np.linalg.solve(xx[np.ix_(used, used)], xx[used, i])
        if own > ALIASED * max(xx[i, i], n * 1e-300) and stats[f"stddev_pop_x{i}"]:
            used.append(i)
    inverse = np.linalg.inv(xx[np.ix_(used, used)]) if used else np.zeros((0, 0))
    return _Solved(used, inverse, inverse @ xy[used], mean, scale, y_mean, n, row["yy"])


def _scaled(k: int, mean: np.ndarray, scale: np.ndarray) -> list[Column]:
    return [(F.col(f"_x{i}") - F.lit(float(mean[i]))) / F.lit(float(scale[i])) for i in range(k)]


def _residual(s: _Solved, z: list[Column]) -> Column:
    fitted = F.lit(float(s.y_mean))
    for b, i in zip(s.coef, s.used, strict=True):
        fitted = fitted + F.lit(float(b)) * z[i]
    return F.col("_y") - fitted


def _symmetric(row, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[f"m_{i}_{j}"] or 0.0
    return out


def _fit(s: _Solved, names: list[str], cov: np.ndarray, centre: bool, df_resid: int, r2: float) -> Fit:
    """Back to the columns' own units. ``cov`` belongs to (mean of y, scaled coefficients); left-out terms become NaN."""
    k, lead = len(s.scale), int(centre)
    back = np.zeros((k + lead, len(s.used) + lead))
    for at, i in enumerate(s.used):
        back[i + lead, at + lead] = 1 / s.scale[i]
        if centre:
            back[0, at + lead] = -s.mean[i] / s.scale[i]
    if centre:
        back[0, 0] = 1.0
    coef = back @ np.concatenate([[s.y_mean] * lead, s.coef])
    full = back @ cov @ back.T
    gone = [i + lead for i in range(k) if i not in s.used] + ([0] if centre and not s.n else [])
    coef[gone] = np.nan
    full[gone, :] = full[:, gone] = np.nan
    if df_resid <= 0:
        full[:] = np.nan
    return Fit(([INTERCEPT] if centre else []) + names, coef, full, s.n, df_resid, r2)


def ols(
    df: DataFrame,
    y: str,
    x: Sequence[str],
    factors: Mapping[str, tuple[str, Sequence[str]]] | None = None,
    cov: str | None = None,
) -> Fit:
    """Multiple regression with an intercept; ``cov='HC1'`` gives heteroskedasticity-robust errors.

    Columns without a part of their own (an unused level, a multiple of others) have no coefficient. With no more rows
    than coefficients there are no standard errors.
    """
    if cov not in (None, "HC1"):
        raise ValueError(f"unknown covariance {cov!r}")
    frame, names = design(df, y, x, factors)
    s = _solve(frame, len(names), centre=True)
    z = _scaled(len(names), s.mean, s.scale)
    rank = len(s.used) + 1
    terms = [F.lit(1.0)] + [z[i] for i in s.used]
    e2 = F.pow("_e", F.lit(2.0))
    sums = [F.sum(e2).alias("sse")]
    if cov == "HC1":
        sums += [F.sum(e2 * terms[i] * terms[j]).alias(f"m_{i}_{j}") for i in range(rank) for j in range(i, rank)]
    row = frame.withColumn("_e", _residual(s, z)).agg(*sums).first()
    sse, df_resid = row["sse"] or 0.0, s.n - rank
    bread = np.zeros((rank, rank))
    bread[0, 0] = 1 / max(s.n, 1)
    bread[1:, 1:] = s.inverse
    scale = 1 / df_resid if df_resid > 0 else float("nan")
    covariance = sse * scale * bread if cov is None else s.n * scale * bread @ _symmetric(row, rank) @ bread
    return _fit(s, names, covariance, True, df_resid, 1 - sse / s.syy if s.syy > 0 else float("nan"))


def demean(df: DataFrame, cols: Sequence[str], group: str) -> DataFrame:
    """Subtract the group mean. Means are pre-aggregated and joined back with hot groups salted."""
    means = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)]
    )
    joined = join_term_stats(df, means, group, "_n", spread=[c for c in df.columns if c != group])
    at = {c: i for i, c in enumerate(cols)}
    return joined.select([(F.col(c) - F.col(f"_m{at[c]}")).alias(c) if c in at else F.col(c) for c in df.columns])


def panel_within(
    df: DataFrame,
    y: str,
    x: Sequence[str],
    group: str,
    cluster: str | None = None,
    factors: Mapping[str, tuple[str, Sequence[str]]] | None = None,
) -> Fit:
    """Fixed-effects regression within ``group``, with errors clustered by ``cluster`` if given.

    The cluster covariance carries the factor G/(G-1) x (N-1)/(N-K).
    """
    frame, names = design(df.where(F.col(group).isNotNull()), y, x, factors)
    k = len(names)
    within = demean(frame, ["_y"] + [f"_x{i}" for i in range(k)], group)
    s = _solve(within, k, centre=False)
    z = _scaled(k, s.mean, s.scale)
    rank = len(s.used)
    scored = within.withColumn("_e", _residual(s, z))
    sse = scored.agg(F.sum(F.pow("_e", F.lit(2.0))).alias("sse")).first()["sse"] or 0.0
    groups = frame.agg(F.count_distinct(group).alias("g")).first()["g"]
    df_resid = s.n - groups - rank
    r2 = 1 - sse / s.syy if s.syy > 0 else float("nan")
    if cluster is None:
        return _fit(s, names, (sse / df_resid if df_resid > 0 else float("nan")) * s.inverse, False, df_resid, r2)
    scores = scored.groupBy(cluster).agg(*[F.sum(F.col("_e") * z[i]).alias(f"_s{at}") for at, i in enumerate(s.used)])
    sums = [F.sum(F.col(f"_s{i}") * F.col(f"_s{j}")).alias(f"m_{i}_{j}") for i in range(rank) for j in range(i, rank)]
    outer = scores.agg(F.count(F.lit(1)).alias("g"), *sums).first()
    g = outer["g"]
    scale = g / (g - 1) * (s.n - 1) / (s.n - rank) if g > 1 and s.n > rank else float("nan")
    return _fit(s, names, scale * s.inverse @ _symmetric(outer, rank) @ s.inverse, False, df_resid, r2)
