"""Queries over posts: daily series, windows on days, calendars, regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyscribe.functions.nulls import share
from tallyscribe.operators import prep, regression, series
from tallyscribe.operators.prep import date_slice, incident_features, positive_posts
from tallyscribe.plans.fixtures import FLAGS, LANGUAGE, SUBJECTS, TYPES, Inputs, register
from tallyscribe.plans.fit_sql import coefficients
from tallyscribe.plans.registry import query, r6, rounded, s6
from tallyscribe.sources.storage import cut_lineage

ALL_FLAGS = list(FLAGS)
CATEGORIES = ["events", "action other", "action subject"]

register(
    "daily_scale",
    """SELECT date, scale, count(*) AS n_positive, avg(scale_m) AS mean_scale_m FROM positive_posts GROUP BY date, scale""",
    "positive_posts",
)
register("daily_events", "SELECT d.*, c.incident, c.category FROM daily d LEFT JOIN calendar c USING (date)", "daily", "calendar")
register(
    "lagged",
    """SELECT date, positives, lead(positives) OVER (ORDER BY date) AS next_positives,
       lag(positives) OVER (ORDER BY date) AS prev_positives FROM daily""",
    "daily",
)


def _daily(x: Inputs):
    return series.daily_counts(x.posts())


def _daily_cat(x: Inputs):
    return series.daily_categories(x.posts(), ALL_FLAGS)


# ---- aggregates --------------------------------------------------------------------------


@query(
    "a13_daily_counts",
    "posts",
    f"""SELECT date, CAST(sum(flag) AS BIGINT) AS positives, CAST(count(*) - sum(flag) AS BIGINT) AS negatives,
        count(*) AS total, {s6("avg(scale_m)", "mean_scale_m")}, {s6("avg(scale)", "mean_scale")},
        CAST(sum(CASE WHEN scale IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
        {s6("CAST(sum(flag) AS DOUBLE) / count(*)", "positive_share")} FROM posts GROUP BY date""",
)
def _(x):
    return rounded(_daily(x), ["mean_scale_m", "mean_scale", "positive_share"])


@query(
    "a13_daily_counts_strict",
    "posts",
    f"""SELECT date, CAST(sum(flag) AS BIGINT) AS positives, count(*) AS total,
        CASE WHEN count(scale) = count(*) THEN round(avg(scale), 6) + 0.0 END AS mean_scale,
        {s6("avg(scale_m)", "mean_scale_m")} FROM posts GROUP BY date""",
)
def _(x):
    strict = series.daily_counts(x.posts(), strict=True).select("date", "positives", "total", "mean_scale", "mean_scale_m")
    return rounded(strict, ["mean_scale", "mean_scale_m"])


@query(
    "a14_daily_positive",
    "positive_posts",
    f"""SELECT date, CAST(NULL AS INT) AS scale, count(*) AS n_positive, {s6("avg(scale_m)", "mean_scale_m")}
        FROM positive_posts GROUP BY date
        UNION ALL SELECT date, coalesce(scale, -1), count(*), round(avg(scale_m), 6) + 0.0 FROM positive_posts GROUP BY date, scale""",
)
def _(x):
    posts = x.posts()
    day = series.daily_positive(posts).withColumn("scale", F.lit(None).cast("int"))
    by_scale = series.daily_positive(posts, by=["date", "scale"]).withColumn("scale", F.coalesce("scale", F.lit(-1)))
    return rounded(day.unionByName(by_scale).select("date", "scale", "n_positive", "mean_scale_m"), ["mean_scale_m"])


@query(
    "a15_daily_category_sums",
    "positive_posts",
    "SELECT date, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in FLAGS) + " FROM positive_posts GROUP BY date",
)
def _(x):
    return series.daily_category_sums(x.posts(), ALL_FLAGS)


@query(
    "a16_mean_daily_share",
    "daily_cat",
    "SELECT " + ", ".join(s6(f"avg({c} * 1.0::DOUBLE / n_positive)", c) for c in FLAGS) + " FROM daily_cat",
)
def _(x):
    return rounded(series.mean_daily_share(_daily_cat(x), ALL_FLAGS, "n_positive"), ALL_FLAGS)


@query(
    "a17_totals_table",
    "daily",
    f"""SELECT 'positives' AS series, CAST(sum(positives) AS BIGINT) AS frequency,
          {s6("avg(positives * 1.0::DOUBLE / total)", "mean_share")} FROM daily
        UNION ALL SELECT 'negatives', CAST(sum(negatives) AS BIGINT), round(avg(negatives * 1.0::DOUBLE / total), 6) + 0.0 FROM daily
        UNION ALL SELECT 'total', CAST(sum(total) AS BIGINT), 1.0 FROM daily""",
)
def _(x):
    return rounded(series.totals_table(_daily(x)), ["mean_share"])


@query(
    "a18_engagement_by_label",
    "posts",
    f"""SELECT flag, CAST(sum(flag) AS BIGINT) AS sum_flag, CAST(sum(reposts) AS BIGINT) AS sum_reposts, {s6("avg(reposts)", "mean_reposts")},
        CAST(sum(favourites) AS BIGINT) AS sum_favourites, {s6("avg(favourites)", "mean_favourites")} FROM posts GROUP BY flag""",
)
def _(x):
    return rounded(series.engagement_by_label(x.posts(), "flag", ["reposts", "favourites"]), ["mean_reposts", "mean_favourites"])


# ---- windows over days -------------------------------------------------------------------


@query("w1_lead_lag", "lagged", "SELECT date, positives, next_positives, prev_positives FROM lagged")
def _(x):
    return series.with_lead_lag(_daily(x).select("date", "positives"), "positives")


@query(
    "w1_lead_lag_calendar",
    "",
    """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS orders FROM orders GROUP BY 1)
       SELECT a.date, a.orders, n.orders AS next_orders, p.orders AS prev_orders FROM o a
       LEFT JOIN o n ON n.date = a.date + 1 LEFT JOIN o p ON p.date = a.date - 1""",
)
def _(x):
    daily = x.table("orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("orders"))
    return series.with_lead_lag(daily, "orders", calendar=True)


def _total(cols):
    return "(" + " + ".join(cols) + ")"


@query(
    "w2_share_change",
    "daily_cat",
    "WITH s AS (SELECT date, "
    + ", ".join(f"{c} * 1.0::DOUBLE / nullif({_total(TYPES)}, 0) AS {c}" for c in TYPES)
    + " FROM daily_cat) "
    + " UNION ALL ".join(f"SELECT date, '{c[3:]}' AS type, round({c} - lag({c}) OVER (ORDER BY date), 6) + 0.0 AS freq FROM s" for c in TYPES),
)
def _(x):
    return rounded(series.share_change(_daily_cat(x), TYPES, strip="^x3_"), ["freq"])


@query(
    "w3_share_deviation",
    "daily_cat",
    "WITH s AS (SELECT date, "
    + ", ".join(f"{c} * 1.0::DOUBLE / nullif({_total(SUBJECTS)}, 0) AS {c}" for c in SUBJECTS)
    + " FROM daily_cat) "
    + " UNION ALL ".join(f"SELECT date, '{c[3:]}' AS type, round({c} - avg({c}) OVER (), 6) + 0.0 AS freq FROM s" for c in SUBJECTS),
)
def _(x):
    return rounded(series.share_deviation(_daily_cat(x), SUBJECTS, strip="^x4_"), ["freq"])


@query(
    "w5_compose",
    "daily_cat",
    "SELECT date, " + ", ".join(s6(f"{c} * 1.0::DOUBLE / nullif({_total(TYPES)}, 0)", c) for c in TYPES) + " FROM daily_cat",
)
def _(x):
    return rounded(series.compose(_daily_cat(x).select("date", *TYPES), TYPES), TYPES)


@query(
    "w6_exclusive_count",
    "positive_posts",
    """SELECT date, x4_gender, x4_gender_age, x4_gender - x4_gender_age AS gender_only FROM (
         SELECT date, CAST(sum(x4_gender) AS BIGINT) AS x4_gender, CAST(sum(CASE WHEN x4_gender = 0 OR x4_age = 0 THEN 0
           WHEN x4_gender = 1 AND x4_age = 1 THEN 1 END) AS BIGINT) AS x4_gender_age FROM positive_posts GROUP BY date) t""",
)
def _(x):
    posts = prep.with_intersections(x.posts(), {"x4_gender_age": ("x4_gender", "x4_age")})
    sums = series.daily_category_sums(posts, ["x4_gender", "x4_gender_age"])
    return series.exclusive_count(sums, "x4_gender", "x4_gender_age", "gender_only")


@query(
    "w8_demean",
    "posts",
    f"""SELECT post_id, {s6("scale_m - avg(scale_m) OVER (PARTITION BY date)", "scale_m")},
        {s6("reposts - avg(reposts) OVER (PARTITION BY date)", "reposts")} FROM posts""",
)
def _(x):
    moved = regression.demean(x.posts().select("post_id", "date", "scale_m", "reposts"), ["scale_m", "reposts"], "date")
    return rounded(moved.select("post_id", "scale_m", "reposts"), ["scale_m", "reposts"])


# ---- filters, expressions and joins on the date ------------------------------------------


@query("f7_require_date", "posts", "SELECT post_id, date, scale FROM posts WHERE scale IS NOT NULL")
def _(x):
    return prep.require(x.posts().select("post_id", "date", "scale"), "scale")


@query("f12_date_slice", "daily", "SELECT date, positives, total FROM daily WHERE date >= DATE '2024-01-08' AND date < DATE '2024-01-22'")
def _(x):
    return _daily(date_slice_inputs(x)).select("date", "positives", "total")


def date_slice_inputs(x: Inputs):
    """The same inputs with the slice applied to the posts, where it can reach the scan."""

    class Sliced(Inputs):
        def posts(self):
            return date_slice(super().posts(), "2024-01-08", "2024-01-22")

    return Sliced(x.spark, x.dir)


@query(
    "f13_positive_posts",
    "posts",
    """SELECT post_id, 'ordered' AS rule FROM posts WHERE flag = 1 OR scale > 1 OR scale_m > 1
       UNION ALL SELECT post_id, 'ordinal' FROM posts WHERE flag = 1 OR scale <> 1 OR scale_m > 1""",
)
def _(x):
    posts = x.posts()
    a = positive_posts(posts).select("post_id", F.lit("ordered").alias("rule"))
    return a.unionByName(positive_posts(posts, ordinal=True).select("post_id", F.lit("ordinal").alias("rule")))


@query(
    "c13_date_parts",
    "daily",
    "SELECT date, total, CAST(day(date) AS INT) AS day, CAST(month(date) AS INT) AS month, CAST(year(date) AS INT) AS year FROM daily",
)
def _(x):
    return prep.with_date_parts(_daily(x).select("date", "total"))


@query(
    "c14_incident_features",
    "daily_events",
    """SELECT date, positives, incident, CASE WHEN incident IS NULL THEN 0 ELSE 1 END AS inc,
         coalesce(category, 'no incident') AS category,
         CASE category WHEN 'offline action other' THEN 'action other' WHEN 'online action other' THEN 'action other'
           WHEN 'offline action subject' THEN 'action subject' WHEN 'online action subject' THEN 'action subject'
           WHEN 'event' THEN 'events' ELSE 'no incident' END AS cattotal FROM daily_events""",
)
def _(x):
    return incident_features(series.join_calendar(_daily(x).select("date", "positives"), x.calendar()))


@query("c15_share", "daily", f"SELECT date, {s6('positives * 1.0::DOUBLE / nullif(total, 0)', 'positive_share')}, {s6('negatives * 1.0::DOUBLE / nullif(positives, 0)', 'ratio')} FROM daily")
def _(x):
    d = _daily(x)
    return d.select(
        "date", r6(share(F.col("positives"), F.col("total"))).alias("positive_share"), r6(share(F.col("negatives"), F.col("positives"))).alias("ratio")
    )


@query(
    "c16_log10",
    "daily",
    f"""SELECT date, CASE WHEN total > 0 THEN round(log10(total), 6) + 0.0 END AS log10_total,
        CASE WHEN positives > 0 THEN round(log10(positives), 6) + 0.0 END AS log10_positives FROM daily""",
)
def _(x):
    d = series.with_log10(_daily(x), ["total", "positives"])
    return rounded(d.select("date", "log10_total", "log10_positives"), ["log10_total", "log10_positives"])


@query(
    "j4_join_calendar",
    "daily calendar external_series",
    """SELECT d.date, d.positives, c.incident, c.category, e.pagecount FROM daily d LEFT JOIN calendar c USING (date)
       LEFT JOIN external_series e USING (date)""",
)
def _(x):
    days = series.join_calendar(_daily(x).select("date", "positives"), x.calendar())
    return days.join(x.external_series(), "date", "left")


@query(
    "j4_join_calendar_fanout",
    "daily calendar",
    """SELECT d.date, d.positives, c.incident FROM daily d LEFT JOIN
       (SELECT date, incident FROM calendar UNION ALL SELECT date, 'second ' || incident FROM calendar) c USING (date)""",
)
def _(x):
    c = x.calendar()
    twice = c.unionByName(c.withColumn("incident", F.concat(F.lit("second "), "incident")))
    return series.join_calendar(_daily(x).select("date", "positives"), twice).select("date", "positives", "incident")


@query(
    "j5_join_by_date_scale",
    "daily_cat daily_scale",
    f"""SELECT d.date, coalesce(s.scale, -1) AS scale, s.n_positive, {s6("s.mean_scale_m", "mean_scale_m")},
        d.x3_insult, d.x5_explicitlanguage FROM daily_cat d LEFT JOIN daily_scale s ON d.date = s.date""",
)
def _(x):
    posts = x.posts()
    sums = series.daily_category_sums(posts, ["x3_insult", "x5_explicitlanguage"])
    counts = series.daily_positive(posts, by=["date", "scale"])
    out = series.join_by_date_scale(sums, counts).withColumn("scale", F.coalesce("scale", F.lit(-1)))
    return rounded(out.select("date", "scale", "n_positive", "mean_scale_m", "x3_insult", "x5_explicitlanguage"), ["mean_scale_m"])


@query(
    "p2_unpivot",
    "daily_cat",
    " UNION ALL ".join(f"SELECT date, '{c[3:]}' AS type, {c} AS n FROM daily_cat" for c in TYPES),
)
def _(x):
    return prep.unpivot(_daily_cat(x), ["date"], TYPES, "type", "n", strip="^x3_")


@query(
    "c18_strip_prefix",
    "daily_cat",
    " UNION ALL ".join(f"SELECT '{c[3:]}' AS type, CAST(sum({c}) AS BIGINT) AS n FROM daily_cat" for c in SUBJECTS + LANGUAGE),
)
def _(x):
    long = prep.unpivot(_daily_cat(x), ["date"], SUBJECTS + LANGUAGE, "type", "n", strip="^x[45]_")
    return long.groupBy("type").agg(F.sum("n").alias("n"))


@query("o1_order", "daily", "SELECT date, positives, total FROM daily ORDER BY positives DESC, date")
def _(x):
    return _daily(x).select("date", "positives", "total").orderBy(F.desc("positives"), "date")


# ---- regression --------------------------------------------------------------------------

FIT = """SELECT '{name}' AS fit, round(regr_slope({y}, {x}), 6) + 0.0 AS slope, round(regr_intercept({y}, {x}), 6) + 0.0 AS intercept,
   CASE WHEN regr_syy({y}, {x}) > 0 THEN round(regr_r2({y}, {x}), 6) + 0.0 END AS r2, CAST(regr_count({y}, {x}) AS BIGINT) AS n,
   CASE WHEN regr_count({y}, {x}) > 2 THEN round(sqrt(greatest(regr_syy({y}, {x}) - regr_sxy({y}, {x}) * regr_sxy({y}, {x})
      / regr_sxx({y}, {x}), 0) / (regr_count({y}, {x}) - 2) / regr_sxx({y}, {x})), 6) + 0.0 END AS se FROM {frm}"""


@query(
    "r1_linear_fit",
    "daily external_series",
    """WITH t AS (SELECT date_diff('day', DATE '1970-01-01', date)::DOUBLE AS day, log10(positives) AS ly, positive_share FROM daily WHERE positives > 0),
         u AS (SELECT log10(d.total) AS lx, log10(e.pagecount) AS ly FROM daily d JOIN external_series e USING (date) WHERE d.date >= DATE '2024-01-05') """
    + " UNION ALL ".join(
        [
            FIT.format(name="log trend", y="ly", x="day", frm="t"),
            FIT.format(name="share trend", y="positive_share", x="day", frm="t"),
            FIT.format(name="log log", y="ly", x="lx", frm="u"),
        ]
    ),
)
def _(x):
    daily = _daily(x).withColumn("day", F.unix_date("date")).where(F.col("positives") > 0)
    logs = series.with_log10(daily, ["positives"])
    both = series.with_log10(
        date_slice(_daily(x), "2024-01-05").join(x.external_series(), "date"), ["total", "pagecount"]
    )
    fits = {
        "log trend": regression.linear_fit(logs, "log10_positives", "day"),
        "share trend": regression.linear_fit(logs, "positive_share", "day"),
        "log log": regression.linear_fit(both, "log10_pagecount", "log10_total"),
    }
    out = None
    for name, fit in fits.items():
        row = fit.select(F.lit(name).alias("fit"), "*")
        out = row if out is None else out.unionByName(row)
    return rounded(out, ["slope", "intercept", "r2", "se"])


def _incident_frame(x: Inputs):
    """One row per day, stored: a fit passes over its rows two or three times, over the posts once."""
    days = series.with_lead_lag(_daily(x).select("date", "positives"), "positives")
    return cut_lineage(incident_features(series.join_calendar(days, x.calendar())), "days")


@query(
    "r2_cross_products",
    "lagged calendar",
    """WITH f AS (SELECT next_positives::DOUBLE AS y, positives::DOUBLE AS a, prev_positives::DOUBLE AS b,
           CASE WHEN c.incident IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS d FROM lagged l LEFT JOIN calendar c USING (date)
           WHERE next_positives IS NOT NULL AND prev_positives IS NOT NULL)
       SELECT count(*) AS n, sum(y) AS s_y, sum(y * y) AS yy, sum(y) AS xy_0, CAST(count(*) AS DOUBLE) AS xx_0_0, sum(a) AS xx_0_1,
         sum(b) AS xx_0_2, sum(d) AS xx_0_3, sum(a * y) AS xy_1, sum(a * a) AS xx_1_1, sum(a * b) AS xx_1_2, sum(a * d) AS xx_1_3,
         sum(b * y) AS xy_2, sum(b * b) AS xx_2_2, sum(b * d) AS xx_2_3, sum(d * y) AS xy_3, sum(d * d) AS xx_3_3 FROM f""",
)
def _(x):
    frame, names = regression.design(
        _incident_frame(x).withColumn("inc", F.col("inc").cast("string")),
        "next_positives",
        ["positives", "prev_positives"],
        {"inc": ("0", ["1"])},
    )
    return regression.cross_products(frame, len(names))


def _levels_sql() -> str:
    group = """CASE WHEN category IN ('offline action other', 'online action other') THEN 'action other'
      WHEN category IN ('offline action subject', 'online action subject') THEN 'action subject' WHEN category = 'event' THEN 'events' ELSE '' END"""
    dummies = ", ".join(f"CASE WHEN {group} = '{c}' THEN 1.0 ELSE 0.0 END::DOUBLE AS x{i + 2}" for i, c in enumerate(CATEGORIES))
    return f"SELECT next_positives::DOUBLE AS y, positives::DOUBLE AS x0, prev_positives::DOUBLE AS x1, {dummies} FROM lagged l LEFT JOIN calendar c USING (date)"


LEVELS = ["positives", "prev_positives"] + [f"cattotal={c}" for c in CATEGORIES]


@query("r2_ols", "lagged calendar", lambda: coefficients(LEVELS, _levels_sql()))
def _(x):
    fit = regression.ols(_incident_frame(x), "next_positives", ["positives", "prev_positives"], {"cattotal": ("no incident", CATEGORIES)})
    return rounded(fit.table(x.spark), ["estimate", "std_error", "t", "p", "r2"])


@query("r3_ols_hc1", "lagged calendar", lambda: coefficients(LEVELS, _levels_sql(), errors="HC1"))
def _(x):
    fit = regression.ols(
        _incident_frame(x), "next_positives", ["positives", "prev_positives"], {"cattotal": ("no incident", CATEGORIES)}, cov="HC1"
    )
    return rounded(fit.table(x.spark), ["estimate", "std_error", "t", "p", "r2"])


def _panel(x: Inputs):
    """Language ratio per (date, scale) with the type counts, and the interaction of total and scale; stored."""
    posts = x.posts()
    by = positive_posts(posts).where(F.col("scale").isNotNull()).groupBy("date", "scale").agg(
        F.count(F.lit(1)).alias("n_positive"), *[F.sum(c).alias(c) for c in [*TYPES, *LANGUAGE]]
    )
    ratio = share(F.col("x5_explicitlanguage"), F.col("x5_implicitlanguage"))
    panel = by.withColumn("explicit_ratio", ratio).withColumn("total_x_scale", F.col("n_positive") * F.col("scale"))
    return cut_lineage(panel, "panel")


PANEL_X = ["n_positive", "scale", "total_x_scale", "x3_violence", "x3_insult", "x3_disparagement", "x3_prejudice", "x3_mocking"]


def _panel_sql() -> str:
    counts = ", ".join(f"sum({c})::DOUBLE AS x{i + 3}" for i, c in enumerate(PANEL_X[3:]))
    return f"""SELECT date AS g, sum(x5_explicitlanguage)::DOUBLE / nullif(sum(x5_implicitlanguage)::DOUBLE, 0) AS y, count(*)::DOUBLE AS x0,
      scale::DOUBLE AS x1, (count(*) * scale)::DOUBLE AS x2, {counts} FROM positive_posts WHERE scale IS NOT NULL GROUP BY date, scale"""


@query("r4_panel_within", "positive_posts", lambda: coefficients(PANEL_X, _panel_sql(), within=True))
def _(x):
    return rounded(regression.panel_within(_panel(x), "explicit_ratio", PANEL_X, "date").table(x.spark), ["estimate", "std_error", "t", "p", "r2"])


@query("r5_panel_clustered", "positive_posts", lambda: coefficients(PANEL_X, _panel_sql(), errors="cluster", within=True))
def _(x):
    fit = regression.panel_within(_panel(x), "explicit_ratio", PANEL_X, "date", cluster="date")
    return rounded(fit.table(x.spark), ["estimate", "std_error", "t", "p", "r2"])


WINDOWS = {"early": ("2024-01-03", "2024-01-12"), "middle": ("2024-01-10", "2024-01-20"), "late": ("2024-01-20", "2024-02-01")}


@query(
    "r6_event_windows",
    "daily_events",
    " UNION ALL ".join(
        f"SELECT '{k}' AS slice, date, positives, total, incident, category FROM daily_events WHERE date >= DATE '{a}' AND date < DATE '{b}'"
        for k, (a, b) in WINDOWS.items()
    ),
)
def _(x):
    daily = _daily(x).select("date", "positives", "total")
    return series.event_windows(daily, x.calendar(), WINDOWS).select("slice", "date", "positives", "total", "incident", "category").orderBy("slice", "date")


@query(
    "r7_series_long",
    "daily",
    " UNION ALL ".join(f"SELECT date, '{c}' AS series, {c} AS freq FROM daily" for c in ("positives", "negatives", "total")),
)
def _(x):
    return series.series_long(_daily(x))
