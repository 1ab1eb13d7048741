"""Daily series: counts, shares, composition, event windows.

Posts are first reduced to one row per day (partial aggregation, then a shuffle of days), and
only that small table is windowed, joined to calendars or reshaped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscribe.functions.nulls import log10_positive, share
from tallyscribe.operators.prep import positive_posts, unpivot


def _all_present(col: str, value: Column) -> Column:
    """``value``, but NULL if the group has a NULL in ``col``."""
    return F.when(F.count(F.lit(1)) == F.count(col), value)


def daily_counts(
    df: DataFrame,
    date: str = "date",
    flag: str = "flag",
    scale: str = "scale",
    scale_m: str = "scale_m",
    strict: bool = False,
) -> DataFrame:
    """Positives, negatives, total, mean severities and positive share per day.

    Missing values are skipped and counted in ``n_missing``; with ``strict`` a missing value makes
    the day's figure missing.
    """
    pos = F.sum(F.col(flag)).cast("bigint")
    mean_m, mean_s = F.avg(scale_m), F.avg(scale)
    if strict:
        pos, mean_m, mean_s = _all_present(flag, pos), _all_present(scale_m, mean_m), _all_present(scale, mean_s)
    out = df.groupBy(date).agg(
        pos.alias("positives"),
        F.count(F.lit(1)).alias("total"),
        mean_m.alias("mean_scale_m"),
        mean_s.alias("mean_scale"),
        F.sum(F.when(F.col(scale).isNull(), 1).otherwise(0)).cast("bigint").alias("n_missing"),
    )
    return out.select(
        date,
        "positives",
        (F.col("total") - F.col("positives")).alias("negatives"),
        "total",
        "mean_scale_m",
        "mean_scale",
        "n_missing",
        share(F.col("positives"), F.col("total")).alias("positive_share"),
    )


def daily_positive(df: DataFrame, by: Sequence[str] = ("date",), scale_m: str = "scale_m", **names) -> DataFrame:
    """Count and mean severity of the positive posts, per date or per (date, scale)."""
    return positive_posts(df, scale_m=scale_m, **names).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_positive"), F.avg(scale_m).alias("mean_scale_m")
    )


def daily_category_sums(df: DataFrame, cols: Sequence[str], date: str = "date") -> DataFrame:
    """Sum of every indicator over the positive posts of a day."""
    return positive_posts(df).groupBy(date).agg(*[F.sum(c).cast("bigint").alias(c) for c in cols])


def daily_categories(df: DataFrame, cols: Sequence[str], date: str = "date") -> DataFrame:
    """Indicator sums with the number of positive posts, in one pass over the posts."""
    return positive_posts(df).groupBy(date).agg(
        F.count(F.lit(1)).alias("n_positive"),
        F.avg("scale_m").alias("mean_scale_m"),
        *[F.sum(c).cast("bigint").alias(c) for c in cols],
    )


def mean_daily_share(daily: DataFrame, cols: Sequence[str], total: str) -> DataFrame:
    """Mean over days of each column's share of the day's total, one row."""
    return daily.agg(*[F.avg(share(F.col(c), F.col(total))).alias(c) for c in cols])


def totals_table(daily: DataFrame, total: str = "total") -> DataFrame:
    """Overall frequency and mean daily share of positives, negatives and all posts."""
    parts = ("positives", "negatives", total)
    sums = daily.agg(
        *[F.sum(c).cast("bigint").alias(f"f_{c}") for c in parts],
        *[F.avg(share(F.col(c), F.col(total))).alias(f"p_{c}") for c in parts],
    )
    pairs = ", ".join(f"'{c}', f_{c}, p_{c}" for c in parts)
    return sums.selectExpr(f"stack({len(parts)}, {pairs}) AS (series, frequency, mean_share)")


def engagement_by_label(df: DataFrame, label: str, measures: Sequence[str]) -> DataFrame:
    """Sum and mean of each engagement count per label."""
    aggs = [F.sum(label).cast("bigint").alias(f"sum_{label}")]
    for m in measures:
        aggs += [F.sum(m).cast("bigint").alias(f"sum_{m}"), F.avg(m).alias(f"mean_{m}")]
    return df.groupBy(label).agg(*aggs)


# ---- windows over days -------------------------------------------------------------------


def with_lead_lag(daily: DataFrame, col: str, date: str = "date", calendar: bool = False) -> DataFrame:
    """Next and previous value by date.

    Neighbours are rows; with ``calendar`` they are days, so a gap gives NULL.
    """
    days = Window.orderBy(date)
    nxt, prev = F.lead(col).over(days), F.lag(col).over(days)
    if calendar:
        nxt = F.when(F.lead(date).over(days) == F.date_add(date, 1), nxt)
        prev = F.when(F.lag(date).over(days) == F.date_sub(date, 1), prev)
    return daily.select("*", nxt.alias(f"next_{col}"), prev.alias(f"prev_{col}"))


def compose(daily: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace columns by their share of the row total."""
    whole = F.col(cols[0])
    for c in cols[1:]:
        whole = whole + F.col(c)
    chosen = set(cols)
    return daily.select([share(F.col(c), whole).alias(c) if c in chosen else F.col(c) for c in daily.columns])


def share_change(daily: DataFrame, cols: Sequence[str], date: str = "date", strip: str | None = None) -> DataFrame:
    """Day-over-day change of the composition, long form."""
    days = Window.orderBy(date)
    moved = compose(daily.select(date, *cols), cols).select(
        date, *[(F.col(c) - F.lag(c).over(days)).alias(c) for c in cols]
    )
    return unpivot(moved, [date], cols, "type", "freq", strip)


def share_deviation(daily: DataFrame, cols: Sequence[str], date: str = "date", strip: str | None = None) -> DataFrame:
    """Distance of the day's composition from the mean over the period, long form."""
    period = Window.partitionBy()
    moved = compose(daily.select(date, *cols), cols).select(
        date, *[(F.col(c) - F.avg(c).over(period)).alias(c) for c in cols]
    )
    return unpivot(moved, [date], cols, "type", "freq", strip)


def exclusive_count(daily: DataFrame, whole: str, part: str, out: str) -> DataFrame:
    """Count of a category without its intersection."""
    return daily.withColumn(out, F.col(whole) - F.col(part))


# ---- joins on the date -------------------------------------------------------------------


def join_calendar(daily: DataFrame, calendar: DataFrame, date: str = "date", collect: str | None = None) -> DataFrame:
    """Left join incidents to days.

    Two incidents on a date repeat the day. ``collect='first'`` keeps the alphabetically first,
    ``collect='list'`` gathers a day's incidents. The daily side is already one row per day, so no
    hint is given: the planner broadcasts the calendar if its measured size allows.
    """
    if collect == "first":
        calendar = calendar.groupBy(date).agg(F.min(F.struct("incident", "category")).alias("_i")).select(
            date, "_i.incident", "_i.category"
        )
    elif collect == "list":
        calendar = calendar.groupBy(date).agg(F.sort_array(F.collect_list(F.struct("incident", "category"))).alias("incidents"))
    return daily.join(calendar, date, "left")


def join_by_date_scale(sums: DataFrame, counts: DataFrame, date: str = "date") -> DataFrame:
    """Per-date sums repeated for every (date, scale) count."""
    return sums.join(counts, date, "left")


def with_log10(daily: DataFrame, cols: Sequence[str]) -> DataFrame:
    return daily.select("*", *[log10_positive(F.col(c)).alias(f"log10_{c}") for c in cols])


def series_long(daily: DataFrame, date: str = "date", total: str = "total") -> DataFrame:
    """Positives, negatives and total per day, long form."""
    return unpivot(daily, [date], ["positives", "negatives", total], "series", "freq")


def event_windows(daily: DataFrame, calendar: DataFrame, ranges: Mapping[str, tuple[str, str]], date: str = "date") -> DataFrame:
    """Slices ``[start, end)`` of the daily series with the incidents in them, one label per slice.

    Every day is matched with the few ranges it lies in by an array filter, so overlapping slices
    come out of one pass and no range join is planned. The ranges also stand as a plain condition on the date, which
    passes the daily aggregate and reaches the scan.
    """
    slices = F.array(
        *[
            F.struct(F.lit(k).alias("name"), F.lit(a).cast("date").alias("start"), F.lit(b).cast("date").alias("stop"))
            for k, (a, b) in ranges.items()
        ]
    )
    hits = F.filter(slices, lambda s: (F.col(date) >= s["start"]) & (F.col(date) < s["stop"]))
    inside = F.lit(False)
    for a, b in ranges.values():
        inside = inside | ((F.col(date) >= F.lit(a).cast("date")) & (F.col(date) < F.lit(b).cast("date")))
    sliced = daily.where(inside).withColumn("_s", F.explode(hits)).withColumn("slice", F.col("_s.name")).drop("_s")
    return join_calendar(sliced, calendar, date)
