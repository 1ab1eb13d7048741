"""Filters, projections and column-wise mapping."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscribe.functions import nulls
from tallyscribe.operators.skew import join_term_stats

# ---- filters -----------------------------------------------------------------------------


def filter_language(
    df: DataFrame,
    accept: Sequence[str] = ("en",),
    undetermined: str = "und",
    detected: str = "detected_lang",
    detected_as: str = "en",
) -> DataFrame:
    """Keep accepted and undetermined posts, and posts without a tag that the identifier accepts."""
    lang = F.col("lang")
    return df.where(
        lang.isin(*accept) | (lang == undetermined) | (lang.isNull() & (F.col(detected) == detected_as))
    )


def drop_reposts(df: DataFrame, text: str = "text", original: str = "retweeted_status") -> DataFrame:
    """Drop posts that announce a repost or embed the original."""
    return df.where(~F.col(text).startswith("RT ") & F.col(original).isNull())


def with_date(df: DataFrame, col: str, before: str | None = None) -> DataFrame:
    """Parse a timestamp, derive its date, and keep dates before the cutoff."""
    ts = F.to_timestamp(col)
    out = df.withColumn("created_at_date", ts).withColumn("date", F.to_date("created_at_date"))
    return out if before is None else out.where(F.col("date") < F.lit(before).cast("date"))


def require(df: DataFrame, col: str) -> DataFrame:
    """Drop rows without a value."""
    return df.where(F.col(col).isNotNull())


def scope_filter(df: DataFrame, label: str, on_target: str) -> DataFrame:
    """Unlabelled rows, negatives, and positives aimed at the subject of the study."""
    y = F.col(label)
    return df.where(y.isNull() | (y == 0) | ((y == 1) & (F.col(on_target) == 1)))


def split_labelled(df: DataFrame, marker: str) -> tuple[DataFrame, DataFrame]:
    """(labelled, unlabelled) by a nullable marker."""
    return df.where(F.col(marker).isNotNull()), df.where(F.col(marker).isNull())


def where_label_valid(df: DataFrame, label: str, values: Sequence[int] = (0, 1, 2, 3, 4, 5)) -> DataFrame:
    """Keep rows whose label is one of the allowed values."""
    return df.where(F.col(label).isin(*values))


def exclude_batch(df: DataFrame, col: str, value) -> DataFrame:
    """Drop one batch, and rows that belong to none."""
    return df.where(F.col(col) != F.lit(value))


def date_slice(df: DataFrame, start: str | None = None, end: str | None = None, col: str = "date") -> DataFrame:
    """Rows with ``start <= date < end``."""
    if start is not None:
        df = df.where(F.col(col) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(col) < F.lit(end).cast("date"))
    return df


def is_positive(flag: str = "flag", scale: str = "scale", scale_m: str = "scale_m", ordinal: bool = False) -> Column:
    """Positive by any of three signals. ``ordinal`` tests ``scale <> 1`` instead of ``scale > 1``."""
    by_scale = (F.col(scale) != 1) if ordinal else (F.col(scale) > 1)
    return (F.col(flag) == 1) | by_scale | (F.col(scale_m) > 1)


def positive_posts(df: DataFrame, **names) -> DataFrame:
    return df.where(is_positive(**names))


def extract_notes(df: DataFrame, note: str, keep: Sequence[str]) -> DataFrame:
    """Project the rows that carry a note."""
    return df.where(F.col(note) != "").select(*keep, note)


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a missing value."""
    return df.na.drop(subset=list(cols) if cols else None)


# ---- columns -----------------------------------------------------------------------------


def drop_matching(df: DataFrame, names: Sequence[str] = (), patterns: Sequence[str] = ()) -> DataFrame:
    """Drop columns by name, or because the name contains one of the patterns."""
    gone = [c for c in df.columns if c in names or any(re.search(p, c, re.IGNORECASE) for p in patterns)]
    return df.drop(*gone)


def matching(
    df: DataFrame, prefix: str | None = None, suffix: str | None = None, regex: str | None = None, negate: bool = False
) -> list[str]:
    """Names of the columns that fit every condition given (or, with ``negate``, that do not)."""

    def fits(name: str) -> bool:
        return (
            (prefix is None or name.startswith(prefix))
            and (suffix is None or name.endswith(suffix))
            and (regex is None or re.search(regex, name) is not None)
        )

    return [c for c in df.columns if fits(c) != negate]


def select_matching(df: DataFrame, keep: Sequence[str] = (), **how) -> DataFrame:
    """Select ``keep`` and the matching columns, in table order."""
    names = set(keep) | set(matching(df, **how))
    return df.select([c for c in df.columns if c in names])


def rename_all(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def map_columns(df: DataFrame, cols: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply a Column function to the named columns in one projection."""
    chosen = set(cols)
    return df.select([fn(F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns])


def numeric_columns(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in without]


def agg_numeric(df: DataFrame, keys: Sequence[str], fn: Callable[[str], Column]) -> DataFrame:
    """Apply one aggregate to every numeric column that is not a key."""
    return df.groupBy(*keys).agg(*[fn(c).alias(c) for c in numeric_columns(df, keys)])


def invalidate_labels(
    df: DataFrame,
    stale: Sequence,
    keep_one: Sequence[str],
    null: Sequence[str],
    scale: str | None = None,
    scale6: str | None = None,
    rater: str = "rater",
) -> DataFrame:
    """Withdraw answers that raters gave under an older scheme.

    In ``keep_one`` only a 1 survives, ``null`` columns are emptied, the scale keeps 1 (and the
    extended scale also 0). Other columns stay as they are.
    """
    is_stale = F.col(rater).isin(*stale)

    def only(name: str, values: Sequence[int]) -> Column:
        kept = F.when(F.col(name).isin(*values), F.col(name))
        return F.when(is_stale, kept).otherwise(F.col(name)).alias(name)

    rules = {c: (1,) for c in keep_one}
    if scale:
        rules[scale] = (1,)
    if scale6:
        rules[scale6] = (0, 1)
    emptied = set(null)
    cols = []
    for c in df.columns:
        if c in rules:
            cols.append(only(c, rules[c]))
        elif c in emptied:
            cols.append(F.when(~is_stale | F.col(rater).isNull(), F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(cols)


def with_intersections(df: DataFrame, combos: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add one 0/1/NULL column per combination of flags."""
    return df.select("*", *[nulls.intersect_flags(parts).alias(name) for name, parts in combos.items()])


def with_date_parts(df: DataFrame, col: str = "date") -> DataFrame:
    return df.select(
        "*", F.day(col).alias("day"), F.month(col).alias("month"), F.year(col).alias("year")
    )


def incident_features(df: DataFrame, incident: str = "incident", category: str = "category") -> DataFrame:
    """Incident flag, category with "no incident" filled in, and the coarse category."""
    group = F.col(category)
    coarse = (
        F.when(group.isin("offline action other", "online action other"), "action other")
        .when(group.isin("offline action subject", "online action subject"), "action subject")
        .when(group == "event", "events")
        .otherwise("no incident")
    )
    return df.select(
        *[c for c in df.columns if c != category],
        F.when(F.col(incident).isNull(), 0).otherwise(1).alias("inc"),
        F.coalesce(group, F.lit("no incident")).alias(category),
        coarse.alias("cattotal"),
    )


# ---- reshape -----------------------------------------------------------------------------


def unpivot(
    df: DataFrame, ids: Sequence[str], cols: Sequence[str], var: str, val: str, strip: str | None = None
) -> DataFrame:
    """Wide to long; ``strip`` is a regular expression removed from the variable name."""
    out = df.unpivot(list(ids), list(cols), var, val)
    return out if strip is None else out.withColumn(var, F.regexp_replace(var, strip, ""))


def mark_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "is_copy") -> DataFrame:
    """Mark every row of a key but the first by ``order``, which must tell the rows of a key apart.

    The first row per key is an aggregate with map-side combine, and the join back salts hot keys,
    so a key with very many copies never gathers in one task.
    """
    facts = df.withColumn("_key", F.struct(*keys))
    first = facts.groupBy("_key").agg(F.min(F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("_n"))
    joined = join_term_stats(facts, first, "_key", "_n", spread=order)
    copy = F.when(F.struct(*order) == F.col("_first"), 0).otherwise(1)
    return joined.select(*df.columns, copy.alias(out))
