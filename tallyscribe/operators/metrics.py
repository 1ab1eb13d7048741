"""Scores of classifiers and regressions, and the tables that collect them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscribe.functions.nulls import half_even
from tallyscribe.operators.prep import unpivot
from tallyscribe.schema import METRICS


def rmse(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.agg(F.sqrt(F.avg(F.pow(F.col(y) - F.col(yhat), F.lit(2.0)))).alias("value"))


def confusion(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of (truth, prediction)."""
    return df.groupBy(*by, F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(
    df: DataFrame, y: str, yhat: str, classes: Sequence[int], by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, and precision, recall and F1 for every class in ``classes``: ``(*by, metric, value)``.

    For a binary target pass the positive class only. Undefined ratios are NULL. Metrics are named
    by class, e.g. ``Precision_2``; the caller maps a binary positive class to its reporting slot.
    """
    table = confusion(df, y, yhat, by)
    n, right = F.col("n"), F.col("y") == F.col("yhat")
    aggs = [F.sum("n").alias("all"), F.sum(F.when(right, n).otherwise(0)).alias("hit")]
    for c in classes:
        aggs += [
            F.sum(F.when(right & (F.col("y") == c), n).otherwise(0)).alias(f"tp_{c}"),
            F.sum(F.when(F.col("yhat") == c, n).otherwise(0)).alias(f"pp_{c}"),
            F.sum(F.when(F.col("y") == c, n).otherwise(0)).alias(f"ap_{c}"),
        ]
    sums = table.groupBy(*by).agg(*aggs) if by else table.agg(*aggs)
    values = {"Accuracy": F.try_divide(F.col("hit").cast("double"), F.col("all"))}
    for c in classes:
        tp = F.col(f"tp_{c}").cast("double")
        values[f"Precision_{c}"] = F.try_divide(tp, F.col(f"pp_{c}"))
        values[f"Recall_{c}"] = F.try_divide(tp, F.col(f"ap_{c}"))
        values[f"F1_{c}"] = F.when(
            (F.col(f"pp_{c}") > 0) & (F.col(f"ap_{c}") > 0), F.try_divide(2 * tp, F.col(f"pp_{c}") + F.col(f"ap_{c}"))
        )
    wide = sums.select(*by, *[v.alias(k) for k, v in values.items()])
    return unpivot(wide, list(by), list(values), "metric", "value")


def binary_slots(metrics: DataFrame, positive: int) -> DataFrame:
    """Report the positive class of a binary target in slot 2 of the metric table."""
    return metrics.withColumn("metric", F.regexp_replace("metric", f"_{positive}$", "_2"))


def mean_metrics(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Average over folds."""
    return metrics.groupBy(*by, "metric").agg(F.avg("value").alias("value"))


def scaffold(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fill in the metrics a target does not have, so every target lists the same rows."""
    names = F.explode(F.array(*[F.lit(m) for m in METRICS])).alias("metric")
    full = metrics.select(*by).distinct().select(*by, names)
    return full.join(metrics, [*by, "metric"], "left")


def assemble_metrics(metrics: DataFrame, targets: Sequence[str], target: str = "target") -> DataFrame:
    """One row per metric, one column per target, by a single pivot."""
    return metrics.groupBy("metric").pivot(target, list(targets)).agg(F.first("value"))


def transpose_metrics(table: DataFrame, targets: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Targets to rows, metrics to columns."""
    return unpivot(table, ["metric"], targets, "target", "value").groupBy("target").pivot("metric", list(metrics)).agg(F.first("value"))


def report_columns(table: DataFrame, order: dict[str, str]) -> DataFrame:
    """Choose, order and rename the columns of a report."""
    return table.select([F.col(f"`{old}`").alias(new) for old, new in order.items()])


def compare_algorithms(metrics: DataFrame, target: str, runs: Sequence[tuple[str, str]], digits: int = 2) -> DataFrame:
    """``(algorithm, variant, accuracy, precision, recall, f1)`` of a binary target: one row per chosen run of a grid, rounded.

    ``metrics`` is ``(algorithm, variant, target, metric, value)``. The wide table of the grid, one column per algorithm and
    variant, keeps the metrics that all runs have and is then turned on its side. A run without a row is NULL throughout.
    """
    spark = metrics.sparkSession
    name = F.concat_ws("|", "algorithm", "variant")
    wide = assemble_metrics(metrics.where(F.col("target") == target).withColumn("_run", name), ["|".join(r) for r in runs], "_run")
    turned = transpose_metrics(wide, ["|".join(r) for r in runs], list(GENERAL)[1:])
    listed = spark.createDataFrame([("|".join(r), *r) for r in runs], "target string, algorithm string, variant string")
    rows = listed.join(turned, "target", "left")
    return rows.select("algorithm", "variant", *[half_even(F.col(f"`{m}`"), digits).alias(a) for m, a in list(GENERAL.items())[1:]])


GENERAL = {"target": "target", "Accuracy": "accuracy", "Precision_2": "precision", "Recall_2": "recall", "F1_2": "f1"}


def performance_report(metrics: DataFrame, targets: Sequence[str], digits: int = 2) -> DataFrame:
    """Accuracy, precision, recall and F1 of the chosen binary targets."""
    chosen = metrics.where(F.col("target").isin(*targets) & F.col("metric").isin(*list(GENERAL)[1:]))
    wide = chosen.groupBy("target").pivot("metric", list(GENERAL)[1:]).agg(half_even(F.first("value"), digits))
    return report_columns(wide, GENERAL)


def scale_report(metrics: DataFrame, targets: Sequence[str], digits: int = 2) -> DataFrame:
    """All metrics of the ordinal and the numeric target, one column each."""
    table = assemble_metrics(scaffold(metrics.where(F.col("target").isin(*targets)), ["target"]), targets)
    return table.select("metric", *[half_even(F.col(f"`{t}`"), digits).alias(t) for t in targets])
