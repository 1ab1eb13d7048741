"""Classifiers on the long feature table: tuned linear machines for all targets at once, forests, grids, cascades."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscribe.functions import hashing
from tallyscribe.operators import linear
from tallyscribe.operators.bayes import nb_fit, nb_predict
from tallyscribe.operators.forest import DEPTH, TREES, forest_predictions
from tallyscribe.operators.linear import BINARY, NUMERIC, ONE_VS_ONE, ORDINAL
from tallyscribe.operators.metrics import binary_slots, classification_metrics, rmse
from tallyscribe.operators.prep import where_label_valid
from tallyscribe.operators.sampling import is_train, upsample
from tallyscribe.operators.skew import join_term_stats, rank_by_hash
from tallyscribe.operators.tokens import dfm_docs, dfm_match, vocabulary
from tallyscribe.sources.storage import cut_lineage, load_stage, new_path, save_stage

COSTS = (0.1, 1.0, 10.0, 100.0)
FOLDS = 10
#: Labelled documents that one task of a pass takes, as long as there are fewer tasks than shuffle partitions.
TASK_ROWS = 64


# ---- features ----------------------------------------------------------------------------


def term_index(vocab: DataFrame) -> DataFrame:
    """``(term, df, idx, size)``: dense ids 0..V-1 in hash order, without sorting in one task."""
    hashed = vocab.select("term", "df", hashing.text_key(F.col("term")).alias("_h"))
    return rank_by_hash(hashed, [], "_h", ["term"], "_r").select(
        "term", "df", (F.col("_r") - 1).cast("int").alias("idx"), F.col("_r_of").cast("int").alias("size")
    )


def to_vectors(counts: DataFrame, index: DataFrame, docs: DataFrame) -> DataFrame:
    """``docs`` with a sparse ``features`` vector per document.

    Vectors are written to the shared folder as the struct that a vector is stored as, and read back
    as vectors, so they are built in the JVM and model fitting can read them as often as it likes.
    """
    spark = counts.sparkSession
    value = F.col("n" if "n" in counts.columns else "weight").cast("double")
    cells = join_term_stats(counts.select("doc_id", "term", value.alias("v")), index, "term", "df", spread=["doc_id"])
    per_doc = cells.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("c"))
    empty = F.array().cast("array<struct<idx:int,v:double>>")
    c = F.coalesce("c", empty)
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        index.agg(F.coalesce(F.max("size"), F.lit(0))).scalar().alias("size"),
        F.transform(c, lambda x: x["idx"]).alias("indices"),
        F.transform(c, lambda x: x["v"]).alias("values"),
    )
    path = new_path(spark, "vectors")
    save_stage(docs.join(per_doc, "doc_id", "left").select(*docs.columns, vector.alias("features")), path)
    schema = T.StructType([*docs.schema.fields, T.StructField("features", VectorUDT())])
    return spark.read.schema(schema).parquet(path)


# ---- one target --------------------------------------------------------------------------


@dataclass
class Target:
    """Documents and features of one target, ready for a model."""

    train: DataFrame  # doc_id, y, copy_no
    test: DataFrame  # doc_id, y
    unlabelled: DataFrame  # doc_id
    vocab: DataFrame  # term, df
    counts: DataFrame  # features of all documents, not yet restricted to vocab

    def matched(self) -> DataFrame:
        """Features of all documents, restricted to the terms of the training part.

        Models do not need it: joining their weights or term ids restricts the features as well.
        """
        return dfm_match(self.counts, self.vocab)


def prepare_target(counts: DataFrame, labels: DataFrame, y: str, kind: str = BINARY, p: float = 0.8) -> Target:
    """Keep valid labels, split, up-sample the training part, list its terms.

    ``counts`` should be a stored table. ``labels`` is ``(doc_id, <y>)`` with NULL for documents to predict.
    A numeric target is not restricted to label values and not up-sampled. The training part and the
    vocabulary are written to the shared folder, because every later step starts from them.
    """
    known = labels.select("doc_id", F.col(y).alias("y"))
    labelled = known.where(F.col("y").isNotNull()) if kind == NUMERIC else where_label_valid(known, "y")
    chosen = labelled.where(is_train("doc_id", p, labels))
    train = chosen.withColumn("copy_no", F.lit(0)) if kind == NUMERIC else upsample(chosen, "y", "doc_id")
    return Target(
        train=cut_lineage(train, "train"),
        test=labelled.where(~is_train("doc_id", p, labels)),
        unlabelled=known.where(F.col("y").isNull()).select("doc_id"),
        vocab=cut_lineage(vocabulary(dfm_docs(counts, chosen)), "vocabulary"),
        counts=counts,
    )


# ---- labelled documents of many targets --------------------------------------------------


@dataclass
class Labelled:
    """The labelled documents of some targets: a stored table of their features and of their part in each target."""

    rows: DataFrame  # doc_id, idx, val, t0, t1, ...: one struct (train, y, copies) per target, NULL without a label
    index: DataFrame  # term, df, idx, size
    size: int
    names: list[str]
    kinds: list[str]
    classes: list[tuple[float, ...]]
    folds: int

    @cached_property
    def packed(self) -> linear.Packed:
        """The rows as linear machines of any targets, folds and costs start from them."""
        return linear.pack(self.rows)


def _in_fold(fold, start, stride, copies, k: int):
    """How many of the places ``start + j * stride`` (j below ``copies``) are ``fold`` modulo ``k``: they repeat after ``k``."""

    def add(total, j):
        here = (F.pmod(start + j * stride, F.lit(k)) == fold) & (j < copies)
        return total + F.when(here, F.floor((copies - 1 - j) / k) + 1).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")), F.lit(0).cast("bigint"), add)


def mark_targets(labels: DataFrame, targets: dict[str, str], folds: int = FOLDS, p: float = 0.8, leak_safe: bool = False) -> DataFrame:
    """``(doc_id, target, kind, train, y, class, copies)`` for every valid label of the targets, numbered in their order.

    The parts are those of ``prepare_target``: split by a hash, classes evened out by copies inside each part. Copies are numbers,
    one per fold, and never rows. Folds count through the copies of all classes of a part one after the other, so each
    fold gets its share of every class, and no fold is empty if there are at least as many copies as folds. With
    ``leak_safe`` all copies of a document are in one fold. A numeric target has one copy of each document.
    """
    cells = [
        F.struct(F.lit(i).alias("target"), F.lit(kind).alias("kind"), F.col(f"`{name}`").cast("double").alias("y"))
        for i, (name, kind) in enumerate(targets.items())
    ]
    long = labels.select("doc_id", F.explode(F.array(*cells)).alias("c")).select("doc_id", "c.*").where(F.col("y").isNotNull() & ~F.isnan("y"))
    valid = long.where((F.col("kind") == NUMERIC) | F.col("y").isin(0.0, 1.0, 2.0, 3.0, 4.0, 5.0))
    tagged = valid.withColumn("train", is_train("doc_id", p, labels)).withColumn("class", F.when(F.col("kind") != NUMERIC, F.col("y")))
    tagged = tagged.withColumn("_h", hashing.row_hash(tagged, ["doc_id"], hashing.UPSAMPLE))
    ranked = rank_by_hash(tagged, ["target", "train", "class"], "_h", ["doc_id"], "_r")
    part = Window.partitionBy("target", "train")
    groups = tagged.groupBy("target", "train", "class").agg(F.count(F.lit(1)).alias("_n"))
    groups = groups.select(
        "target", "train", F.coalesce("class", F.lit(-1.0)).alias("_key"), F.max("_n").over(part).alias("_most"), (F.dense_rank().over(part.orderBy("class")) - 1).alias("_before")
    )
    both = ranked.withColumn("_key", F.coalesce("class", F.lit(-1.0))).join(groups, ["target", "train", "_key"])
    size, most = F.col("_r_of"), F.col("_most")
    whole = F.floor(most / size)
    number = whole + F.when(F.col("_r") <= most - whole * size, 1).otherwise(0)
    start = F.col("_before") * most + F.col("_r") - 1
    stride = F.lit(0).cast("bigint") if leak_safe else size
    counted = both.withColumn("_start", start).withColumn("_number", number)
    in_folds = F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: _in_fold(f, F.col("_start"), stride, F.col("_number"), folds).cast("int"))
    return counted.select("doc_id", "target", "kind", "train", "y", "class", in_folds.alias("copies"))


def labelled_rows(
    counts: DataFrame, labels: DataFrame, targets: dict[str, str], folds: int = FOLDS, p: float = 0.8, leak_safe: bool = False
) -> Labelled:
    """Everything that models of ``{target: kind}`` are fitted to, from one pass over the features of labelled documents.

    Terms are those of the documents that any of the targets trains on. A term that a model never sees gets no weight.
    """
    spark = counts.sparkSession
    marks = cut_lineage(mark_targets(labels, targets, folds, p, leak_safe), "marks")
    n = marks.select("doc_id").distinct().count()
    found = marks.where(F.col("train") & F.col("class").isNotNull()).select("target", "class").distinct().collect()
    mine = dfm_docs(counts, marks.select("doc_id").distinct())
    index = cut_lineage(term_index(vocabulary(dfm_docs(mine, marks.where("train")))), "terms")
    value = F.col("n" if "n" in counts.columns else "weight").cast("double")
    cells = join_term_stats(mine.select("doc_id", "term", value.alias("v")), index, "term", "df", spread=["doc_id"])
    features = cells.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("c"))
    empty = F.array().cast("array<struct<idx:int,v:double>>")
    per_target = [
        F.max(F.when(F.col("target") == i, F.struct("train", "y", "copies"))).alias(f"t{i}") for i in range(len(targets))
    ]
    rows = marks.groupBy("doc_id").agg(*per_target).join(features, "doc_id", "left").withColumn("c", F.coalesce("c", empty))
    tasks = max(1, min(-(-n // TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.select(
        "doc_id", F.transform("c", lambda x: x["idx"]).alias("idx"), F.transform("c", lambda x: x["v"]).alias("val"), *[f"t{i}" for i in range(len(targets))]
    )
    classes = [tuple(sorted(r["class"] for r in found if r["target"] == i)) for i in range(len(targets))]
    return Labelled(cut_lineage(rows.repartition(tasks), "labelled"), index, index.count(), list(targets), list(targets.values()), classes, folds)


# ---- linear machines ---------------------------------------------------------------------


@dataclass
class Tuned:
    """A target with its chosen cost and the machine fitted to its training part."""

    target: int
    cost: float
    machine: linear.Machine


def _heads(data: Labelled, target: int, how: str) -> list[linear.Head]:
    classes = data.classes[target]
    if data.kinds[target] != NUMERIC and len(classes) < 2:
        return []  # nothing to tell apart
    return linear.heads_of(data.kinds[target], classes, how)


def _machine(data: Labelled, target: int, heads: Sequence[linear.Head], weights: np.ndarray) -> linear.Machine:
    return linear.Machine(target, tuple(heads), data.classes[target], weights)


def _costs(data: Labelled, costs: Sequence[float], max_iter: int, how: str) -> list[float]:
    """The cost of smallest mean error over the folds, per target; the first of equally good ones.

    Machines are fitted and judged in groups that fit the driver, and only their errors are kept.
    """
    heads = [_heads(data, t, how) for t in range(len(data.names))]
    at = [(t, c, f) for t in range(len(data.names)) for c in range(len(costs)) for f in range(data.folds)]
    groups: list[list[tuple[int, int, int]]] = [[]]
    for key in at:
        if groups[-1] and sum(len(heads[t]) for t, _, _ in [*groups[-1], key]) > linear.room(data.size):
            groups.append([])
        groups[-1].append(key)
    errors: dict[tuple[int, int], list[float]] = {}
    for group in groups:
        problems = [linear.Problem(t, h, costs[c], f) for t, c, f in group for h in heads[t]]
        weights = linear.fit(data.packed, data.size, problems, data.folds, max_iter)
        machines, first = [], 0
        for t, c, f in group:
            machines.append((c, f, _machine(data, t, heads[t], weights[first : first + len(heads[t])])))
            first += len(heads[t])
        for key, some in linear.fold_errors(data.rows, machines, data.folds).items():
            errors.setdefault(key, []).extend(some)
    mean = {k: float(np.mean(v)) for k, v in errors.items()}
    return [costs[min(range(len(costs)), key=lambda c: (mean.get((t, c), np.inf), c))] for t in range(len(data.names))]


def _fitted(data: Labelled, chosen: Sequence[float], max_iter: int, how: str, final: Sequence[bool]) -> list[list[linear.Machine]]:
    """Machines of all targets at their costs, fitted to the training part or (``final``) to both parts, in one go."""
    problems = [linear.Problem(t, h, cost, None, last) for last in final for t, cost in enumerate(chosen) for h in _heads(data, t, how)]
    weights = linear.fit(data.packed, data.size, problems, data.folds, max_iter)
    out, first = [], 0
    for _ in final:
        out.append([])
        for t in range(len(chosen)):
            heads = _heads(data, t, how)
            out[-1].append(_machine(data, t, heads, weights[first : first + len(heads)]))
            first += len(heads)
    return out


def svm_fit(data: Labelled, costs: Sequence[float] = COSTS, max_iter: int = 100, how: str = ONE_VS_ONE) -> list[Tuned]:
    """Linear support vector machines of all targets: classifiers, pairwise ones with a vote, and regressions.

    If more than one cost is given, the folds of the training part choose between them.
    """
    chosen = _costs(data, costs, max_iter, how) if len(costs) > 1 else [costs[0]] * len(data.names)
    (machines,) = _fitted(data, chosen, max_iter, how, (False,))
    return [Tuned(t, cost, machine) for t, (cost, machine) in enumerate(zip(chosen, machines, strict=True))]


def svm_metrics(data: Labelled, tuned: Sequence[Tuned]) -> DataFrame:
    """``(target, metric, value)`` of all machines on the test rows."""
    out = None
    for t in tuned:
        rows = score(linear.tested(data.rows, t.machine, data.folds), data.kinds[t.target], data.names[t.target])
        out = rows if out is None else out.unionByName(rows)
    return out


def rf_metrics(data: Labelled, num_trees: int = TREES, max_depth: int = DEPTH) -> DataFrame:
    """``(target, metric, value)`` of random forests of all targets on the test rows."""
    targets = [(i, kind, data.classes[i]) for i, kind in enumerate(data.kinds)]
    preds = cut_lineage(forest_predictions(data.rows, targets, data.size, num_trees, max_depth), "forest")
    out = None
    for i, kind, _ in targets:
        rows = score(preds.where(F.col("target") == i), kind, data.names[i])
        out = rows if out is None else out.unionByName(rows)
    return out


def score(predictions: DataFrame, kind: str, target: str) -> DataFrame:
    """``(target, metric, value)`` of predictions with ``y`` and ``yhat``."""
    if kind == NUMERIC:
        out = rmse(predictions, "y", "yhat").select(F.lit("RMSE").alias("metric"), "value")
    else:
        whole = predictions.select(F.col("y").cast("int").alias("y"), F.col("yhat").cast("int").alias("yhat"))
        if kind == ORDINAL:
            out = classification_metrics(whole, "y", "yhat", (1, 2, 3, 4, 5))
        else:
            out = binary_slots(classification_metrics(whole, "y", "yhat", (1,)), 1)
    return out.select(F.lit(target).alias("target"), "metric", "value")


@dataclass
class Fitted:
    """Fitted targets, ready to predict: all linear functions side by side in one term table."""

    names: list[str]
    kinds: list[str]
    machines: list[linear.Machine]
    weights: DataFrame  # term, df, w: one weight per linear function, targets one after the other
    costs: list[float]
    metrics: DataFrame  # target, metric, value


def weight_table(coefficients: Sequence[np.ndarray], index: DataFrame) -> DataFrame:
    """``(term, df, w)`` from coefficient vectors in the order of ``index``; only as large as the model."""
    spark = index.sparkSession
    size = len(coefficients[0]) if len(coefficients) else 0
    columns = {f"w{i}": c for i, c in enumerate(coefficients)}
    by_id = spark.createDataFrame(pa.table({"idx": np.arange(size, dtype="int32"), **columns}))
    by_id = by_id.select("idx", F.array(*columns).cast("array<double>").alias("w"))
    return index.join(by_id, "idx").select("term", "df", "w")


def fit_targets(
    counts: DataFrame,
    labels: DataFrame,
    targets: dict[str, str],
    costs: Sequence[float] = COSTS,
    folds: int = FOLDS,
    max_iter: int = 100,
    leak_safe: bool = False,
    how: str = ONE_VS_ONE,
) -> Fitted:
    """Tune every ``{target: kind}`` on its training part, score it on its test part, refit it on both. All targets at once."""
    data = labelled_rows(counts, labels, targets, folds, leak_safe=leak_safe)
    chosen = _costs(data, costs, max_iter, how) if len(costs) > 1 else [costs[0]] * len(data.names)
    trained, final = _fitted(data, chosen, max_iter, how, (False, True))
    tuned = [Tuned(t, c, m) for t, (c, m) in enumerate(zip(chosen, trained, strict=True))]
    metrics = cut_lineage(svm_metrics(data, tuned), "metrics")
    weights = cut_lineage(weight_table([row[:-1] for m in final for row in m.weights], data.index), "weights")
    return Fitted(data.names, data.kinds, final, weights, list(chosen), metrics)


def _decision(machine: linear.Machine, kind: str, margins: list):
    """The prediction of a target as an expression of its margins; what ``linear.decide`` does in tasks."""
    if not margins:
        return F.lit(machine.classes[0] if machine.classes else None).cast("double")
    if kind == NUMERIC:
        return margins[0]
    if machine.heads[0].negative is None:
        value = dict(zip(machine.classes, margins, strict=True))
    else:
        value = {c: F.lit(0) for c in machine.classes}
        for h, m in zip(machine.heads, margins, strict=True):
            value[h.positive] = value[h.positive] + (m > 0).cast("int")
            value[h.negative] = value[h.negative] + (m <= 0).cast("int")
    best = F.greatest(*value.values())
    pred = F.lit(machine.classes[-1])
    for c in reversed(machine.classes):
        pred = F.when(value[c] == best, F.lit(c)).otherwise(pred)
    return pred


def predict_targets(fitted: Fitted, counts: DataFrame, docs: DataFrame) -> DataFrame:
    """``docs`` ids with one prediction column per target, all targets in one pass over the features.

    The weights of all machines stand side by side in one term table, so the documents to predict are
    joined once, however many targets there are, and are never turned into vectors.
    """
    intercepts = [float(row[-1]) for m in fitted.machines for row in m.weights]
    cells = join_term_stats(dfm_docs(counts, docs), fitted.weights, "term", "df", spread=["doc_id"])
    value = F.col("n" if "n" in counts.columns else "weight")
    sums = cells.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_terms"), *[F.sum(value * F.element_at("w", i + 1)).alias(f"s{i}") for i in range(len(intercepts))])
    scored = docs.select("doc_id").join(sums, "doc_id", "left")
    margins = [(F.coalesce(f"s{i}", F.lit(0.0)) + F.lit(b)).alias(f"m{i}") for i, b in enumerate(intercepts)]
    scored = scored.select("doc_id", *margins)
    out, first = [], 0
    for name, kind, machine in zip(fitted.names, fitted.kinds, fitted.machines, strict=True):
        here = [F.col(f"m{first + i}") for i in range(len(machine.heads))]
        first += len(here)
        out.append(_decision(machine, kind, here).alias(name))
    return scored.select("doc_id", *out)


@dataclass
class Outcome:
    """Result of one target."""

    target: str
    preds: DataFrame  # doc_id, target, pred
    metrics: DataFrame  # target, metric, value


def fit_and_predict(counts: DataFrame, labels: DataFrame, target: str, kind: str = BINARY, **how) -> Outcome:
    """Fit one target and predict the documents that have no label for it."""
    fitted = fit_targets(counts, labels, {target: kind}, **how)
    preds = predict_targets(fitted, counts, labels.where(F.col(target).isNull()))
    return Outcome(target, preds.select("doc_id", F.lit(target).alias("target"), F.col(target).alias("pred")), fitted.metrics)


def run_targets(targets: Sequence, fn: Callable, parallelism: int = 4) -> list:
    """Run one function per target from driver threads; the cluster shares their jobs."""
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        task = inheritable_thread_target(SparkSession.active())(fn)
        futures = [pool.submit(task, t) for t in targets]
        return [f.result() for f in futures]


def predict_all(counts: DataFrame, labels: DataFrame, targets: dict[str, str], **how) -> tuple[DataFrame, DataFrame]:
    """Every ``{target: kind}``: (predictions, metrics).

    All targets are fitted together on the features of documents with any label, and predicted in one
    pass over the documents that lack a label. A document keeps NULL where it has a label.
    """
    missing = F.lit(False)
    for t in targets:
        missing = missing | F.col(t).isNull()
    fitted = fit_targets(counts, labels, targets, **how)
    known = labels.select("doc_id", *[F.col(t).alias(f"_{t}") for t in targets])
    preds = predict_targets(fitted, counts, labels.where(missing)).join(known, "doc_id")
    return preds.select("doc_id", *[F.when(F.col(f"_{t}").isNull(), F.col(t)).alias(t) for t in targets]), fitted.metrics


def run_grid(
    variants: DataFrame,
    labels: DataFrame,
    targets: dict[str, str],
    names: Sequence[str] = ("all", "nostop", "stem", "tfidf"),
    algorithms: Sequence[str] = ("svm", "nb", "rf"),
    costs: Sequence[float] = COSTS,
    folds: int = FOLDS,
    max_iter: int = 100,
    num_trees: int = TREES,
    max_depth: int = DEPTH,
    parallelism: int = 4,
) -> DataFrame:
    """Every algorithm on every feature variant and target: ``(algorithm, variant, target, metric, value)``.

    Naive Bayes has no numeric target. Variants are written once; the rows of a variant are shared by all algorithms and
    targets, and its linear machines are fitted together.
    """
    labelled = F.lit(False)
    for t in targets:
        labelled = labelled | F.col(t).isNotNull()
    spark = variants.sparkSession
    stored = load_stage(spark, save_stage(dfm_docs(variants, labels.where(labelled)), new_path(spark, "variants"), "variant"))

    def one(name: str) -> DataFrame:
        counts = stored.where(F.col("variant") == name).select("doc_id", "term", F.col("weight").alias("n"))
        out = []
        if {"svm", "rf"} & set(algorithms):
            data = labelled_rows(counts, labels, targets, folds)
        if "svm" in algorithms:
            out.append(("svm", svm_metrics(data, svm_fit(data, costs, max_iter))))
        if "rf" in algorithms:
            out.append(("rf", rf_metrics(data, num_trees, max_depth)))
        for target, kind in targets.items():
            if "nb" in algorithms and kind != NUMERIC:
                ready = prepare_target(counts, labels, target, kind)
                model = nb_fit(ready.counts, ready.train, (1, 2, 3, 4, 5) if kind == ORDINAL else (0, 1))
                preds = nb_predict(model, dfm_docs(counts, ready.test), ready.test).join(ready.test, "doc_id")
                out.append(("nb", score(preds, kind, target)))
        table = None
        for algorithm, rows in out:
            part = rows.select(F.lit(algorithm).alias("algorithm"), F.lit(name).alias("variant"), *rows.columns)
            table = part if table is None else table.unionByName(part)
        return cut_lineage(table, "grid")

    first, *others = run_targets(names, one, parallelism)
    for table in others:
        first = first.unionByName(table)
    return first
