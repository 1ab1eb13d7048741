"""Classifiers, importance and language identification on small rows."""

import inspect
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tallyscribe.operators import bayes, importance, language, linear, merge, metrics, models, sampling, tokens

WORDS = {1: ["bad", "awful", "poor"], 0: ["good", "fine", "nice"]}


def build(n=120, unlabelled=20):
    """Documents whose class decides their words, plus a shared and a rare word."""
    rows, labels = [], []
    for i in range(n + unlabelled):
        y = 1 if i % 4 == 0 else 0
        terms = Counter([WORDS[y][i % 3], WORDS[y][(i + 1) % 3], "the", "the"])
        if i % 10 == 0:
            terms[WORDS[1 - y][0]] += 1
        rows += [(i, t, c) for t, c in terms.items()]
        labels.append((i, y if i < n else None, y))
    return rows, labels


@pytest.fixture(scope="module")
def data(spark):
    rows, labels = build()
    counts = spark.createDataFrame(rows, "doc_id long, term string, n long").cache()
    return counts, spark.createDataFrame(labels, "doc_id long, y int, truth int").cache(), rows, labels


def brute_bayes(rows, train, docs):
    """Scores by the textbook formula; ``train`` lists (doc, class) with repeats."""
    by_doc = defaultdict(Counter)
    for d, t, n in rows:
        by_doc[d][t] += n
    per = {0: Counter(), 1: Counter()}
    for d, y in train:
        per[y].update(by_doc[d])
    vocab = set(per[0]) | set(per[1])
    out = {}
    for d in docs:
        score = [
            sum(n * math.log((per[c][t] + 1) / (sum(per[c].values()) + len(vocab))) for t, n in by_doc[d].items() if t in vocab)
            for c in (0, 1)
        ]
        out[d] = 1 if score[1] > score[0] else 0
    return out, per, vocab


def test_bayes_with_copies(spark, data):
    counts, labels, rows, raw = data
    train = [(i, y) for i, y, _ in raw if y is not None and i % 2 == 0] + [(0, 1), (4, 1), (0, 1)]
    fitted = bayes.nb_fit(counts, spark.createDataFrame(train, "doc_id long, y int"), (0, 1))
    docs = labels.where("doc_id % 2 = 1")
    got = {r.doc_id: r.yhat for r in bayes.nb_predict(fitted, counts, docs).collect()}
    assert got == brute_bayes(rows, train, list(got))[0]


def test_bayes_unknown_document_takes_first_class(spark, data):
    counts, _, _, _ = data
    fitted = bayes.nb_fit(counts, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, y int"), (0, 1))
    row = bayes.nb_predict(fitted, counts, spark.createDataFrame([(999,)], "doc_id long")).first()
    assert (row.yhat, row.score) == (0, None)


def test_bayes_folds_equal_separate_fits(spark, data):
    counts, labels, rows, raw = data
    known = labels.where("y is not null").select("doc_id", "y")
    folds = sampling.assign_folds(known, "y", "doc_id", 3).cache()
    got = {r.doc_id: r.yhat for r in bayes.nb_cross_validate(counts, folds, (0, 1), 3).collect()}
    parts = {r.doc_id: (r.fold, r.y) for r in folds.collect()}
    for f in range(3):
        train = [(d, y) for d, (fold, y) in parts.items() if fold != f]
        inside = [d for d, (fold, _) in parts.items() if fold == f]
        assert {d: got[d] for d in inside} == brute_bayes(rows, train, inside)[0]


def test_metrics_with_an_empty_class(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 2)], "y int, yhat int")
    got = {r.metric: r.value for r in metrics.classification_metrics(df, "y", "yhat", (1, 2, 3, 4)).collect()}
    assert got["Accuracy"] == 0.5
    assert got["Precision_1"] == 1.0 and got["Recall_1"] == 0.5 and got["F1_1"] == pytest.approx(2 / 3)
    assert got["Precision_2"] == pytest.approx(1 / 3) and got["Recall_2"] == 1.0
    assert got["Precision_3"] is None and got["Recall_3"] == 0.0 and got["F1_3"] is None
    assert got["Precision_4"] is None and got["Recall_4"] is None


def test_permutation_importance_brute_force(spark, data):
    counts, labels, rows, raw = data
    train = [(i, 0, y) for i, y, _ in raw if y is not None] + [(i, 1, y) for i, y, _ in raw if y == 1]
    weights = {"bad": 2.0, "awful": 1.5, "poor": 0.5, "good": -1.0, "fine": -1.5, "nice": -0.25, "the": 0.01}
    w = spark.createDataFrame([(t, 10, v) for t, v in weights.items()], "term string, df long, w double")
    frame = spark.createDataFrame(train, "doc_id long, copy_no int, y int")
    got = {r.term: r.importance for r in importance.permutation_importance(counts, frame, w).collect()}

    from tallyscribe.functions import hashing

    order = frame.select(
        "doc_id", "copy_no", "y", hashing.key_hash(F.col("doc_id") + F.col("copy_no") * 7919, hashing.PERMUTE).alias("h")
    ).orderBy("h", "doc_id", "copy_no").collect()
    keys = {r.term: r.k for r in w.select("term", hashing.text_key(F.col("term")).alias("k")).collect()}
    by_doc = defaultdict(Counter)
    for d, t, n in rows:
        by_doc[d][t] += n
    size = len(order)

    def accuracy(permuted=None, shift=0):
        hits = 0
        for place, row in enumerate(order):
            values = dict(by_doc[row.doc_id])
            if permuted is not None:
                values[permuted] = by_doc[order[(place + shift) % size].doc_id][permuted]
            hits += (sum(weights[t] * n for t, n in values.items()) > 0) == (row.y == 1)
        return hits / size

    base = accuracy()
    for term in weights:
        assert got[term] == pytest.approx(base - accuracy(term, 1 + keys[term] % (size - 1)))


def test_top_k_is_exact_with_ties(spark):
    df = spark.createDataFrame([("a", f"t{i:02d}", i // 3) for i in range(30)], "target string, term string, v int")
    got = [r.term for r in importance.top_k(df, 4, "v", ["target"], ["term"]).orderBy("rank").collect()]
    assert got == ["t27", "t28", "t29", "t24"]


def test_vectors_hold_the_counts(spark, data):
    counts, labels, rows, _ = data
    index = models.term_index(tokens.vocabulary(counts)).cache()
    at = {r.term: r.idx for r in index.collect()}
    assert sorted(at.values()) == list(range(len(at)))
    docs = spark.createDataFrame([(0,), (1,), (999,)], "doc_id long")
    got = {r.doc_id: r.features for r in models.to_vectors(counts, index, docs).collect()}
    want = {at[t]: float(n) for d, t, n in rows if d == 1}
    assert dict(zip(got[1].indices.tolist(), got[1].values.tolist(), strict=True)) == want
    assert got[999].size == len(at) and got[999].numNonzeros() == 0


def test_svm_learns_and_predicts(spark, data):
    counts, labels, _, raw = data
    out = models.fit_and_predict(counts, labels, "y", costs=(0.1, 1.0), folds=2, max_iter=10, leak_safe=True)
    truth = {i: t for i, _, t in raw}
    preds = {r.doc_id: r.pred for r in out.preds.collect()}
    assert set(preds) == set(range(120, 140))
    assert sum(preds[d] == truth[d] for d in preds) >= 19
    got = {r.metric: r.value for r in out.metrics.collect()}
    assert got["Accuracy"] > 0.9 and set(got) == {"Accuracy", "Precision_2", "Recall_2", "F1_2"}


def test_joined_weights_predict_like_the_machines(spark, data):
    """One pass over the long table gives what the machines give on rows."""
    counts, labels, _, _ = data
    both = labels.withColumn("z", F.when(F.col("y").isNotNull(), F.col("doc_id") % 3 + 1).cast("int"))
    fitted = models.fit_targets(counts, both, {"y": models.BINARY, "z": models.ORDINAL}, costs=(1.0,), max_iter=10)
    preds = models.predict_targets(fitted, counts, both.where("y is null"))
    got = {r.doc_id: (r.y, r.z) for r in preds.collect()}
    assert set(got) == set(range(120, 140))
    assert {r.target for r in fitted.metrics.collect()} == {"y", "z"}
    terms = [r.term for r in models.term_index(tokens.vocabulary(counts)).orderBy("idx").collect()]
    table = {r.term: r.w for r in fitted.weights.collect()}
    first = 0
    for at, m in enumerate(fitted.machines):
        w = np.array([[table[t][first + h] for t in terms] for h in range(len(m.heads))])
        first += len(m.heads)
        rows = defaultdict(dict)
        for r in counts.where("doc_id >= 120").collect():
            rows[r.doc_id][r.term] = r.n
        x = np.array([[rows[d].get(t, 0) for t in terms] for d in sorted(rows)], float)
        want = linear.decide(x @ w.T + m.weights[:, -1], m.heads, m.classes)
        assert [got[d][at] for d in sorted(rows)] == want.tolist()


def test_cascade_gate(spark):
    preds = spark.createDataFrame([(1, 0, 1.0, 1.0), (2, 1, 1.0, 0.0), (3, 0, 2.0, 0.0), (4, 0, 1.0, 1.4), (5, None, None, None)], "doc_id long, flag int, scale double, scale_m double")
    hand = spark.createDataFrame([(2, 1, 1), (6, 1, 1), (7, 1, 0), (8, 0, 1)], "doc_id long, label int, on_target int")
    assert sorted(r.doc_id for r in merge.cascade_ids(preds, hand).collect()) == [2, 3, 4, 6]


def test_final_ids_are_unique(spark):
    posts = spark.createDataFrame([(i, "t") for i in range(6)], "doc_id long, text string")
    preds = spark.createDataFrame([(i, float(3 * i)) for i in range(6)], "doc_id long, scale_m double")
    hand = spark.createDataFrame([(1, "t", 2.5, 1)], "doc_id long, text string, scale_m double, x1_a int")
    got = {r.doc_id: r.scale_m for r in merge.finalize(posts, preds, hand).collect()}
    assert got == {0: 1.0, 1: 2.5, 2: 5.0, 3: 5.0, 4: 5.0, 5: 5.0}


def test_language_is_recognised(spark):
    known = [
        ("en", "the cat sat on the mat and the dog ran to the house with a ball of string that was there"),
        ("de", "der hund und die katze sind nicht in dem haus aber das kind ist mit einem ball auf der straße"),
        ("fr", "le chat est sur la table et le chien est dans la maison avec une balle pour les enfants du quartier"),
    ]
    profiles = language.language_profiles(spark.createDataFrame(known, "lang string, text string"))
    docs = spark.createDataFrame([(1, "the house of the dog"), (2, "das haus ist nicht mit der katze"), (3, "le chien est dans la maison")], "doc_id long, text string")
    got = {r.doc_id: r.detected_lang for r in language.identify_language(docs, profiles, ["de", "en", "fr"]).collect()}
    assert got == {1: "en", 2: "de", 3: "fr"}


@pytest.mark.parametrize("name", ["k2_linear_svm", "k3_ordinal_svm", "k4_scale_regression", "k5_random_forest", "k7_experiment_grid", "k8_fit_and_predict", "k10_predict_all"])
def test_model_queries_do_the_whole_job(spark, monkeypatch, name):
    """Queries call the operators with their defaults; nothing is fitted here."""
    metrics_ = spark.createDataFrame([], "target string, metric string, value double")
    made = {
        "labelled_rows": None, "svm_fit": None, "svm_metrics": metrics_, "rf_metrics": metrics_, "run_grid": metrics_,
        "fit_and_predict": models.Outcome("toxic", spark.range(0), spark.range(0)), "predict_all": (spark.createDataFrame([], "doc_id bigint"), None),
    }
    calls = []

    def stand_in(fn, out):
        def call(*args, **kwargs):
            bound = inspect.signature(fn).bind(*args, **kwargs).arguments
            calls.append((fn.__name__, set(bound) | set(bound.get("how", {}))))
            return out

        return call

    for fn, out in made.items():
        monkeypatch.setattr(models, fn, stand_in(getattr(models, fn), out))
    contract.queries()[name](spark, "/root/testdata/sf0.001")
    assert calls and not any(given & {"costs", "folds", "max_iter", "num_trees", "max_depth", "how", "p"} for _, given in calls)


def test_tuned_query_for_real(spark):
    rows = {(r.target, r.metric): r.value for r in contract.queries()["k2_linear_svm"](spark, "/root/testdata/sf0.001").collect()}
    assert set(rows) == {("toxic", m) for m in ("Accuracy", "Precision_2", "Recall_2", "F1_2")} and rows["toxic", "Accuracy"] > 0.8


def test_every_naive_bayes_target_is_run(spark):
    rows = contract.queries()["x2_run_targets"](spark, "/root/testdata/sf0.001").select("target").distinct().collect()
    assert {r.target for r in rows} == {"toxic", "quality", "degree"}
