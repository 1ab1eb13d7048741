"""Queries for sampling, classifiers, metrics, cascade and importance.

Targets on the documents: ``toxic`` (binary), ``degree`` (five classes, noise by construction) and
``size_k`` (numeric).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyscribe.functions import hashing
from tallyscribe.operators import bayes, importance, merge, metrics, models, sampling, tokens
from tallyscribe.plans.fixtures import Inputs, register
from tallyscribe.plans.q_text import content, trimmed
from tallyscribe.plans.registry import query, r6, rounded, s6
from tallyscribe.sources.storage import cut_lineage

TRAIN_BELOW = int(0.8 * hashing.SPAN)


def h(key: str, purpose: int) -> str:
    return f"((({key}) % 2147483648) * {purpose}) % 4294967296"


register("labelled", "SELECT doc_id, toxic AS y FROM labels")
TRAIN_ONCE = f"SELECT doc_id, y FROM labelled WHERE {h('doc_id', hashing.SPLIT)} < {TRAIN_BELOW}"
register("train_once", TRAIN_ONCE, "labelled")
register("test_docs", f"SELECT doc_id, y FROM labelled WHERE {h('doc_id', hashing.SPLIT)} >= {TRAIN_BELOW}", "labelled")


def _upsampled(frm: str) -> str:
    """Copies listed in (copy_no, hash) order per class, as many as the largest class has."""
    return f"""SELECT doc_id, y, copy_no FROM (
        SELECT *, row_number() OVER (PARTITION BY y ORDER BY copy_no, hash, doc_id) AS nr FROM (
          SELECT doc_id, y, size, most, {h("doc_id", hashing.UPSAMPLE)} AS hash, unnest(range(0, CAST(ceil(most / size::DOUBLE) AS BIGINT))) AS copy_no FROM (
            SELECT *, count(*) OVER (PARTITION BY y) AS size,
              (SELECT max(c) FROM (SELECT count(*) AS c FROM {frm} GROUP BY y) m) AS most FROM {frm}) a) b) c WHERE nr <= most"""


register("train_docs", _upsampled("train_once"), "train_once")
NB_TERMS = """SELECT term, sum(CASE WHEN y = 0 THEN n ELSE 0 END)::DOUBLE AS n0, sum(CASE WHEN y = 1 THEN n ELSE 0 END)::DOUBLE AS n1
       FROM trimmed JOIN train_docs USING (doc_id) GROUP BY term"""
NB_WEIGHTS = """SELECT term, ln((n0 + 1) / (sum(n0) OVER () + count(*) OVER ())) AS w0, ln((n1 + 1) / (sum(n1) OVER () + count(*) OVER ())) AS w1 FROM nb_terms"""
register("nb_terms", NB_TERMS, "trimmed", "train_docs")
register("nb_weights", NB_WEIGHTS, "nb_terms")
register(
    "nb_predictions",
    """SELECT d.doc_id, d.y, CASE WHEN s1 > s0 THEN 1 ELSE 0 END AS yhat, greatest(s0, s1) AS score FROM test_docs d LEFT JOIN (
         SELECT doc_id, sum(n * w0) AS s0, sum(n * w1) AS s1 FROM trimmed JOIN nb_weights USING (term) GROUP BY doc_id) s USING (doc_id)""",
    "test_docs",
    "trimmed",
    "nb_weights",
)


def _toxic(x: Inputs):
    return x.docs().select("doc_id", "toxic")


def _features(x: Inputs, ids=None):
    """The feature table, stored once; with ``ids`` that of the documents listed there."""
    return cut_lineage(trimmed(x, ids), "features")


def _known(docs, names):
    """The documents with a label of any of these names."""
    return docs.where(F.coalesce(*[F.col(c).cast("double") for c in names]).isNotNull()).select("doc_id")


def _ready(x: Inputs) -> models.Target:
    return models.prepare_target(_features(x), _toxic(x), "toxic")


def _nb_test(x: Inputs):
    ready = _ready(x)
    model = bayes.nb_fit(ready.counts, ready.train, (0, 1))
    return bayes.nb_predict(model, tokens.dfm_docs(ready.counts, ready.test), ready.test).join(ready.test, "doc_id")


# ---- sampling ----------------------------------------------------------------------------


@query(
    "m1_stratified_sample",
    "docs",
    f"""SELECT doc_id, date FROM (SELECT doc_id, date, row_number() OVER (PARTITION BY date ORDER BY {h("doc_id", hashing.SAMPLE)}, doc_id) AS nr,
        count(*) OVER (PARTITION BY date) AS size FROM docs) t WHERE nr <= round_even(0.3::DOUBLE * size, 0)""",
)
def _(x):
    return sampling.stratified_sample(x.docs().select("doc_id", "date"), ["date"], 0.3, "doc_id")


@query(
    "m2_train_test_split",
    "docs",
    f"SELECT doc_id, CASE WHEN {h('doc_id', hashing.SPLIT)} < {TRAIN_BELOW} THEN 'train' ELSE 'test' END AS part FROM docs",
)
def _(x):
    train, test = sampling.train_test_split(x.docs().select("doc_id"), "doc_id")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("m3_upsample", "labelled", "SELECT doc_id, y, CAST(copy_no AS INT) AS copy_no FROM (" + _upsampled("labelled") + ") t")
def _(x):
    return sampling.upsample(x.table("labels").select("doc_id", F.col("toxic").alias("y")), "y", "doc_id")


@query(
    "m4_assign_folds",
    "docs",
    f"""SELECT doc_id, lang, CAST((row_number() OVER (PARTITION BY lang ORDER BY {h("doc_id", hashing.FOLD)}, doc_id) - 1) % 10 AS INT) AS fold FROM docs""",
)
def _(x):
    return sampling.assign_folds(x.docs().select("doc_id", "lang"), "lang", "doc_id", 10)


# ---- naive Bayes and its scores ----------------------------------------------------------


@query(
    "k6_prepare_target",
    "labelled train_docs test_docs trimmed docs",
    """WITH v AS (SELECT DISTINCT term FROM trimmed WHERE doc_id IN (SELECT doc_id FROM train_docs)),
         f AS (SELECT doc_id, count(*) AS n_terms, CAST(sum(n) AS BIGINT) AS total FROM trimmed JOIN v USING (term) GROUP BY doc_id),
         p AS (SELECT 'train' AS part, doc_id, y, CAST(copy_no AS INT) AS copy_no FROM train_docs UNION ALL SELECT 'test', doc_id, y, NULL FROM test_docs
               UNION ALL SELECT 'unlabelled', doc_id, NULL, NULL FROM docs WHERE toxic IS NULL)
       SELECT part, doc_id, coalesce(y, -1) AS y, coalesce(copy_no, -1) AS copy_no, coalesce(n_terms, 0) AS n_terms, coalesce(total, 0) AS total
       FROM p LEFT JOIN f USING (doc_id)""",
)
def _(x):
    ready = _ready(x)
    size = ready.matched().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("n").alias("total"))
    parts = ready.train.select(F.lit("train").alias("part"), "doc_id", "y", "copy_no")
    parts = parts.unionByName(ready.test.select(F.lit("test").alias("part"), "doc_id", "y"), allowMissingColumns=True)
    parts = parts.unionByName(ready.unlabelled.select(F.lit("unlabelled").alias("part"), "doc_id"), allowMissingColumns=True)
    return parts.join(size, "doc_id", "left").fillna(-1, ["y", "copy_no"]).fillna(0, ["n_terms", "total"])


@query("k1_naive_bayes", "nb_predictions", f"SELECT doc_id, y, yhat, {s6('score', 'score')} FROM nb_predictions")
def _(x):
    return rounded(_nb_test(x).select("doc_id", "y", "yhat", "score"), ["score"])


@query(
    "k1_naive_bayes_weights",
    "nb_weights",
    f"SELECT term, {s6('w0', 'w0')}, {s6('w1', 'w1')} FROM nb_weights",
)
def _(x):
    ready = _ready(x)
    w = bayes.nb_fit(ready.counts, ready.train, (0, 1)).weights
    return w.select("term", r6(F.element_at("w", 1)).alias("w0"), r6(F.element_at("w", 2)).alias("w1"))


@query(
    "a20_rmse",
    "docs",
    f"SELECT {s6('sqrt(avg(pow(size_k - (1 + quality * 2 - toxic), 2)))', 'value')} FROM docs WHERE toxic IS NOT NULL",
)
def _(x):
    labelled = x.docs().where(F.col("toxic").isNotNull()).withColumn("yhat", 1 + F.col("quality") * 2 - F.col("toxic"))
    return rounded(metrics.rmse(labelled, "size_k", "yhat"), ["value"])


def _class_sql(frm: str, c: int) -> str:
    tp, pp, ap = (
        f"sum(CASE WHEN y = {c} AND yhat = {c} THEN 1 ELSE 0 END)::DOUBLE",
        f"nullif(sum(CASE WHEN yhat = {c} THEN 1 ELSE 0 END), 0)::DOUBLE",
        f"nullif(sum(CASE WHEN y = {c} THEN 1 ELSE 0 END), 0)::DOUBLE",
    )
    return f"""SELECT lang, 'Precision_{c}' AS metric, round({tp} / {pp}, 6) + 0.0 AS value FROM {frm} GROUP BY lang
        UNION ALL SELECT lang, 'Recall_{c}', round({tp} / {ap}, 6) + 0.0 FROM {frm} GROUP BY lang
        UNION ALL SELECT lang, 'F1_{c}', round(2 * {tp} / ({pp} + {ap}), 6) + 0.0 FROM {frm} GROUP BY lang"""


@query(
    "a21_classification_metrics",
    "docs",
    """WITH p AS (SELECT coalesce(lang, 'none') AS lang, degree AS y, CAST(1 + (doc_id * 7) % 4 AS INT) AS yhat FROM docs WHERE degree IS NOT NULL)
       SELECT lang, 'Accuracy' AS metric, round(avg(CASE WHEN y = yhat THEN 1.0::DOUBLE ELSE 0.0 END), 6) + 0.0 AS value FROM p GROUP BY lang UNION ALL """
    + " UNION ALL ".join(_class_sql("p", c) for c in (1, 2, 3, 4, 5)),
)
def _(x):
    p = x.docs().where(F.col("degree").isNotNull()).select(
        F.coalesce("lang", F.lit("none")).alias("lang"), F.col("degree").alias("y"), (1 + (F.col("doc_id") * 7) % 4).cast("int").alias("yhat")
    )
    return rounded(metrics.classification_metrics(p, "y", "yhat", (1, 2, 3, 4, 5), by=["lang"]), ["value"])


def _binary_sql(frm: str, where: str = "") -> str:
    tp, pp, ap = (
        f"(SELECT count(*)::DOUBLE FROM {frm} WHERE y = 1 AND yhat = 1 {where})",
        f"(SELECT nullif(count(*), 0)::DOUBLE FROM {frm} WHERE yhat = 1 {where})",
        f"(SELECT nullif(count(*), 0)::DOUBLE FROM {frm} WHERE y = 1 {where})",
    )
    return f"""SELECT 'Accuracy' AS metric, (SELECT avg(CASE WHEN y = yhat THEN 1.0::DOUBLE ELSE 0.0 END) FROM {frm} WHERE TRUE {where}) AS value
        UNION ALL SELECT 'Precision_2', {tp} / {pp} UNION ALL SELECT 'Recall_2', {tp} / {ap} UNION ALL SELECT 'F1_2', 2 * {tp} / ({pp} + {ap})"""


@query("a21_binary_metrics", "nb_predictions", f"SELECT metric, {s6('value', 'value')} FROM (" + _binary_sql("nb_predictions") + ") t")
def _(x):
    scores = metrics.classification_metrics(_nb_test(x), "y", "yhat", (1,))
    return rounded(metrics.binary_slots(scores, 1), ["value"])


FOLDS = 10
register(
    "folds",
    f"SELECT doc_id, y, (row_number() OVER (PARTITION BY y ORDER BY {h('doc_id', hashing.FOLD)}, doc_id) - 1) % {FOLDS} AS fold FROM labelled",
    "labelled",
)
register(
    "cv_predictions",
    " UNION ALL ".join(
        f"""SELECT d.doc_id, d.fold, d.y, CASE WHEN s1 > s0 THEN 1 ELSE 0 END AS yhat FROM folds d LEFT JOIN (
              SELECT t.doc_id, sum(t.n * ln((n0 + 1) / (t0 + v))) AS s0, sum(t.n * ln((n1 + 1) / (t1 + v))) AS s1 FROM trimmed t JOIN (
                SELECT term, n0, n1, sum(n0) OVER () AS t0, sum(n1) OVER () AS t1, count(*) OVER () AS v FROM (
                  SELECT term, sum(CASE WHEN y = 0 THEN n ELSE 0 END)::DOUBLE AS n0, sum(CASE WHEN y = 1 THEN n ELSE 0 END)::DOUBLE AS n1
                  FROM trimmed JOIN folds USING (doc_id) WHERE fold <> {k} GROUP BY term) a) w USING (term) GROUP BY t.doc_id) s USING (doc_id)
            WHERE d.fold = {k}"""
        for k in range(FOLDS)
    ),
    "folds",
    "trimmed",
)


def _cv(x: Inputs):
    labelled = x.table("labels").select("doc_id", F.col("toxic").alias("y"))
    folds = sampling.assign_folds(labelled, "y", "doc_id", FOLDS)
    return bayes.nb_cross_validate(_features(x, labelled), folds, (0, 1), FOLDS)


@query("k1_naive_bayes_folds", "cv_predictions", "SELECT doc_id, CAST(fold AS INT) AS fold, y, yhat FROM cv_predictions")
def _(x):
    return _cv(x).select("doc_id", "fold", "y", "yhat")


@query(
    "a22_mean_metrics",
    "cv_predictions",
    f"SELECT metric, {s6('avg(value)', 'value')} FROM ("
    + " UNION ALL ".join(f"SELECT * FROM ({_binary_sql('cv_predictions', f'AND fold = {k}')}) f{k}" for k in range(FOLDS))
    + ") t GROUP BY metric",
)
def _(x):
    scores = metrics.binary_slots(metrics.classification_metrics(_cv(x), "y", "yhat", (1,), by=["fold"]), 1)
    return rounded(metrics.mean_metrics(scores, []), ["value"])


# ---- tables of predictions and metrics ---------------------------------------------------

register(
    "preds",
    """SELECT doc_id, 'flag' AS target, CASE WHEN doc_id % 5 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS pred FROM docs WHERE toxic IS NULL UNION ALL
       SELECT doc_id, 'scale', (1 + doc_id % 3)::DOUBLE FROM docs WHERE toxic IS NULL UNION ALL
       SELECT doc_id, 'scale_m', length(text) / 1000.0::DOUBLE FROM docs WHERE toxic IS NULL AND true_lang = 'en'""",
    "docs",
)
register(
    "wide_preds",
    """SELECT doc_id, max(CASE WHEN target = 'flag' THEN pred END) AS flag, max(CASE WHEN target = 'scale' THEN pred END) AS scale,
       max(CASE WHEN target = 'scale_m' THEN pred END) AS scale_m FROM preds GROUP BY doc_id""",
    "preds",
)
PRED_TARGETS = ("flag", "scale", "scale_m")


def _preds(x: Inputs):
    d = x.docs().where(F.col("toxic").isNull())
    rules = {
        "flag": F.when(F.col("doc_id") % 5 == 0, 1.0).otherwise(0.0),
        "scale": (1 + F.col("doc_id") % 3).cast("double"),
        "scale_m": F.when(F.col("true_lang") == "en", F.length("text") / 1000.0),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("target"), v.alias("pred")) for k, v in rules.items()])).alias("p")
    one = d.select("doc_id", rows).select("doc_id", "p.target", "p.pred")
    return one.where((F.col("target") != "scale_m") | F.col("pred").isNotNull())


@query(
    "j6_assemble_predictions",
    "docs wide_preds",
    f"SELECT d.doc_id, p.flag, p.scale, {s6('p.scale_m', 'scale_m')} FROM docs d LEFT JOIN wide_preds p USING (doc_id)",
)
def _(x):
    return rounded(merge.assemble_predictions(x.docs().select("doc_id"), _preds(x), PRED_TARGETS), ["scale_m"])


def _scores(x: Inputs):
    """Metrics of three targets that share one prediction rule, long form."""
    d = x.docs().where(F.col("toxic").isNotNull())
    truth = {"toxic": F.col("toxic"), "quality": F.col("quality"), "third": (F.col("doc_id") % 3 == 0).cast("int")}
    guess = (F.col("doc_id") % 2).cast("int")
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("target"), v.alias("y")) for k, v in truth.items()])).alias("t")
    p = d.select(rows, guess.alias("yhat")).select("t.target", "t.y", "yhat")
    return metrics.binary_slots(metrics.classification_metrics(p, "y", "yhat", (1,), by=["target"]), 1)


register(
    "scored",
    """SELECT 'toxic' AS target, toxic AS y, doc_id % 2 AS yhat FROM docs WHERE toxic IS NOT NULL UNION ALL
       SELECT 'quality', quality, doc_id % 2 FROM docs WHERE toxic IS NOT NULL UNION ALL
       SELECT 'third', CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END, doc_id % 2 FROM docs WHERE toxic IS NOT NULL""",
    "docs",
)
TARGETS = ("toxic", "quality", "third")
register(
    "scores",
    " UNION ALL ".join(f"SELECT '{t}' AS target, metric, value FROM ({_binary_sql('scored', f'''AND target = '{t}' ''')}) {t}" for t in TARGETS),
    "scored",
)
ALL_METRICS_SQL = "(VALUES " + ", ".join(f"('{m}')" for m in metrics.METRICS) + ") AS m(metric)"


@query(
    "j7_assemble_metrics",
    "scores",
    "SELECT m.metric, "
    + ", ".join(f"max(CASE WHEN target = '{t}' THEN round(value, 6) + 0.0 END) AS {t}" for t in TARGETS)
    + f" FROM {ALL_METRICS_SQL} LEFT JOIN scores s ON s.metric = m.metric GROUP BY m.metric",
)
def _(x):
    full = metrics.scaffold(_scores(x), ["target"])
    return rounded(metrics.assemble_metrics(full, TARGETS), TARGETS)


@query(
    "p3_transpose_metrics",
    "scores",
    "SELECT target, "
    + ", ".join(f'max(CASE WHEN metric = \'{m}\' THEN round(value, 6) + 0.0 END) AS "{m}"' for m in ("Accuracy", "Precision_2", "Recall_2", "F1_2"))
    + " FROM scores GROUP BY target",
)
def _(x):
    names = ("Accuracy", "Precision_2", "Recall_2", "F1_2")
    return rounded(metrics.transpose_metrics(metrics.assemble_metrics(_scores(x), TARGETS), TARGETS, names), names)


@query(
    "p4_report_columns",
    "scores",
    """SELECT metric AS measure, max(CASE WHEN target = 'quality' THEN round(value, 6) + 0.0 END) AS good,
       max(CASE WHEN target = 'toxic' THEN round(value, 6) + 0.0 END) AS bad FROM scores GROUP BY metric""",
)
def _(x):
    table = metrics.assemble_metrics(_scores(x), TARGETS)
    return rounded(metrics.report_columns(table, {"metric": "measure", "quality": "good", "toxic": "bad"}), ["good", "bad"])


@query(
    "k12_performance_report",
    "scores",
    "SELECT target, "
    + ", ".join(f"round_even(max(CASE WHEN metric = '{m}' THEN value END), 2) AS {a}" for m, a in [("Accuracy", "accuracy"), ("Precision_2", "precision"), ("Recall_2", "recall"), ("F1_2", "f1")])
    + " FROM scores WHERE target <> 'third' GROUP BY target",
)
def _(x):
    return metrics.performance_report(_scores(x), ["toxic", "quality"])


ALGORITHMS, VARIANTS = ("svm", "nb", "rf"), ("all", "nostop", "stem", "tfidf")
RUNS = [(a, v) for a in ALGORITHMS for v in VARIANTS]
register(
    "grid_scored",
    """SELECT a.algorithm || '|' || v.variant AS target, toxic AS y, ((doc_id * (2 * a.k + 3) + v.k * 7) % 5 < 1 + a.k + toxic)::INT AS yhat FROM docs,
       (VALUES ('svm', 0), ('nb', 1), ('rf', 2)) AS a(algorithm, k), (VALUES ('all', 0), ('nostop', 1), ('stem', 2), ('tfidf', 3)) AS v(variant, k) WHERE toxic IS NOT NULL""",
    "docs",
)


@query(
    "j7_compare_algorithms",
    "grid_scored",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS algorithm, '{v}' AS variant, round_even(max(CASE WHEN metric = 'Accuracy' THEN value END), 2) AS accuracy, round_even(max(CASE WHEN metric = 'Precision_2' THEN value END), 2) AS precision,
            round_even(max(CASE WHEN metric = 'Recall_2' THEN value END), 2) AS recall, round_even(max(CASE WHEN metric = 'F1_2' THEN value END), 2) AS f1 FROM ({_binary_sql('grid_scored', f"AND target = '{a}|{v}'")}) t"""
        for a, v in RUNS
    ),
)
def _(x):
    """Three algorithms on four feature variants side by side, from the long metrics of a grid."""
    d = x.docs().where(F.col("toxic").isNotNull())
    cells = [F.struct(F.lit(a).alias("algorithm"), F.lit(v).alias("variant"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, a in enumerate(ALGORITHMS) for k, v in enumerate(VARIANTS)]
    rows = d.select("doc_id", F.col("toxic").alias("y"), F.explode(F.array(*cells)).alias("c")).select("doc_id", "y", "c.*")
    guess = ((F.col("doc_id") * (2 * F.col("i") + 3) + F.col("k") * 7) % 5 < 1 + F.col("i") + F.col("y")).cast("int")
    by = ["algorithm", "variant"]
    scores = metrics.binary_slots(metrics.classification_metrics(rows.withColumn("yhat", guess), "y", "yhat", (1,), by=by), 1)
    return metrics.compare_algorithms(scores.withColumn("target", F.lit("toxic")), "toxic", RUNS)


# ---- cascade and final data set ----------------------------------------------------------

register(
    "second_stage",
    """SELECT doc_id FROM wide_preds WHERE flag = 1 OR scale <> 1 OR scale_m > 1 UNION SELECT doc_id FROM labels WHERE toxic = 1 AND quality = 1""",
    "wide_preds",
)


def _second_stage(x: Inputs):
    wide = _preds(x).groupBy("doc_id").pivot("target", list(PRED_TARGETS)).agg(F.first("pred"))
    return merge.cascade_ids(wide, x.table("labels"), label="toxic", on_target="quality")


@query(
    "k9_cascade",
    "content second_stage",
    """WITH c AS (SELECT doc_id, term, n FROM content WHERE doc_id IN (SELECT doc_id FROM second_stage))
       SELECT doc_id, term, n FROM c WHERE term IN (SELECT term FROM c GROUP BY term HAVING sum(n) >= 2 AND count(*) >= 2)""",
)
def _(x):
    return tokens.dfm_trim(tokens.dfm_docs(content(x), _second_stage(x)), 2, 2)


@query(
    "u3_finalize",
    "docs wide_preds",
    """SELECT d.doc_id, d.lang, p.flag, p.scale, CASE WHEN p.scale_m > 5 THEN 5 WHEN p.scale_m < 1 THEN 1 ELSE round(p.scale_m, 6) + 0.0 END AS scale_m
         FROM docs d LEFT JOIN wide_preds p USING (doc_id) WHERE d.toxic IS NULL
       UNION ALL SELECT doc_id, lang, toxic::DOUBLE, degree::DOUBLE, round(size_k, 6) + 0.0 FROM docs WHERE toxic IS NOT NULL""",
)
def _(x):
    d = x.docs()
    posts = d.select("doc_id", "lang")
    preds = _preds(x).groupBy("doc_id").pivot("target", list(PRED_TARGETS)).agg(F.first("pred"))
    hand = d.where(F.col("toxic").isNotNull()).select(
        "doc_id", "lang", F.col("toxic").cast("double").alias("flag"), F.col("degree").cast("double").alias("scale"), F.col("size_k").alias("scale_m"), F.col("quality").alias("x1_quality")
    )
    return rounded(merge.finalize(posts, preds, hand), ["scale_m"])


# ---- importance --------------------------------------------------------------------------

register(
    "placed",
    f"""SELECT doc_id, copy_no, y, row_number() OVER (ORDER BY {h("doc_id + copy_no * 7919", hashing.PERMUTE)}, doc_id, copy_no) - 1 AS place,
        count(*) OVER () AS size FROM train_docs""",
    "train_docs",
)
register(
    "importance",
    """SELECT term, CAST(sum(CASE WHEN (margin > 0) = (y = 1) THEN 1 ELSE 0 END - CASE WHEN (margin + d > 0) = (y = 1) THEN 1 ELSE 0 END) AS DOUBLE)
         / any_value(size) AS importance FROM (
           SELECT term, place, any_value(size) AS size, sum(d) AS d FROM (
             SELECT term, size, place, -part AS d FROM cells UNION ALL
             SELECT term, size, ((place - 1 - ('0x' || substr(md5(term), 1, 8))::BIGINT % greatest(size - 1, 1)) % size + size) % size, part FROM cells) a
           GROUP BY term, place) b
         JOIN (SELECT p.place, p.y, coalesce(sum(c.part), 0) AS margin FROM placed p LEFT JOIN cells c ON c.place = p.place GROUP BY 1, 2) m USING (place)
       GROUP BY term""",
    "cells",
)
register("cells", "SELECT p.place, p.size, t.term, t.n * (w1 - w0) AS part FROM placed p JOIN trimmed t USING (doc_id) JOIN nb_weights USING (term)", "placed", "trimmed", "nb_weights")


def _importance(x: Inputs):
    toxic = _toxic(x)
    ready = models.prepare_target(_features(x, _known(toxic, ["toxic"])), toxic, "toxic")
    w = bayes.nb_fit(ready.counts, ready.train, (0, 1)).weights
    linear = w.select("term", "df", (F.element_at("w", 2) - F.element_at("w", 1)).alias("w"))
    counts = tokens.dfm_docs(ready.counts, ready.train)
    return importance.permutation_importance(counts, ready.train, linear)


@query("k11_permutation_importance", "importance", f"SELECT term, {s6('importance', 'importance')} FROM importance")
def _(x):
    return rounded(_importance(x), ["importance"])


QUALITY = {
    "train_once_q": TRAIN_ONCE.replace("y FROM labelled", "quality AS y FROM labels"),
    "train_docs_q": _upsampled("train_once_q"),
    "nb_terms_q": NB_TERMS.replace("train_docs", "train_docs_q"),
    "nb_weights_q": NB_WEIGHTS.replace("nb_terms", "nb_terms_q"),
}
for _name, _needs in zip(QUALITY, ([], ["train_once_q"], ["trimmed", "train_docs_q"], ["nb_terms_q"]), strict=True):
    register(_name, QUALITY[_name], *_needs)
register(
    "places",
    f"""SELECT doc_id, row_number() OVER (ORDER BY {h("doc_id", hashing.PERMUTE)}, doc_id) - 1 AS place, count(*) OVER () AS size FROM train_once""",
    "train_once",
)


def _lost_sql(target: str, suffix: str) -> str:
    """Importance of one target's naive Bayes weights: documents at places, weighed by their copies."""
    return f"""SELECT '{target}' AS target, term, CAST(sum(copies * (CASE WHEN (margin > 0) = (y = 1) THEN 1 ELSE 0 END - CASE WHEN (margin + d > 0) = (y = 1) THEN 1 ELSE 0 END)) AS DOUBLE)
         / (SELECT count(*) FROM train_docs{suffix}) AS importance FROM (
           SELECT term, place, sum(d) AS d FROM (
             SELECT term, place, -part AS d FROM (SELECT p.place, p.size, t.term, t.n * (w1 - w0) AS part FROM places p JOIN trimmed t USING (doc_id) JOIN nb_weights{suffix} USING (term)) c UNION ALL
             SELECT term, ((place - 1 - ('0x' || substr(md5(term), 1, 8))::BIGINT % greatest(size - 1, 1)) % size + size) % size, part
             FROM (SELECT p.place, p.size, t.term, t.n * (w1 - w0) AS part FROM places p JOIN trimmed t USING (doc_id) JOIN nb_weights{suffix} USING (term)) c) a
           GROUP BY term, place) b
         JOIN (SELECT p.place, o.y, (SELECT count(*) FROM train_docs{suffix} u WHERE u.doc_id = p.doc_id) AS copies, coalesce(s.margin, 0) AS margin
               FROM places p JOIN train_once{suffix} o USING (doc_id) LEFT JOIN (
                 SELECT doc_id, sum(t.n * (w1 - w0)) AS margin FROM trimmed t JOIN nb_weights{suffix} USING (term) GROUP BY doc_id) s USING (doc_id)) m USING (place)
       GROUP BY term"""


@query(
    "k11_importance_top10",
    "places train_docs train_once train_docs_q train_once_q nb_weights nb_weights_q trimmed",
    f"""SELECT target, term, round(importance, 6) + 0.0 AS importance, CAST(rank AS INT) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(importance, 9) DESC, term) AS rank
          FROM ({_lost_sql('toxic', '')} UNION ALL {_lost_sql('quality', '_q')}) l) t WHERE rank <= 10""",
)
def _(x):
    """The ten most important terms of each target, both from one pass."""
    targets = {"toxic": models.BINARY, "quality": models.BINARY}
    docs = x.docs().select("doc_id", *targets)
    feats = _features(x, _known(docs, targets))
    data = models.labelled_rows(feats, docs, targets)
    weights = None
    for at, name in enumerate(targets):
        copies = F.aggregate(f"t{at}.copies", F.lit(0), lambda a, c: a + c)
        train = data.rows.where(f"t{at}.train").select("doc_id", F.col(f"t{at}.y").cast("int").alias("y"), F.explode(F.sequence(F.lit(1), copies)))
        w = bayes.nb_fit(feats, train, (0, 1)).weights.select("term", "df", (F.element_at("w", 2) - F.element_at("w", 1)).alias(f"w{at}"))
        weights = w if weights is None else weights.join(w.drop("df"), "term")
    weights = cut_lineage(weights.select("term", "df", F.array("w0", "w1").alias("w")), "weights")
    lost = importance.importance_of_targets(feats, data.rows, weights, list(targets)).withColumn("_by", F.round("importance", 9))
    return rounded(importance.top_k(lost, 10, "_by", ["target"], ["term"]).drop("_by"), ["importance"])


@query(
    "o2_top_k",
    "content docs",
    """SELECT true_lang AS lang, term, n, CAST(rank AS INT) AS rank FROM (SELECT true_lang, term, CAST(sum(n) AS BIGINT) AS n,
         row_number() OVER (PARTITION BY true_lang ORDER BY sum(n) DESC, term) AS rank FROM content JOIN docs USING (doc_id) GROUP BY 1, 2) t WHERE rank <= 10""",
)
def _(x):
    sums = content(x).join(x.docs().select("doc_id", F.col("true_lang").alias("lang")), "doc_id").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    return importance.top_k(sums, 10, "n", ["lang"], ["term"])


# ---- fitted machines and forests (no SQL) ------------------------------------------------


def _labelled(x: Inputs, targets: dict[str, str]) -> models.Labelled:
    docs = x.docs().select("doc_id", *targets)
    return models.labelled_rows(_features(x, _known(docs, targets)), docs, targets)


def _tuned(x: Inputs, target: str, kind: str):
    data = _labelled(x, {target: kind})
    return rounded(models.svm_metrics(data, models.svm_fit(data)), ["value"])


@query("k2_linear_svm")
def _(x):
    return _tuned(x, "toxic", models.BINARY)


@query("k3_ordinal_svm")
def _(x):
    return _tuned(x, "degree", models.ORDINAL)


@query("k4_scale_regression")
def _(x):
    return _tuned(x, "size_k", models.NUMERIC)


@query("k5_random_forest")
def _(x):
    data = _labelled(x, {"toxic": models.BINARY, "size_k": models.NUMERIC})
    return rounded(models.rf_metrics(data), ["value"])


@query("k7_experiment_grid")
def _(x):
    labelled = x.docs().where(F.col("toxic").isNotNull())
    sample = cut_lineage(sampling.stratified_sample(labelled, ["date"], 0.3, "doc_id"), "sample")
    kinds = {"toxic": models.BINARY, "degree": models.ORDINAL, "size_k": models.NUMERIC}
    grid = models.run_grid(tokens.feature_variants(sample), sample, kinds)
    return rounded(grid, ["value"])


@query("k11_svm_importance")
def _(x):
    """The ten terms that matter most to the fitted machine of each binary target."""
    targets = {"toxic": models.BINARY, "quality": models.BINARY}
    docs = x.docs().select("doc_id", *targets)
    feats = _features(x, _known(docs, targets))
    data = models.labelled_rows(feats, docs, targets)
    machines = [t.machine for t in models.svm_fit(data)]
    weights = cut_lineage(models.weight_table([m.weights[0, :-1] for m in machines], data.index), "weights")
    lost = importance.importance_of_targets(feats, data.rows, weights, list(targets), [m.weights[0, -1] for m in machines])
    return rounded(importance.top_k(lost, 10, "importance", ["target"], ["term"]), ["importance"])


@query("k8_fit_and_predict")
def _(x):
    out = models.fit_and_predict(_features(x), x.docs(), "toxic")
    return out.preds


@query("k10_predict_all")
def _(x):
    chosen = cut_lineage(_second_stage(x), "chosen")
    feats = cut_lineage(tokens.dfm_trim(tokens.dfm_docs(content(x), chosen), 2, 2), "features")
    docs = x.docs().join(chosen, "doc_id", "left_semi")
    kinds = {"toxic": models.BINARY, "quality": models.BINARY, "degree": models.ORDINAL, "size_k": models.NUMERIC}
    preds, _ = models.predict_all(feats, docs, kinds)
    return docs.select("doc_id").join(preds, "doc_id", "left")


def _bayes_sql(train: str, test: str, first: int) -> str:
    """Test predictions of naive Bayes with any number of classes, long form; ``first``: the class of a document without a known term."""
    return f"""WITH n AS (SELECT t.term, d.y, sum(t.n)::DOUBLE AS n FROM trimmed t JOIN {train} d USING (doc_id) GROUP BY t.term, d.y),
         c AS (SELECT y, sum(n) AS total FROM n GROUP BY y), v AS (SELECT DISTINCT term FROM n),
         w AS (SELECT v.term, c.y, ln((coalesce(n.n, 0) + 1) / (c.total + (SELECT count(*) FROM v))) AS w FROM v CROSS JOIN c LEFT JOIN n ON n.term = v.term AND n.y = c.y),
         s AS (SELECT t.doc_id, w.y, sum(t.n * w.w) AS s FROM trimmed t JOIN w USING (term) WHERE t.doc_id IN (SELECT doc_id FROM {test}) GROUP BY t.doc_id, w.y),
         b AS (SELECT doc_id, y AS yhat FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, y) = 1)
       SELECT d.doc_id, d.y, coalesce(b.yhat, {first}) AS yhat FROM {test} d LEFT JOIN b USING (doc_id)"""


register("test_docs_q", TRAIN_ONCE.replace("y FROM labelled", "quality AS y FROM labels").replace("<", ">="))
register("train_once_d", TRAIN_ONCE.replace("y FROM labelled", "degree AS y FROM docs") + " AND degree IS NOT NULL", "docs")
register("test_docs_d", TRAIN_ONCE.replace("y FROM labelled", "degree AS y FROM docs").replace("<", ">=") + " AND degree IS NOT NULL", "docs")
register("train_docs_d", _upsampled("train_once_d"), "train_once_d")
register("bayes_t", _bayes_sql("train_docs", "test_docs", 0), "trimmed", "train_docs", "test_docs")
register("bayes_q", _bayes_sql("train_docs_q", "test_docs_q", 0), "trimmed", "train_docs_q", "test_docs_q")
register("bayes_d", _bayes_sql("train_docs_d", "test_docs_d", 1), "trimmed", "train_docs_d", "test_docs_d")


@query(
    "x2_run_targets",
    "bayes_t bayes_q bayes_d",
    f"""SELECT target, metric, round(value, 6) + 0.0 AS value FROM (SELECT 'toxic' AS target, * FROM ({_binary_sql('bayes_t')}) a UNION ALL SELECT 'quality', * FROM ({_binary_sql('bayes_q')}) b UNION ALL
        SELECT 'degree', metric, value FROM (SELECT lang, 'Accuracy' AS metric, avg(CASE WHEN y = yhat THEN 1.0::DOUBLE ELSE 0.0 END) AS value FROM (SELECT 1 AS lang, * FROM bayes_d) p GROUP BY lang UNION ALL """
    + " UNION ALL ".join(_class_sql("(SELECT 1 AS lang, * FROM bayes_d)", c) for c in (1, 2, 3, 4, 5))
    + ") c) t",
)
def _(x):
    """One job per target from driver threads, each scoring a naive Bayes model of its label."""
    feats, docs = _features(x), x.docs()

    def one(target: tuple[str, str]):
        name, kind = target
        ready = models.prepare_target(feats, docs, name, kind)
        model = bayes.nb_fit(ready.counts, ready.train, (1, 2, 3, 4, 5) if kind == models.ORDINAL else (0, 1))
        preds = bayes.nb_predict(model, tokens.dfm_docs(ready.counts, ready.test), ready.test).join(ready.test, "doc_id")
        return cut_lineage(models.score(preds, kind, name), "scores")

    kinds = {"toxic": models.BINARY, "quality": models.BINARY, "degree": models.ORDINAL}
    first, *others = models.run_targets(list(kinds.items()), one)
    for part in others:
        first = first.unionByName(part)
    return rounded(first, ["value"])
