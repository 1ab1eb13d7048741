"""Linear machines and forests against plain numpy and exhaustive search."""

import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscribe.operators import forest, linear, models
from tallyscribe.operators.linear import Head, Problem
from tallyscribe.operators.sampling import upsample


def words_of(i, y):
    return Counter({f"w{(i * 7 + k) % 23}": 1 + (i + k) % 3 for k in range(6)}) + Counter({f"c{y}": 2 if i % 5 else 0, "the": 3})


@pytest.fixture(scope="module")
def five(spark):
    """Sixty documents of five classes, uneven, with text ids."""
    rows, labels = [], []
    for i in range(60):
        y = 1 + (0 if i < 24 else 1 + i % 4)
        labels.append((f"id-{i}", y, int(y > 2), i / 10.0 + y))
        rows += [(f"id-{i}", t, n) for t, n in words_of(i, y).items()]
    labels += [(f"new-{i}", None, None, None) for i in range(10)]
    rows += [(f"new-{i}", t, n) for i in range(10) for t, n in words_of(i, 1 + i % 5).items()]
    counts = spark.createDataFrame(rows, "doc_id string, term string, n long").cache()
    return counts, spark.createDataFrame(labels, "doc_id string, five int, two int, size double").cache()


TARGETS = {"five": models.ORDINAL, "two": models.BINARY, "size": models.NUMERIC}


@pytest.fixture(scope="module")
def data(five):
    return models.labelled_rows(*five, TARGETS)


def matrix(data):
    rows = data.rows.orderBy("doc_id").collect()
    x = np.zeros((len(rows), data.size + 1))
    x[:, -1] = 1
    for k, r in enumerate(rows):
        x[k, r.idx] = r.val
    return rows, x


def goal_and_bound(rows, p):
    """Side or value and bound of the dual of each row, spelt out."""
    goal, most = np.zeros(len(rows)), np.zeros(len(rows))
    for k, r in enumerate(rows):
        t = r[f"t{p.target}"]
        if t is None or not (t.train or p.final):
            continue
        if p.head.positive is not None and t.y != p.head.positive and p.head.negative is not None and t.y != p.head.negative:
            continue
        copies = sum(c for f, c in enumerate(t.copies) if f != p.leave_out)
        goal[k] = t.y if p.head.positive is None else (1 if t.y == p.head.positive else -1)
        most[k] = p.cost * copies
    return goal, most


def loss_of(w, x, goal, most, numeric):
    margin = x @ w
    miss = np.abs(margin - goal) - linear.EPSILON if numeric else 1 - goal * margin
    return w @ w / 2 + (most * np.maximum(miss, 0)).sum()


def plain_fit(x, goal, most, numeric, turns=1500):
    """Coordinate ascent over one model, one row at a time, without any of the tricks."""
    dual, w, rng = np.zeros(len(x)), np.zeros(x.shape[1]), np.random.default_rng(0)
    for _ in range(turns):
        for i in rng.permutation(np.flatnonzero(most)):
            q, g, old = x[i] @ x[i], x[i] @ w, dual[i]
            if numeric:  # a parabola with a kink at 0: the lowest point of either side, if it lies there
                up, down = old - (g - goal[i] + linear.EPSILON) / q, old - (g - goal[i] - linear.EPSILON) / q
                dual[i] = np.clip(up if up > 0 else down if down < 0 else 0.0, -most[i], most[i])
                w += (dual[i] - old) * x[i]
            else:
                dual[i] = np.clip(old + (1 - goal[i] * g) / q, 0, most[i])
                w += (dual[i] - old) * goal[i] * x[i]
    return w


PROBLEMS = [
    Problem(0, Head(1.0, 3.0), 1.0, 2), Problem(0, Head(2.0), 0.1), Problem(1, Head(1.0, 0.0), 0.1, 0), Problem(1, Head(1.0, 0.0), 10.0, None, True), Problem(2, Head(), 0.1, 4), Problem(2, Head(), 1.0),
]


def test_machines_reach_the_plain_minimum(data):
    """All models together come as close to the minimum as the gap promises."""
    found = linear.fit(data.rows, data.size, PROBLEMS, data.folds)
    rows, x = matrix(data)
    for w, p in zip(found, PROBLEMS, strict=True):
        goal, most = goal_and_bound(rows, p)
        numeric = p.head.positive is None
        best = loss_of(plain_fit(x, goal, most, numeric), x, goal, most, numeric)
        assert best * 0.99 <= loss_of(w, x, goal, most, numeric) <= best * (1 + 2 * linear.TOLERANCE), p


def test_several_slices_come_to_the_same_machines(data, monkeypatch):
    some = [PROBLEMS[k] for k in (1, 4)]
    want = linear.fit(data.rows, data.size, some, data.folds)
    monkeypatch.setattr(linear, "SLICE", 20)
    found = linear.fit(data.rows, data.size, some, data.folds, 40)
    assert [np.linalg.norm(a - b) / np.linalg.norm(b) for a, b in zip(found, want, strict=True)] == pytest.approx([0, 0], abs=0.15)


def test_groups_of_models_are_bounded_and_the_same(data, monkeypatch):
    """The driver holds few models at a time, whatever the number of machines that are tuned, and chooses the same costs."""
    costs = (0.01, 1.0)
    want = models._costs(data, costs, 2, linear.ONE_VS_ONE)
    seen, fit_group, judge = [], linear._fit_group, linear.fold_errors

    def group(rows, size, problems, *more):
        seen.append(len(problems))
        return fit_group(rows, size, problems, *more)

    def errors(rows, machines, folds):
        assert sum(len(m.weights) for _, _, m in machines) <= 40
        return judge(rows, machines, folds)

    monkeypatch.setattr(linear, "STATE_BYTES", (data.size + 1) * 8 * 40)
    monkeypatch.setattr(linear, "_fit_group", group)
    monkeypatch.setattr(linear, "fold_errors", errors)
    assert models._costs(data, costs, 2, linear.ONE_VS_ONE) == want
    assert max(seen) <= 40 and sum(seen) == 2 * 10 * 12
    monkeypatch.undo()
    assert (data.size + 1) * 8 * linear.room(data.size) <= 64 << 20 and linear.room(10**9) == 1


def test_rounds_store_nothing_and_slices_are_packed_once(five, monkeypatch):
    """Inner products are made and stored once for all costs, folds and machines of a table; a round is a job that writes no table."""
    data = models.labelled_rows(*five, {"two": models.BINARY})
    made, stored = [], []
    products, save = linear.cut_lineage, linear.new_path
    monkeypatch.setattr(linear, "cut_lineage", lambda df, name: made.append(name) or products(df, name))
    monkeypatch.setattr(linear, "new_path", lambda spark, name: stored.append(name) or save(spark, name))
    models.svm_fit(data, (0.1, 1.0), 4)
    assert len(made) == 1 and len(stored) <= 2


def test_climb_row_by_row(data):
    """Blocks of rows make the steps that one row after the other makes."""
    table = data.rows.orderBy("doc_id").toArrow().combine_chunks()
    part = linear.Slice(table.to_batches()[0], PROBLEMS, data.folds)
    _, x = matrix(data)
    for slices in (1, 3):
        dual = np.zeros(part.goal.shape)
        part.climb(np.zeros(dual.shape), x @ x.T, dual, slices, 5)
        rows = np.flatnonzero(part.most.any(axis=1))
        want, margin, rng = np.zeros(dual.shape), np.zeros(dual.shape), np.random.default_rng(5)
        for _ in range(max(3, min(linear.EPOCHS, linear.STEPS // len(rows)))):
            for i in rng.permutation(rows):
                bend = slices * (x[i] @ x[i])
                for k in range(len(PROBLEMS)):
                    most, goal, old, at = part.most[i, k], part.goal[i, k], want[i, k], margin[i, k]
                    if part.numeric[k]:
                        up, down = old - (at - goal + linear.EPSILON) / bend, old - (at - goal - linear.EPSILON) / bend
                        new, side = np.clip(up if up > 0 else down if down < 0 else 0.0, -most, most), 1.0
                    else:
                        new, side = np.clip(old + (1 - goal * at) / bend, 0, most), goal
                    want[i, k] = new
                    margin[:, k] += slices * (x @ x[i]) * (new - old) * side
        assert np.allclose(dual, want, atol=1e-6)


def test_inner_products(data):
    import pyarrow as pa

    table = data.rows.orderBy("doc_id").toArrow().combine_chunks()
    _, x = matrix(data)
    assert np.allclose(linear._products(table.to_batches()[0]), x @ x.T)
    assert isinstance(table, pa.Table)


def test_copies_and_folds(spark, five):
    _, labels = five
    for leak_safe in (False, True):
        marks = models.mark_targets(labels, TARGETS, 10, leak_safe=leak_safe).collect()
        for at, name in enumerate(TARGETS):
            for train in (True, False):
                part = {r.doc_id: (r.y, r.copies) for r in marks if r.target == at and r.train == train}
                if name == "size":
                    assert all(sum(c) == 1 for _, c in part.values())
                else:
                    known = spark.createDataFrame([(d, y) for d, (y, _) in part.items()], "doc_id string, y double")
                    want = Counter(r.doc_id for r in upsample(known, "y", "doc_id").collect())
                    assert {d: sum(c) for d, (_, c) in part.items()} == want
                if leak_safe:
                    assert all(sum(x > 0 for x in c) == 1 for _, c in part.values())
                else:
                    sizes = np.sum([c for _, c in part.values()], axis=0)
                    assert sizes.max() - sizes.min() <= 1


def test_folds_of_twelve_rows_are_not_empty(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 3 + 1) for i in range(15)], "doc_id long, a int, b int")
    marks = models.mark_targets(labels, {"a": models.BINARY, "b": models.ORDINAL}).where("train").collect()
    for at in (0, 1):
        sizes = np.sum([r.copies for r in marks if r.target == at], axis=0)
        assert (sizes > 0).all()
    counts = spark.createDataFrame([(i, f"t{i % 5}", 1) for i in range(15)], "doc_id long, term string, n long")
    rows = models.fit_targets(counts, labels, {"a": models.BINARY, "b": models.ORDINAL}, costs=(0.1, 1.0), max_iter=5).metrics.collect()
    assert {r.target for r in rows} == {"a", "b"}


def test_left_out_errors(data):
    machine = linear.Machine(0, tuple(linear.heads_of(models.ORDINAL, data.classes[0])), data.classes[0], np.random.default_rng(1).normal(size=(10, data.size + 1)))
    got = linear.left_out(data.rows, [(0, f, machine) for f in range(10)], 10)
    rows, x = matrix(data)
    yhat = linear.decide(x @ machine.weights.T, machine.heads, machine.classes)
    errors = []
    for f in range(10):
        copies = np.array([r.t0.copies[f] if r.t0.train else 0 for r in rows])
        errors.append((copies * (yhat != np.array([r.t0.y for r in rows]))).sum() / copies.sum())
    assert got == {(0, 0): pytest.approx(np.mean(errors))}


def test_pairs_vote_and_the_rest_loses():
    classes = (1.0, 2.0, 3.0, 4.0, 5.0)
    rng = np.random.default_rng(4)
    pairs, rest = linear.heads_of(models.ORDINAL, classes), linear.heads_of(models.ORDINAL, classes, linear.ONE_VS_REST)
    assert [(h.positive, h.negative) for h in pairs] == list(itertools.combinations(classes, 2)) and len(rest) == 5
    margins = rng.normal(size=(200, 10))
    want = []
    for row in margins:
        votes = Counter()
        for m, (a, b) in zip(row, itertools.combinations(classes, 2), strict=True):
            votes[a if m > 0 else b] += 1
        want.append(min(classes, key=lambda c: (-votes[c], c)))
    assert linear.decide(margins, pairs, classes).tolist() == want
    one = margins[:, :5]
    assert linear.decide(one, rest, classes).tolist() == [classes[int(np.argmax(r))] for r in one]


def test_pairs_and_rest_differ_on_a_middle_class(spark):
    """On a line the class in the middle has no side of its own: pairs find it, one against the rest does not."""
    place = {1: 0, 2: 3, 3: 6, 4: 9, 5: 12}
    docs = [(i, 1 + i % 5) for i in range(100)]
    counts = spark.createDataFrame([(i, "x", place[y] + 1) for i, y in docs], "doc_id long, term string, n long")
    labels = spark.createDataFrame(docs, "doc_id long, z int")
    right = {}
    for how in (linear.ONE_VS_ONE, linear.ONE_VS_REST):
        data = models.labelled_rows(counts, labels, {"z": models.ORDINAL})
        (tuned,) = models.svm_fit(data, (10.0,), how=how)
        rows = linear.tested(data.rows, tuned.machine, data.folds).collect()
        right[how] = sum(r.y == r.yhat for r in rows) / len(rows)
    assert right[linear.ONE_VS_ONE] == 1.0 > right[linear.ONE_VS_REST]


def test_text_ids_from_features_to_predictions(five):
    counts, labels = five
    preds, metrics = models.predict_all(counts, labels, TARGETS, costs=(0.1, 1.0), folds=3, max_iter=10)
    got = {r.doc_id: r for r in preds.collect()}
    assert set(got) == {f"new-{i}" for i in range(10)}
    assert all(r.five in (1, 2, 3, 4, 5) and r.two in (0, 1) and r.size is not None for r in got.values())
    assert {r.target for r in metrics.collect()} == set(TARGETS)
    ready = models.prepare_target(counts, labels, "two")
    assert ready.train.count() and ready.test.count() and ready.unlabelled.count() == 10


def test_importance_of_targets_brute_force_with_text_ids(spark, five):
    from tallyscribe.functions import hashing
    from tallyscribe.operators import importance

    counts, labels = five
    both = labels.withColumn("late", (F.col("five") > 3).cast("int"))
    data = models.labelled_rows(counts, both, {"two": models.BINARY, "late": models.BINARY})
    rng = np.random.default_rng(3)
    weights = {r.term: (r.df, rng.normal(size=2).round(3).tolist()) for r in data.index.orderBy("term").collect()}
    table = spark.createDataFrame([(t, d, w) for t, (d, w) in weights.items()], "term string, df long, w array<double>")
    got = {(r.target, r.term): r.importance for r in importance.importance_of_targets(counts, data.rows, table, ["two", "late"], [0.2, -0.1]).collect()}
    rows = data.rows.where("t0.train OR t1.train")
    order = rows.withColumn("h", hashing.row_hash(rows, ["doc_id"], hashing.PERMUTE)).orderBy("h", "doc_id").collect()
    by_doc = defaultdict(Counter)
    for r in counts.collect():
        by_doc[r.doc_id][r.term] += r.n
    shift = {r.term: 1 + r.k % (len(order) - 1) for r in table.select("term", hashing.text_key(F.col("term")).alias("k")).collect()}

    def hits(at, moved=None):
        right = 0
        for place, r in enumerate(order):
            values = dict(by_doc[r.doc_id])
            if moved is not None:
                values[moved] = by_doc[order[(place + shift[moved]) % len(order)].doc_id][moved]
            margin = sum(weights[t][1][at] * n for t, n in values.items() if t in weights) + (0.2, -0.1)[at]
            mark = r[f"t{at}"]
            right += sum(mark.copies) * ((margin > 0) == (mark.y == 1)) if mark.train else 0
        return right

    for at, target in enumerate(["two", "late"]):
        size = sum(sum(r[f"t{at}"].copies) for r in order if r[f"t{at}"].train)
        for term in weights:
            assert got[target, term] == pytest.approx((hits(at) - hits(at, term)) / size, abs=1e-12)


def test_best_splits_by_exhaustive_search(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 4, (30, 6))
    classes, w = rng.integers(0, 3, 30), rng.integers(1, 4, 30)
    node = [("f", int(k % 2), 1) for k in range(30)]
    rows = [(*node[k], int(w[k]), *[float(w[k] * (classes[k] == c)) for c in range(3)], [(j, int(x[k, j])) for j in range(6) if x[k, j]]) for k in range(30)]
    here = spark.createDataFrame(rows, "target string, tree int, node int, w int, v0 double, v1 double, v2 double, cells array<struct<idx:int,bin:int>>")
    keys = ["target", "tree", "node"]
    total = here.groupBy(*keys).agg(F.sum("w").alias("n"), *[F.sum(f"v{i}").alias(f"s{i}") for i in range(3)])
    got = {r.tree: (r.idx, r["at"]) for r in forest._splits(here, total, keys, 3, 4, 2.0).collect()}

    def gini(mask):
        n = w[mask].sum()
        return n - sum(w[mask & (classes == c)].sum() ** 2 for c in range(3)) / n if n else 0.0

    for tree in (0, 1):
        mine = np.arange(30) % 2 == tree
        left = {(j, b): gini(mine & (x[:, j] >= b)) + gini(mine & (x[:, j] < b)) for j in range(6) for b in range(1, 4) if 0 < (mine & (x[:, j] >= b)).sum() < mine.sum()}
        assert left[got[tree]] == pytest.approx(min(left.values()))


def test_forest_learns_and_predicts_test_rows_only(data):
    targets = [(0, models.ORDINAL, data.classes[0]), (1, models.BINARY, data.classes[1]), (2, models.NUMERIC, ())]
    got = forest.forest_predictions(data.rows, targets, data.size, 25, 6).collect()
    rows = data.rows.collect()
    by = defaultdict(dict)
    for r in got:
        by[r.target][r.doc_id] = (r.y, r.yhat)
    for t in range(3):
        assert by[t].keys() == {r.doc_id for r in rows if not r[f"t{t}"].train}
    assert sum(a == b for a, b in by[0].values()) >= 0.6 * len(by[0])
    values = [r.t2.y for r in rows]
    assert all(min(values) <= b <= max(values) for _, b in by[2].values())


def test_poisson_draws(spark):
    out = spark.range(20_000).select(*[forest._poisson(F.lit(float(m)), forest._uniform(F.col("id"), F.lit(m))).alias(f"m{m}") for m in (0, 1, 7, 400)])
    for m in (0, 1, 7, 400):
        mean, var = out.agg(F.avg(f"m{m}"), F.var_pop(f"m{m}")).first()
        assert mean == pytest.approx(m, rel=0.05) and var == pytest.approx(m, rel=0.15)


def test_forest_blocks_draw_as_spark_does(spark):
    """Cells are drawn in blocks, by Spark's own hash, and weights are Spark's Poisson draws; the rows of all cells and trees are never made."""
    nodes = [(t, k, n) for t in (0, 3) for k in (0, 7, 499) for n in (1, 2, 77, 2**31 - 1, 2**33)]
    table = spark.createDataFrame(nodes, "target int, tree int, node bigint")
    terms = np.array([0, 1, 2, 5, 40, 999, 2**31 - 1], np.int32)
    cells = table.withColumn("idx", F.explode(F.array(*[F.lit(int(t)) for t in terms])))
    keys = ["target", "tree", "node", "idx"]
    at = np.array(nodes)
    seeds = forest.hash_long(at[:, 2], forest.hash_int(at[:, 1], forest.hash_int(at[:, 0], np.full(len(at), 42, np.uint64))))
    for share in (0.0, 0.002, 0.3, 1.0):
        want = {tuple(r) for r in cells.where(forest._uniform(*[F.col(k) for k in keys]) < share).collect()}
        i, j = forest._draws(seeds, terms, forest._below(share))
        assert {(*nodes[a], int(terms[b])) for a, b in zip(i, j, strict=True)} == want
    hashes = {r.id: r.h for r in spark.createDataFrame([("a",), ("",), (None,)], "id string").select("id", F.xxhash64("id").alias("h")).collect()}
    for mean in (0.0, 1.0, 3.0, 99.0, 250.0):
        draw = forest._poisson(F.lit(mean), forest._uniform(F.col("id"), F.col("tree"), F.lit(4)))
        trees = spark.range(50).select(F.col("id").cast("int").alias("tree"))
        for doc, h in hashes.items():
            want = trees.withColumn("id", F.lit(doc).cast("string")).select("tree", draw.alias("w")).orderBy("tree").collect()
            assert forest.draw_weights(mean, h, 50, 4).tolist() == [r.w for r in want]


def test_forest_rows_of_a_level_are_nodes_and_drawn_cells(spark, data, monkeypatch):
    """No level stores a row per document and tree: one per block, one per node of a block, one per drawn cell."""
    monkeypatch.setattr(forest, "drop_stage", lambda *_: None)
    seen = []
    path = forest.new_path
    monkeypatch.setattr(forest, "new_path", lambda s, n: seen.append(path(s, n)) or seen[-1])
    forest.forest_predictions(data.rows, [(0, models.ORDINAL, data.classes[0])], data.size, 40, 3).count()
    first = {r.kind: r.n for r in spark.read.parquet(seen[0]).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert first[0] <= 2 and first[1] == 40 * first[0] < data.rows.count() * 40 / 4


def test_importance_moves_cells_once(spark, five):
    """Cells go to the places they leave and come to in one shuffle, not by term and place first and by place again."""
    from tallyscribe.operators import importance

    counts, labels = five
    data = models.labelled_rows(counts, labels, {"two": models.BINARY})
    weights = data.index.select("term", "df", F.lit(0.5).alias("w"))
    rows = spark.createDataFrame([(f"id-{i}", 0, i % 2) for i in range(60)], "doc_id string, copy_no int, y int").withColumn("doc_id", F.substring("doc_id", 4, 9).cast("long"))
    plain = counts.where("doc_id LIKE 'id-%'").withColumn("doc_id", F.substring("doc_id", 4, 9).cast("long"))
    one = importance.permutation_importance(plain, rows, weights)
    many = importance.importance_of_targets(counts, data.rows, weights.withColumn("w", F.array("w")), ["two"])
    for out in (one, many):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(place#" in plan and "hashpartitioning(term#" in plan
        assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(term#" in x and "place#" in x.split("]")[0].split("ENSURE")[0]]


def test_importance_trims_by_all_documents_and_joins_labelled_ones(spark, monkeypatch):
    """Only rows of labelled documents go through the joins of ``k11``; whether a term is kept is decided by all documents."""
    import __spark_entry__
    from tallyscribe.plans import q_models

    labels = [(i, i % 2, i % 3 % 2) for i in range(12)]
    docs = [(i, f"word{i % 4} common shared{i}", "en", "web", 20) for i in range(24)] + [(30, "shared3 shared4 shared5", "en", "web", 20)]
    tables = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    }
    monkeypatch.setattr(q_models.Inputs, "table", lambda self, name: tables[name])
    seen = []
    trimmed = q_models.trimmed
    monkeypatch.setattr(q_models, "trimmed", lambda x, ids=None: seen.append(trimmed(x, ids)) or seen[-1])
    terms = {r.term for r in __spark_entry__.queries()["k11_permutation_importance"](spark, "").collect()}
    assert {r.doc_id for r in seen[0].collect()} <= set(range(12))
    assert terms and terms <= {"common", "shared3", "shared4", "shared5", *[f"word{k}" for k in range(4)]} and terms & {"shared3", "shared4", "shared5"}
