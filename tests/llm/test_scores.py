"""Quality rules, language-model scores, toxicity and the pipeline against plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from tallyscribe.llm import lm, quality, toxicity
from test_duplicates import brute_near, brute_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def brute_quality(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + o for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for o in range(5)}
    ls = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, len(ls) - len(set(ls)), len(covered), failed


def test_quality_rules(odd, empty, small):
    for df in (odd, small.select("doc_id", "text")):
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
        got = sorted(map(tuple, quality.apply_rules(df).withColumn("h", F.coalesce("doc_id", F.lit(-1))).select("h", *names).collect()))
        assert got == sorted((-1 if r.doc_id is None else r.doc_id, *brute_quality(r.text)) for r in df.collect())
    out = {r.doc_id: r for r in quality.apply_rules(odd).collect()}
    assert not out[14].kept and "symbols" in out[14].failed and out[5].kept
    assert quality.apply_rules(empty).count() == 0


def test_quality_needs_no_python(small):
    plan = quality.apply_rules(small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_lm_scores(small):
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    model, counts = lm.fit(small.where(fold != 2))
    got = {r.doc_id: r for r in lm.score(small, model, counts).collect()}
    tokens = {r.doc_id: [*WORD.findall((r.text or "").translate(FOLD)), "</end>"] for r in small.collect()}
    c = Counter(w for i, x in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in x)
    n, v = sum(c.values()), len(c)
    for i, x in tokens.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(x), sum(c[w] > 0 for w in x), n)
        assert got[i].base_score == pytest.approx(base, rel=1e-9)
    held = [r for i, r in got.items() if zlib.crc32(str(i).encode()) % 7 == 2]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    # After any two classes, all words of all classes and the unseen word of each group sum to 1.
    table = 10.0 ** lm.log_table(model.params).astype(float)
    assert np.allclose(table.sum(2), 1)
    per_class = np.zeros(lm.CLASSES)
    for r in counts.collect():
        k = 0 if r.code == lm.END else int(model.classes(np.array([r.code]), np.array([r.group]))[0])
        per_class[k] += r.c + 1
    per_class[1 + lm.SINGLES :] += 1
    used = per_class > 0
    assert np.allclose(np.log10(per_class[used]), model.share[used])


def test_lm_odd_rows(odd, empty):
    model, counts = lm.fit(odd)
    rows = lm.score(odd, model, counts).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    half, counts_of_half = lm.fit(odd.where("doc_id <> 16"))
    mirror = [r for r in lm.score(odd.where("doc_id = 16"), half, counts_of_half).collect()]
    assert [(r.n_tokens, r.n_known) for r in mirror] == [(2, 1)]  # the end alone
    ones = [r for r in rows if r.doc_id == 1 and r.n_tokens > 10]
    assert len(ones) == 2 and ones[0].base_score == pytest.approx(ones[1].base_score) and ones[0].n_known == ones[0].n_tokens
    nothing, none = lm.fit(empty)
    rows = lm.score(odd, nothing, none).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in rows)
    assert lm.score(empty, model, counts).count() == 0


def test_noise_contrastive_training_learns_the_rates():
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.ones(6), (6, 6))
    fitted = 10.0 ** lm.log_table(lm.train(np.round(p * 10_000).astype(np.int64), dim=16, steps=600)).astype(float)
    mean = np.broadcast_to(p.mean((0, 1)), p.shape)
    loss = lambda q: -(p * np.log(q)).sum(2).mean()
    assert np.allclose(fitted.sum(2), 1) and loss(fitted) < 0.9 * loss(mean) + 0.1 * loss(p)


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return toxicity.fit(docs, labels)


def test_nearest_is_exact(index):
    """The bounds skip no example: neighbours and cosines equal those of the full product."""
    rng = np.random.default_rng(6)
    full = np.zeros((len(index.ids), len(index.vocabulary)))
    for t in range(len(index.vocabulary)):
        posted = slice(index.starts[t], index.starts[t + 1])
        full[index.example[posted], t] = index.weight[posted]
    for _ in range(100):
        at = np.sort(rng.choice(len(index.vocabulary), min(len(index.vocabulary), rng.integers(1, 12)), replace=False))
        w = index.vector(at, rng.integers(1, 5, len(at)))
        cosine = np.round(full[:, at] @ w, 12)
        order = np.lexsort((np.arange(len(cosine)), -cosine))
        order = order[cosine[order] > 0]
        order = order[cosine[order] >= cosine[order[:10][-1]]] if len(order) else order  # with all ties at the end
        who, near = index.nearest(at, w, 10)
        assert sorted(who.tolist()) == sorted(order.tolist()) and np.allclose(near, cosine[order])


def test_toxicity_does_not_depend_on_ids(spark, index):
    """The same texts and labels under ids in the opposite order get the same scores."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = toxicity.fit(docs.withColumn("doc_id", -F.col("doc_id")), labels.withColumn("doc_id", -F.col("doc_id")))
    one = {r.doc_id: r.score for r in toxicity.score(docs, index).collect()}
    other = {r.doc_id: r.score for r in toxicity.score(docs, turned).collect()}
    assert one == pytest.approx(other, abs=1e-9) and len(set(one.values())) > 3


def test_examples_are_bounded_under_repeated_ids(spark):
    rows = [(i % 3, f"you pathetic idiot number {i}") for i in range(60)] + [(9, f"a calm walk {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (9, 0)], "doc_id bigint, toxic int")
    small = toxicity.fit(docs, labels, examples=5)
    assert sorted(small.label) == [0] * 5 + [1] * 5
    assert toxicity.score(docs, small).count() == 100


def test_toxicity_rows(odd, empty, index, spark):
    rows = toxicity.score(odd, index).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert toxicity.clean(odd, index).columns == odd.columns and toxicity.score(empty, index).count() == 0
    bad = spark.createDataFrame([(1, "you are an idiot and a pathetic stupid loser, worthless scum")], "doc_id bigint, text string")
    assert toxicity.score(bad, index).first().predicted == 1 and toxicity.clean(bad, index).count() == 0
    nothing = toxicity.fit(odd, spark.createDataFrame([(1, None), (None, 1), (99, 1)], "doc_id bigint, toxic int"))
    assert {r.predicted for r in toxicity.score(odd, nothing).collect()} <= {0, 1}
    none = toxicity.fit(empty, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}


def test_toxicity_on_rows_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = contract.queries()["op10_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    caught = [r for r in got if r.predicted]
    assert sum(r.toxic for r in caught) >= 0.98 * len(caught) and sum(r.toxic for r in caught) >= 0.5 * sum(r.toxic for r in got)


def test_pipeline_stages(spark):
    """Each stage against brute force over what the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "exact dedup", "near dedup", "suffix dedup", "packing"]
    clean = steps["toxicity"](spark, docs, SF).cache()
    assert clean.columns == columns and clean.exceptAll(docs).isEmpty()
    toxic = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1")
    assert docs.join(clean, "doc_id", "left_anti").join(toxic, "doc_id").count() >= 0.5 * (docs.count() - clean.count())
    once = steps["exact dedup"](spark, clean, SF).cache()
    last = {}
    for r in clean.collect():
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert once.columns == columns and sorted(r.doc_id for r in once.collect()) == sorted(last.values())
    near = steps["near dedup"](spark, once, SF).cache()
    want = [r[0] for r in brute_near([(r.doc_id, r.text) for r in once.collect()], shingle=5) if r[3]]
    assert near.columns == columns and sorted(r.doc_id for r in near.collect()) == want
    rest = steps["suffix dedup"](spark, near, SF).cache()
    rows = near.orderBy("doc_id").collect()
    brute = brute_repeats([r.text for r in rows], 200)
    got = rest.orderBy("doc_id").collect()
    assert rest.columns == columns
    assert [(r.doc_id, r.text, r.n_chars, r.lang) for r in got] == [(r.doc_id, t := b[3].decode("utf-8", "ignore"), len(t), r.lang) for r, b in zip(rows, brute, strict=True)]
    pieces = steps["packing"](spark, rest, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in got}


def test_contract():
    names = list(contract.queries())
    assert all(sum(x.startswith(f"op{n}_") for x in names) == 1 for n in range(1, 11)) and "pipeline" in names


def test_pipeline_near_copies_in_a_group_of_similar_texts(spark):
    """Five words, pairs at the threshold inside a large group just under it: one of each pair goes."""
    rng = np.random.default_rng(12)
    docs = []
    for i in range(300):
        words = [f"w{k}" for k in range(400)]
        places = rng.permutation(66) * 6
        for k in places[:6]:
            words[k] = f"v{i}x{k}"
        docs.append((2 * i, " ".join(words)))
        if i % 3 == 0:
            for k in places[6:14]:
                words[k] = f"u{i}x{k}"
            docs.append((2 * i + 1, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = [r[0] for r in brute_near(docs, shingle=5) if r[3]]
    assert 200 < len(want) < 300
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, df, SF).collect()) == want
