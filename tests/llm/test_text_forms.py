"""Fill-in-middle, spelling variants and language identification against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tallyscribe.llm import fim, langid, queries, spelling

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# ---- fill-in-middle ----------------------------------------------------------------------


def brute_fim(text, doc_id):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, odd, empty, small):
    marks = spark.createDataFrame([(i, f"a {x} b <{x[1]} c< P>") for i in range(20) for x in ("<P>", "<S>", "<M>", "<Q>")], "doc_id long, text string")
    for df in (odd, small, marks):
        # A short mean makes many chunks, so that cuts fall on and between their ends.
        for mean in (fim.MEAN, 16):
            got = fim.fill_in_middle(df, mean=mean).withColumn("back", fim.restored()).collect()
            want = df.collect()
            rows = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got]
            assert sorted(map(str, rows)) == sorted(str((r.doc_id, *brute_fim(r.text, r.doc_id))) for r in want)
            assert sorted(map(str, ((r.doc_id, r.back) for r in got))) == sorted(str((r.doc_id, r.text or "")) for r in want)
    assert {r.form for r in fim.fill_in_middle(small).collect()} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(empty).count() == 0


def test_chunk_summaries_combine_at_any_boundary():
    rng = random.Random(3)
    known = fim.Known(4000)  # so small that it forgets
    for turn in range(3000):
        text = "".join(rng.choice("ab é\n\t😀<PSM>  ") for _ in range(rng.randrange(1, 50)))
        raw = text.encode()
        ends = sorted({*rng.sample(range(1, len(raw) + 1), rng.randrange(min(len(raw), 8))), len(raw)})
        got = fim._rearranged(raw, ends, turn, known, 42, 50, 80)
        assert (*got[:4], got[4].decode()) == brute_fim(text, turn)


def test_chunks_follow_content():
    rng = np.random.default_rng(5)
    shared = rng.integers(97, 123, 20_000).astype(np.uint8)
    a, b = (np.concatenate([rng.integers(97, 123, n).astype(np.uint8), shared]) for n in (1000, 3333))
    cuts = [set((len(x) - fim.chunk_ends(x)).tolist()) for x in (a, b)]
    inside = {c for c in cuts[0] if c < 20_000 - 16}
    assert len(inside) > 10 and inside == {c for c in cuts[1] if c < 20_000 - 16}


# ---- spelling ----------------------------------------------------------------------------


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def brute_words(rows, drop_every=199, min_chars=6, min_count=5):
    found = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % drop_every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= min_chars and n >= min_count}


def brute_variants(words, ratio=5):
    out, form = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = [form[w], None, n, len(others), words[best] if form[w] else None]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


def variants_of(df, **how):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, **how).collect()}


def test_variants_of_the_smallest_table(spark):
    got = contract.queries()["op12_spelling_variants"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = brute_variants(brute_words([(r.doc_id, r.text) for r in docs]))
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)


def test_variants_chains_ties_and_odd_rows(spark, odd, empty):
    counts = {
        "straße": 700, "strasse": 100, "strase": 20, "strae": 9, "colour": 500, "color": 400, "colours": 99, "coulour": 100, "aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125,
        "abcdef": 6, "bbcdef": 30, "abcdeg": 30, "übcdef": 30, "xyzxyz": 5, "abdcef": 300,
    }
    counts["Ünique".translate(FOLD)] = 8  # no letter but A-Z is lower-cased
    texts = [(i, " ".join([w.upper() if w.isascii() and k % 2 else w for k in range(n)])) for i, (w, n) in enumerate(counts.items())]
    df = spark.createDataFrame([*texts, (None, None), (3, ""), (3, "xyzxyz-xyzxyz1xyzxyz"), (4, "z" * 3000 + " ")] + [(5, "z" * 2999)] * 5 + [(6, "z" * 3000)] * 30, "doc_id long, text string")
    want = brute_variants(brute_words([(r.doc_id, r.text) for r in df.collect()], 1 << 40))
    assert variants_of(df) == want
    assert want["aaaaaa"][:2] == ("aaaaaaa", "aaaaaaaa") and want["abcdef"][0] == "abcdeg" and want["z" * 2999][0] == "z" * 3000
    low = brute_words([(r.doc_id, r.text) for r in odd.collect()], 1 << 40, min_chars=3, min_count=1)
    assert variants_of(odd, min_chars=3, min_count=1) == brute_variants(low)
    assert spelling.variants(empty).count() == 0


def test_large_blocks_and_tables_lose_nothing(spark, monkeypatch):
    """One block with most words, dealt over tasks, and tables cut inside blocks."""
    rng = random.Random(8)
    words = {"comput" + "".join(rng.choice("abcd") for _ in range(rng.randrange(2, 6))) for _ in range(400)}
    words |= {"".join(rng.choice("ab") for _ in range(rng.randrange(6, 9))) for _ in range(200)}
    rows = {w: rng.randrange(5, 4000) for w in words}
    df = spark.createDataFrame(list(rows.items()), "word string, n long").repartition(3)
    want = {w: (x[3], min((o for o in rows if near(w, o)), key=lambda o: (-rows[o], o))) for w, x in brute_variants(rows).items() if x[3]}
    for share in (7, 100_000):
        got = spelling.near_words(df, 6, share).collect()
        assert {r.word: (r.n_near, r.near) for r in got} == want and len(got) == len(want)
    monkeypatch.setattr(spelling, "TABLE", 13)
    rows_in = df.mapInArrow(spelling._blocks(6), "shorter int, kind int, key string, word string, n bigint").selectExpr("*", "0 AS share", "true AS asks")
    batches = [b for b in rows_in.orderBy("shorter", "kind", "key").toArrow().to_batches(max_chunksize=50)]
    total = Counter()
    for out in spelling._near(iter(batches)):
        for w, n in zip(out.column("word").to_pylist(), out.column("n_near").to_pylist(), strict=True):
            total[w] += n
    assert dict(total) == {w: n for w, (n, _) in want.items()}


# ---- languages ---------------------------------------------------------------------------


def all_segmentations(word, p):
    """Sum over all cuts of the bytes of a word into pieces."""
    raw = ("▁" + word).encode().decode("latin-1")
    ways = [1.0] + [0.0] * len(raw)
    for j in range(1, len(raw) + 1):
        ways[j] = sum(ways[i] * p.get(raw[i:j], 0.0) for i in range(j))
    return ways[-1]


def test_scores_sum_over_segmentations():
    pieces = langid.pieces_of(PIECES)
    rng = np.random.default_rng(1)
    table = np.log(rng.dirichlet(np.ones(len(pieces)), 3).T + 1e-9)
    words = ["the", "straße", "a", "日本語", "naïve", "zzzzzzzz", "ab" * 60]
    got = langid.word_logs(words, pieces, table)
    for k in range(3):
        p = dict(zip(pieces.pieces, np.exp(table[:, k]), strict=True))
        assert [math.log(all_segmentations(w, p)) for w in words] == pytest.approx(got[:, k])
    long = langid.word_logs(["ab" * 5000], pieces, table)  # no number runs out of range
    assert np.isfinite(long).all() and (long < -1000).all()


def test_expected_counts_are_shares_of_segmentations():
    """Forward and backward sums against a list of all segmentations."""
    import pyarrow as pa

    pieces = langid.pieces_of(PIECES)
    rng = np.random.default_rng(2)
    table = np.log(rng.dirichlet(np.ones(len(pieces)), 2).T)
    words = [("the", "a", 3), ("that", "b", 2), ("è", "b", 1)]

    def cuts(s):
        return [[]] if not s else [[s[:k], *rest] for k in range(1, len(s) + 1) if s[:k] in place for rest in cuts(s[k:])]

    place = {p: i for i, p in enumerate(pieces.pieces)}
    want = Counter()
    for w, lang, n in words:
        k = "ab".index(lang)
        found = [(c, math.exp(sum(table[place[x], k] for x in c))) for c in cuts(("▁" + w).encode().decode("latin-1"))]
        whole = sum(x for _, x in found)
        for c, x in found:
            for piece in c:
                want[place[piece], k] += n * x / whole
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*[(w, g, n) for w, g, n in words], strict=True)], ["word", "lang", "n"])
    (out,) = langid._expected(PIECES, ["a", "b"], table)(iter([batch]))
    got = dict(zip(zip(out.column("piece").to_pylist(), out.column("lang").to_pylist(), strict=True), out.column("n").to_pylist(), strict=True))
    assert set(got) == set(want)
    assert [got[k] for k in want] == pytest.approx(list(want.values()))


def test_languages_of_rows_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.col("lang").alias("truth"))
    rows = contract.queries()["op13_language_id"](spark, SF).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.truth for r in held) >= 0.97 * len(held)


def test_predictions_by_plain_python(spark, small):
    model = langid.fit(small.where("doc_id % 5 <> 0"), PIECES, turns=1)
    got = {r.doc_id: r for r in langid.identify(small, model).collect()}
    pieces = langid.pieces_of(PIECES).pieces
    tables = [dict(zip(pieces, np.exp(model.table[:, k]), strict=True)) for k in range(len(model.languages))]
    known = [r.lang for r in small.where("doc_id % 5 <> 0").collect()]
    for r in small.where("length(text) < 600").collect():
        words = [w for w in re.findall(r"[^\W\d_]+", r.text.lower())]
        logs = [math.log(known.count(g) / len(known)) + sum(math.log(all_segmentations(w, p)) for w in words) for g, p in zip(model.languages, tables, strict=True)]
        best = max(range(len(logs)), key=logs.__getitem__)
        assert got[r.doc_id].lang_pred == model.languages[best]
        assert got[r.doc_id].score == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs), rel=1e-6)


def test_language_odd_rows(spark, odd, empty):
    known = odd.withColumn("lang", F.when(F.col("doc_id") < 9, "aa").when(F.col("doc_id") < 13, "bb"))
    model = langid.fit(known, PIECES)
    assert model.languages == ["aa", "bb"]
    rows = langid.identify(odd, model).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id not in (None, 1)}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (2, 3, 4, 14))
    assert all(r.lang_pred in ("aa", "bb") and 0 < r.score <= 1 for i, r in by_id.items() if i not in (2, 3, 4, 14))
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "½ ² 12 _ Ⅷ"), (2, "x"), (3, "語")], "doc_id long, text string"), model).collect()} <= {"und", "aa", "bb"}
    none = langid.fit(empty.withColumn("lang", F.lit("aa")), PIECES)
    assert {(r.lang_pred, r.score) for r in langid.identify(odd, none).collect()} == {("und", 0.0)}
    assert langid.identify(empty, model).count() == 0


def test_registered_over_whole_tables(spark):
    docs = queries.documents(spark, SF)
    for name in ("op11_fill_in_middle", "op13_language_id"):
        assert contract.queries()[name](spark, SF).count() == docs.count()
