"""Exact, near, line and substring duplicates against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscribe.llm import exact, frames, graph, lines, minhash, suffix, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def order(x):
    return tuple((v is not None, v) for v in x)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=order)


def low(i):
    return (i is not None, i if i is not None else 0)


@pytest.mark.parametrize("block", [4096, 7])
def test_exact_dedup(odd, block):
    docs = [(r.doc_id, r.text or "") for r in odd.collect()]
    groups = defaultdict(list)
    for i, t in docs:
        groups[t].append(i)
    want = []
    for i, t in docs:
        keep = max(groups[t], key=low)
        want.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert rows_of(exact.exact_dedup(odd, block_bytes=block)) == sorted(want, key=order)


def test_exact_names_do_not_depend_on_fingerprints(spark):
    """Rows of different keys get one name exactly if their texts are equal, whatever the number of blocks."""
    texts = ["", "ab", "abab", "ababab", "abababa", "ababab", "abab", "ba", "ab" * 40, "ab" * 40, "ab" * 40 + "x"]
    rows = spark.createDataFrame([(i, 0, 0, t) for i, t in enumerate(texts)], "doc_id bigint, n_bytes int, fp bigint, text string")
    names = exact.block_names(rows.select(F.struct("doc_id", "n_bytes", "fp").alias("key"), "text"), 2).collect()
    name = {r.key.doc_id: (r["round"], r.name) for r in names}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (name[i] == name[j]) == (a == b)


def test_exact_survivors_keep_all_columns(odd, empty):
    kept = exact.survivors(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect())[5] == 1
    assert exact.survivors(empty).count() == exact.exact_dedup(empty).count() == 0


def brute_lines(docs, min_chars=10, min_docs=2):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    held = defaultdict(set)
    for i, t in docs:
        for x in t.split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(i)
    out = []
    for i, t in docs:
        ls = t.split("\n")
        kept = [x for x in ls if len(held.get(key(x), ())) < min_docs or min(held[key(x)], key=low) == i]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=order)


@pytest.mark.parametrize("least", [2, 3])
def test_line_dedup(odd, empty, least):
    docs = [(r.doc_id, r.text or "") for r in odd.collect()]
    assert rows_of(lines.line_dedup(odd, min_docs=least)) == brute_lines(docs, min_docs=least)
    assert lines.line_dedup(empty, min_docs=least).count() == 0


def brute_near(docs, shingle=2, similarity=80):
    sets = []
    for _, t in docs:
        w = WORD.findall((t or "").translate(FOLD))
        sets.append({tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same_node = docs[i][0] == docs[j][0] and docs[i][1] == docs[j][1]
            if (a and b and 100 * len(a & b) >= similarity * len(a | b)) or (same_node and a):
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(docs)):
        members[find(i)].append(docs[i][0])
    return sorted(((d[0], len(s), c := min(members[find(i)], key=low) if s else d[0], d[0] == c) for i, (d, s) in enumerate(zip(docs, sets, strict=True))), key=order)


def test_near_dedup(odd, empty):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows_of(minhash.near_dedup(odd, shingle=2)) == brute_near(docs)
    assert minhash.near_dedup(empty, shingle=2).count() == 0
    assert minhash.survivors(odd).columns == odd.columns


def test_near_dedup_chains_and_thresholds(spark):
    """A chain of neighbours is one component; pairs just under the threshold stay apart."""
    words = [f"w{k}" for k in range(120)]
    docs = [(k, " ".join(words[k * 4 : k * 4 + 60])) for k in range(12)]  # neighbours share 55 of 63 shingles
    docs += [(100, " ".join(f"v{k}" for k in range(30))), (101, " ".join(f"v{k}" for k in range(24))), (102, " ".join(f"v{k}" for k in range(23)))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert rows_of(minhash.near_dedup(df, shingle=2)) == brute_near(docs)


def test_signature_finds_pairs_at_the_threshold():
    """Of 300 pairs with a similarity of exactly 0.8, each shares a band."""
    rng, signer = np.random.default_rng(1), minhash.Signer()
    for size in (10, 100, 1000):
        for _ in range(100):
            x = np.unique(rng.integers(0, 1 << 63, size * 10 // 9, dtype=np.uint64))[:size]
            n = size // 9
            a, b = np.sort(x[n:]), np.sort(x[: size - n])
            assert len(np.intersect1d(a, b)) * 100 >= 75 * len(x)
            assert (signer.keys(a) == signer.keys(b)).any()


def test_densified_bins_are_those_of_the_fullest(spark):
    signer = minhash.Signer()
    one = signer.keys(np.array([1 << 60], np.uint64))
    assert len(np.unique(one)) == signer.bands  # every bin takes the one value; bands keep their own salt


def test_components_of_long_paths(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(5, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(1, 301)}, **{k: 1000 for k in range(1001, 1400)}}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_repeats(texts, length):
    seen, raw = Counter(), [(t or "").encode() for t in texts]
    for b in raw:
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("length", "group"), [(200, 4096), (200, 1), (60, 3)])
def test_remove_repeats(spark, small, length, group):
    texts = [r.text for r in small.orderBy("doc_id").limit(60).collect()]
    texts += ["a" * 1000, "ab" * 300, texts[3][50:400] + "x" + texts[5][:300], texts[3][100:420], None, "", "é" * 250, "é" * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(suffix.remove_repeats(df, length=length, group=group).collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == brute_repeats(texts, length)


def test_remove_repeats_odd_rows(odd, empty):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", F.expr("left(text, 3000)").alias("text")).collect()]
    want = sorted(((i, *x[:3]) for (i, _), x in zip(docs, brute_repeats([t for _, t in docs], 60), strict=True)), key=order)
    short = odd.withColumn("text", F.expr("left(text, 3000)"))
    assert rows_of(suffix.remove_repeats(short, length=60).select("doc_id", "n_bytes", "n_removed", "n_spans")) == want
    assert suffix.without_repeats(short, length=60).columns == odd.columns
    assert suffix.remove_repeats(empty).count() == 0


def test_strings_that_meet_modulo_powers_of_two(spark, mirrors):
    """Words and texts whose polynomials modulo 2^64 are equal for every odd base are told apart."""
    x, y = mirrors
    raw = np.frombuffer(f"{x} {y} {x}".encode(), np.uint8)
    code = words.Words(raw, np.array([0, len(raw)])).code
    assert code[0] == code[2] != code[1]
    docs = [(0, x), (1, y), (2, "pre " + x[:1500])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted(suffix.remove_repeats(df, length=1024).collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == brute_repeats([t for _, t in docs], 1024)
    assert rows_of(minhash.near_dedup(df, shingle=2)) == brute_near(docs)


def test_words_longer_than_one_sum(monkeypatch):
    raw = np.frombuffer(b"Abcab" * 500 + b" " + b"abcab" * 500 + b" " + b"abcab" * 499 + b"abcac", np.uint8)
    whole = words.Words(raw, np.array([0, len(raw)])).code
    monkeypatch.setattr(words, "ADDENDS", 64)
    parts = words.Words(raw, np.array([0, len(raw)])).code
    assert np.array_equal(whole, parts) and whole[0] == whole[1] != whole[2]


def test_long_texts_are_ranked_in_blocks_alike(monkeypatch):
    """Cutting a text into blocks may split runs, never lose a window."""
    raw = np.frombuffer(np.random.default_rng(3).integers(97, 101, 5000, dtype=np.uint8).tobytes(), np.uint8)
    monkeypatch.setattr(suffix, "BLOCK", 700)
    first, last, _, _ = suffix.runs(raw, 200)
    assert np.array_equal(np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)]), np.arange(len(raw) - 199))


def test_near_dedup_turns_find_links_between_almost_similar_texts(spark):
    """Many variants of one text, most of them not similar enough: further turns find links that one star leaves."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(200)]
    docs = []
    for i in range(240):
        words = list(base)
        for k in rng.choice(200, 15, replace=False):
            words[k] = f"v{i}x{k}"
        docs.append((2 * i, " ".join(words)))
        if i % 3 == 0:  # a true partner
            words[rng.integers(200)] = "partner"
            docs.append((2 * i + 1, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = brute_near(docs)
    assert rows_of(minhash.near_dedup(df, shingle=2)) == want


def test_near_dedup_loses_no_link_in_a_group_of_almost_similar_texts(spark, monkeypatch):
    """Pairs at the threshold inside a large group whose other pairs are just under it; the blocks of hot shingles are small."""
    monkeypatch.setattr(minhash, "FAN", 64)
    rng = np.random.default_rng(11)
    docs = []
    for i in range(300):
        words = [f"w{k}" for k in range(400)]
        places = rng.permutation(133) * 3
        for k in places[:15]:
            words[k] = f"v{i}x{k}"
        docs.append((2 * i, " ".join(words)))
        if i % 3 == 0:  # a partner just similar enough
            for k in places[15:37]:
                words[k] = f"u{i}x{k}"
            docs.append((2 * i + 1, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = brute_near(docs)
    assert 100 <= sum(not r[3] for r in want) < 200
    assert rows_of(minhash.near_dedup(df, shingle=2)) == want


def test_near_dedup_sends_only_tables_known_to_be_small(spark, monkeypatch):
    """Stored tables look small by their files; none may be sent to every task through the driver for that."""
    monkeypatch.setattr(frames, "SENT_ROWS", -1, raising=False)
    plans, kept = [], minhash.cut_lineage

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, name)

    monkeypatch.setattr(minhash, "cut_lineage", noted)
    monkeypatch.setattr(graph, "cut_lineage", noted)
    docs = [(i, " ".join(f"w{k}" for k in range(i // 4, i // 4 + 60)) + f" end{i}") for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    out = minhash.survivors(df, shingle=2)
    plans.append(("out", out._jdf.queryExecution().executedPlan().toString()))
    assert len(plans) > 8
    assert [name for name, plan in plans if "Broadcast" in plan] == []
    assert sorted(r.doc_id for r in out.collect()) == [r[0] for r in brute_near(docs) if r[3]]


def test_line_keys_of_bytes_equal_those_of_characters():
    def plain(line, least):
        line = line.strip(" \t\n\x0b\x0c\r")
        return hashlib.blake2b(line.translate(FOLD).encode(), digest_size=16).digest() if len(line) >= least else None

    text = "\n".join(["", " \t ", "ABC def ghi", "\x0bÄÖÜ ß 12345\r", "日本語" * 3, "日本語" * 4, "\xa0 nbsp stays \xa0", "123456789", "1234567890", "😀" * 9 + " ", "😀" * 10, "É" * 9 + "Z", "x" * 100])
    for least in (1, 9, 10, 11):
        assert lines.line_keys(text.encode(), least) == [plain(x, least) for x in text.split("\n")]
