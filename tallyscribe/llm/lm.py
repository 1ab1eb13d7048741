"""Language-model scores: a log-bilinear model over word classes, and the base of word counts.

A word's probability is that of its class after the two words before, times its share of the class. Frequent words are
classes of their own; the others fall into classes by their last letters. All counts come from all training documents.
The log-bilinear model scores a class by the dot product of its vector with the context's, which is the sum of the
context words' vectors, each weighted by place. It is trained in numpy by noise-contrastive estimation on the counts of
class triples, whose number is bounded by the number of classes, not by the corpus. The expectation over noise is taken
over all classes instead of drawn. Normalised log-probabilities of all contexts are a few matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscribe.llm.frames import pick, slices, utf8
from tallyscribe.llm.words import SLICE, Words, mix
from tallyscribe.sources.storage import cut_lineage

#: Classes: the end, single words, and groups by last letters. Their product of three bounds what training gathers.
SINGLES, GROUPS = 91, 36
CLASSES = 1 + SINGLES + GROUPS
#: Most frequent words whose counts every task holds (16 bytes each); counts of all other words are joined.
FREQUENT = 131_072
DIM, STEPS, NOISE = 32, 200, 10

END = int(mix(np.array([0xE0D], np.uint64)).view(np.int64)[0])


def _tokens(part: pa.RecordBatch):
    """Per text its word codes and groups, as arrays over the whole slice with the bounds of each text."""
    words = Words(*utf8(part))
    return words.code.view(np.int64), (mix(words.tail(2)) % np.uint64(GROUPS)).astype(np.int64), words.bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        code, group, n = (np.concatenate(x) for x in zip(*held, strict=True))
        code, at, back = np.unique(code, return_index=True, return_inverse=True)
        total = np.bincount(back, n, len(code)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(group[at]), pa.array(total)], ["code", "group", "n"])

    for part in slices(batches, size=SLICE):
        code, group, _ = _tokens(part)
        code, at, n = np.unique(np.append(code, END), return_index=True, return_counts=True)
        n[code == END] += part.num_rows - 1  # one end per text
        held.append((code, np.append(group, -1)[at], n))
        size += len(code)
        if size > 2_000_000:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


@dataclass
class Classes:
    """Which class a word has: its own if it is one of ``singles``, else that of its group."""

    singles: np.ndarray  # sorted codes
    class_of: np.ndarray  # their classes

    def __call__(self, code: np.ndarray, group: np.ndarray) -> np.ndarray:
        out = 1 + SINGLES + group
        if len(self.singles):
            at = np.minimum(np.searchsorted(self.singles, code), len(self.singles) - 1)
            out = np.where(self.singles[at] == code, self.class_of[at], out)
        return out


def _line(classes: Classes, part: pa.RecordBatch):
    """Classes of all tokens of the slice, ends included, those of the two tokens before each, and the text of each."""
    code, group, bounds = _tokens(part)
    n = np.diff(bounds) + 1
    text = np.repeat(np.arange(part.num_rows), n)
    first = np.cumsum(n) - n
    place = np.arange(len(text)) - first[text]
    is_end = place == n[text] - 1
    kind = np.zeros(len(text), np.int64)
    kind[~is_end] = classes(code, group)
    before = np.where(place >= 1, np.append(0, kind[:-1]), 0)
    before2 = np.where(place >= 2, np.append([0, 0], kind[:-2]), 0)[: len(kind)]
    return kind, before, before2, text, (code, bounds, n)


def _triples(classes: Classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for part in slices(batches, size=SLICE):
            kind, one, two, _, _ = _line(classes, part)
            total += np.bincount((two * CLASSES + one) * CLASSES + kind, minlength=CLASSES**3)
        cell = np.flatnonzero(total)
        for a in range(0, len(cell), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(cell[a : a + 100_000]), pa.array(total[cell[a : a + 100_000]])], ["cell", "n"])

    return run


def train(counts: np.ndarray, dim: int = DIM, steps: int = STEPS, noise: int = NOISE) -> dict[str, np.ndarray]:
    """Noise-contrastive estimation on ``counts[two before, one before, word]`` with Adam, the same on every run."""
    size = counts.shape[0]
    seen = counts.reshape(size * size, size).astype(np.float32)
    weight = seen.sum(1)
    used = np.flatnonzero(weight)
    total = max(float(weight.sum()), 1.0)
    base = (counts.sum((0, 1)) + 1.0) / (counts.sum() + size)
    rng = np.random.default_rng(7)
    p = {"context": rng.normal(0, 0.1, (size, dim)), "target": rng.normal(0, 0.1, (size, dim)), "place": np.full((2, dim), 0.5), "bias": np.log(base)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    mean, var = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    two, one = used // size, used % size
    data, drawn = seen[used] / total, (weight[used, None] / total * noise * base[None, :]).astype(np.float32)
    shift = np.log(noise * base).astype(np.float32)
    for step in range(1, steps + 1 if len(used) else 1):
        query = p["context"][two] * p["place"][0] + p["context"][one] * p["place"][1]
        score = query @ p["target"].T + p["bias"] - shift
        real = 1 / (1 + np.exp(-np.clip(score, -30, 30)))  # chance that the word is data and not noise
        slope = data * (1 - real) - drawn * real
        back = slope @ p["target"]
        grad = {"target": slope.T @ query, "bias": slope.sum(0), "place": np.stack([(back * p["context"][w]).sum(0) for w in (two, one)])}
        context = np.zeros_like(p["context"])
        for k, w in ((0, two), (1, one)):
            order = np.argsort(w, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(w[order]) != 0))
            context[w[order][starts]] += np.add.reduceat((back * p["place"][k])[order], starts, axis=0)
        grad["context"] = context
        for k, g in grad.items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            var[k] = 0.99 * var[k] + 0.01 * g * g
            p[k] = p[k] + 0.05 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-8)
    return p


def log_table(p: dict[str, np.ndarray]) -> np.ndarray:
    """log10 probability of every class after every pair of classes, from batched matrix products."""
    size = len(p["bias"])
    out = np.empty((size, size, size), np.float32)
    for two in range(size):
        query = p["context"][two] * p["place"][0] + p["context"] * p["place"][1]
        score = (query @ p["target"].T + p["bias"]).astype(np.float64)
        top = score.max(1, keepdims=True)
        out[two] = (score - top - np.log(np.exp(score - top).sum(1, keepdims=True))) / np.log(10)
    return out


@dataclass
class Model:
    """What scoring needs in every task; its size does not depend on the corpus."""

    classes: Classes
    params: dict[str, np.ndarray]
    share: np.ndarray  # log10 of each class's total of (count + 1), its unseen word included
    frequent: np.ndarray  # sorted codes
    frequent_n: np.ndarray
    tokens: int
    types: int


def fit(training: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the stored counts ``(code, c, group)`` of all words of all training rows."""
    rows = training.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    listed = rows.mapInArrow(_count, "code bigint, group bigint, n bigint")
    counts = cut_lineage(listed.groupBy("code").agg(F.sum("n").alias("c"), F.max("group").alias("group")), "op8-counts")
    tokens, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # A fixed number of the most frequent words.
    top = counts.where(F.col("code") != END).orderBy(F.desc("c"), "code").limit(FREQUENT).select("code", "c", "group").toArrow()
    code, n = top.column("code").to_numpy(), top.column("c").to_numpy()
    order = np.argsort(-n, kind="stable")[:SINGLES]
    order = order[np.argsort(code[order])]
    classes = Classes(code[order], 1 + np.argsort(np.argsort(-n[order], kind="stable")))
    by_group = counts.where(F.col("code") != END).groupBy("group").agg(F.sum(F.col("c") + 1).alias("s")).collect()  # GROUPS rows
    share = np.ones(CLASSES)
    share[0] = 1 + max(counts.where(F.col("code") == END).agg(F.max("c")).first()[0] or 0, 0)
    share[classes.class_of] = n[order] + 1
    for group, s in by_group:
        share[1 + SINGLES + group] = 1 + s
    group = top.column("group").to_numpy()
    np.subtract.at(share, 1 + SINGLES + group[order], n[order] + 1)
    cells = rows.mapInArrow(_triples(classes), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    triples = np.zeros(CLASSES**3, np.int64)
    triples[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    params = train(triples.reshape(CLASSES, CLASSES, CLASSES))
    by_code = np.argsort(code)
    return Model(classes, params, np.log10(share), code[by_code], n[by_code], int(tokens), int(types)), counts


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = log_table(model.params)
        in_class = np.log10(model.frequent_n + 1.0)
        end_share = model.share[0]  # the end is a class of its own, of weight count + 1
        for part in slices(batches, size=SLICE):
            kind, one, two, text, (code, bounds, n) = _line(model.classes, part)
            per_class = np.bincount(text, table[two, one, kind].astype(np.float64) - model.share[kind], part.num_rows)
            known = np.full(part.num_rows, int(model.tokens > 0), np.int64)  # the end
            log_counts = np.full(part.num_rows, end_share)
            rest_code, rest_n = [], []
            if len(model.frequent):
                at = np.minimum(np.searchsorted(model.frequent, code), len(model.frequent) - 1)
                found = model.frequent[at] == code
            else:
                at, found = np.zeros(len(code), np.int64), np.zeros(len(code), bool)
            owner = text[_word_places(n)]
            log_counts += np.bincount(owner[found], in_class[at[found]] if len(in_class) else None, part.num_rows)
            known += np.bincount(owner[found], minlength=part.num_rows)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                rare, many = np.unique(code[a:b][~found[a:b]], return_counts=True)
                rest_code.append(rare)
                rest_n.append(many)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("key"), pa.array(n), pa.array(known), pa.array(log_counts), pa.array(per_class), pa.array(rest_code, pa.list_(pa.int64())), pa.array(rest_n, pa.list_(pa.int64()))],
                ["doc_id", "key", "n_tokens", "known", "log_counts", "in_context", "codes", "times"],
            )

    return run


def _word_places(n: np.ndarray) -> np.ndarray:
    """Places of the words among all tokens: every token but the last of each text."""
    keep = np.ones(int(n.sum()), bool)
    keep[np.cumsum(n) - 1] = False
    return np.flatnonzero(keep)


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, n_known, train_tokens, base_score, score`` (log10 of probabilities).

    ``base_score`` is the add-one unigram; ``score`` the log-bilinear model's. Null and empty text are the end alone.
    Repeated rows and null ids are scored like any other; an empty table gives no rows. With nothing to learn from, all
    counts are 0 and classes equally likely.
    """
    rows = pick(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    keyed = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    local = cut_lineage(
        keyed.mapInArrow(
            _score(model),
            f"doc_id {id_type}, key bigint, n_tokens bigint, known bigint, log_counts double, in_context double, codes array<bigint>, times array<bigint>",
        ),
        "op8-local",
    )
    rare = local.where(F.size("codes") > 0).select("key", F.posexplode(F.arrays_zip("codes", "times")).alias("i", "w"))
    rare = rare.select("key", (F.col("i") == 0).cast("int").alias("rows"), F.col("w.codes").alias("code"), F.col("w.times").alias("n"))
    joined = rare.join(counts.select("code", "c"), "code", "left")
    # Rows that are equal share a key: each sum is divided by how many there are.
    rest = joined.groupBy("key").agg(
        (F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)) / F.sum("rows")).alias("rest"),
        (F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)) / F.sum("rows")).cast("bigint").alias("rest_known"),
    )
    log_counts = F.col("log_counts") + F.coalesce("rest", F.lit(0.0))
    return local.drop("codes", "times").join(rest, "key", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (log_counts - F.col("n_tokens") * float(np.log10(model.tokens + model.types + 1))).alias("base_score"),
        (log_counts + F.col("in_context")).alias("score"),
    )
