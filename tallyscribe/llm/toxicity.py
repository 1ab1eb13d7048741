"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Terms are words cut at white space and ASCII punctuation, and the first bytes of longer words. The vocabulary holds the
terms that set toxic examples apart. A text's neighbours are the ``NEIGHBOURS`` examples of largest cosine; each votes
with its label, weighted by the cosine and by how many labelled rows it stands for. A few votes for the overall rate
keep texts with few or no neighbours near it. The share of toxic votes becomes a probability by a monotone step function,
fitted on the shares that the examples get from all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscribe.llm.frames import pick, slices, utf8
from tallyscribe.llm.words import SLICE, Words, mix, powers
from tallyscribe.sources.storage import cut_lineage

#: The classifier is fitted on at most so many labelled rows of each label, those with the smallest hash of their id.
EXAMPLES = 6_000
TERMS = 2_048
#: A term counts for the vocabulary if it is in so many toxic examples and so many times as common there.
LEAST, LIFT = 3, 10.0
NEIGHBOURS = 25
PRIOR_VOTES = 0.25
THRESHOLD = 0.7
PREFIX = 5
BLOCK = 64

_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def terms(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all terms of a slice and the text each is in."""
    raw, starts = utf8(part)
    words = Words(_SPACED[raw], starts)
    long = np.flatnonzero(words.size > PREFIX)
    head = np.zeros(len(long), np.uint64)
    for k in range(PREFIX):
        letter = words.raw[words.start[long] + k].astype(np.uint64)
        head += (letter | np.uint64(0x20)) * powers(PREFIX + 1)[k + 1]
    code = np.concatenate([words.code, mix(head + np.uint64(PREFIX))])
    return code.view(np.int64), np.concatenate([words.doc, words.doc[long]])


def _per_text(part: pa.RecordBatch, vocabulary: np.ndarray | None = None):
    """Text, term and count of every distinct term of a text; terms as places in ``vocabulary`` if there is one."""
    code, doc = terms(part)
    if vocabulary is not None:
        if not len(vocabulary):
            return (np.zeros(0, np.int64),) * 3
        at = np.minimum(np.searchsorted(vocabulary, code), len(vocabulary) - 1)
        hit = vocabulary[at] == code
        code, doc = at[hit], doc[hit]
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    new = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(doc) != 0))) if len(code) else np.zeros(0, np.int64)
    return doc[new], code[new], np.diff(np.append(new, len(code)))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, size=SLICE):
        doc, code, _ = _per_text(part)
        toxic = part.column("toxic").to_numpy()[doc]
        code, back = np.unique(code, return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(code), *(pa.array(np.bincount(back[toxic == t], minlength=len(code)).astype(np.int64)) for t in (1, 0))], ["term", "toxic", "clean"]
        )


def _vectors(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, size=SLICE):
            doc, at, n = _per_text(part, vocabulary)
            bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
            lists = [[x[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)] for x in (at, n)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("toxic"), *(pa.array(x, pa.list_(pa.int64())) for x in lists)], ["doc_id", "toxic", "terms", "times"]
            )

    return run


@dataclass
class Index:
    """Postings of the examples by term, in blocks of ``BLOCK`` examples, with the largest weight per term and block."""

    vocabulary: np.ndarray
    idf: np.ndarray
    ids: np.ndarray  # of the examples, ascending
    label: np.ndarray
    votes: np.ndarray  # how many labelled rows an example stands for
    rate: float
    starts: np.ndarray  # of each term's postings
    example: np.ndarray
    weight: np.ndarray
    largest: np.ndarray  # terms x blocks
    shares: np.ndarray | None = None  # calibration: shares of toxic votes and the rates of toxic labels there
    rates: np.ndarray | None = None

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (1 + np.log(n)) * self.idf[at]
        return w / np.sqrt((w * w).sum()) if len(w) else w

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of largest cosine over 0, with all that equal the last of them, and the cosines.

        Blocks are taken by their upper bound, 16 at a time, until none can reach the k-th best so far.
        """
        bound = w @ self.largest[at]
        order = np.argsort(-bound, kind="stable")
        best, cosine = np.zeros(0, np.int64), np.zeros(0)
        for a in range(0, len(order), 16):
            blocks = order[a : a + 16]
            blocks = blocks[bound[blocks] > 0]
            if len(cosine) >= k:
                blocks = blocks[bound[blocks] >= cosine[k - 1] - 1e-11]
            if not len(blocks):
                break
            total = np.zeros((len(blocks), BLOCK))
            place = np.full(self.largest.shape[1], -1)
            place[blocks] = np.arange(len(blocks))
            for t, x in zip(at, w, strict=True):
                posted = slice(self.starts[t], self.starts[t + 1])
                who = self.example[posted]
                row = place[who // BLOCK]
                ok = row >= 0
                total[row[ok], who[ok] % BLOCK] += x * self.weight[posted][ok]
            row, col = np.nonzero(total)
            who = blocks[row] * BLOCK + col
            best, cosine = np.concatenate([best, who]), np.concatenate([cosine, np.round(total[row, col], 12)])
            ranked = np.lexsort((best, -cosine))
            best, cosine = best[ranked], cosine[ranked]
            if len(cosine) > k:
                ties = int(np.searchsorted(-cosine, -cosine[k - 1], side="right"))
                best, cosine = best[:ties], cosine[:ties]
        return best, cosine

    def share(self, at: np.ndarray, n: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[float, np.ndarray]:
        """Weighted share of toxic votes, and the neighbours; ``without``: an example that has no vote.

        All neighbours of the k-th largest cosine vote, so no id decides a score.
        """
        who, cosine = self.nearest(at, self.vector(at, n), k + (without >= 0)) if len(at) else (np.zeros(0, np.int64), np.zeros(0))
        if without >= 0:
            others = who != without
            who, cosine = who[others], cosine[others]
            if len(cosine) > k:
                ties = cosine >= cosine[k - 1]
                who, cosine = who[ties], cosine[ties]
        votes = cosine * self.votes[who]
        unit = PRIOR_VOTES * (self.votes.min() if len(self.votes) else 1.0)
        return float(((votes * self.label[who]).sum() + unit * self.rate) / (votes.sum() + unit)), who

    def calibrate(self, shares: np.ndarray) -> None:
        """Pool neighbouring shares until the rates of toxic labels rise with them."""
        order = np.argsort(shares, kind="stable")
        pools: list[list[float]] = []  # votes, toxic votes, largest share
        for share, label, votes in zip(shares[order], self.label[order], self.votes[order], strict=True):
            pools.append([votes, votes * label, share])
            while len(pools) > 1 and (pools[-2][2] == pools[-1][2] or pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]):
                votes_, toxic_, share_ = pools.pop()
                pools[-1] = [pools[-1][0] + votes_, pools[-1][1] + toxic_, share_]
        self.shares = np.array([p[2] for p in pools])
        self.rates = np.array([p[1] / p[0] for p in pools])

    def score(self, at: np.ndarray, n: np.ndarray, k: int = NEIGHBOURS) -> tuple[float, np.ndarray]:
        """Calibrated score and the ids of ``k`` neighbours, nearest first, of equal ones those of smaller id."""
        share, who = self.share(at, n, k)
        if self.shares is not None and len(self.shares):
            share = float(np.interp(share, self.shares, self.rates))
        return share, self.ids[who[:k]]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES, vocabulary: int = TERMS) -> Index:
    """An index of at most ``examples`` rows per label. ``labels (doc_id, toxic)`` are the rows to learn from.

    Null ids or labels teach nothing; a document that ``labels`` names twice is an example twice, and so are rows of
    ``docs`` that share an id; the bound holds for them too. An example that is scored finds itself among its neighbours.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    total = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for t in (0, 1):
        some = known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
        chosen = some if chosen is None else chosen.unionByName(some)
    # ``chosen`` has at most 2 * examples rows; ids that many rows share are cut to the bound after the join.
    named = cut_lineage(pick(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id"), "op10-examples")
    clean, toxic = (named.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(examples) for t in (0, 1))
    rows = clean.unionByName(toxic)
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = max(sizes.get(1, 0), 1), max(sizes.get(0, 0), 1)
    spread = rows.select("text", "toxic").mapInArrow(_spread, "term bigint, toxic bigint, clean bigint")
    found = spread.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= LEAST)
    one, zero = F.col("toxic") / n1, (F.col("clean") + 0.5) / n0
    gain = F.col("toxic") * F.log(one / zero)
    top = found.where(one > LIFT * zero).orderBy(gain.desc(), "term").limit(vocabulary).toArrow()
    code, df = top.column("term").to_numpy(), top.column("toxic").to_numpy() + top.column("clean").to_numpy()
    order = np.argsort(code)
    code, df = code[order], df[order]
    vectors = rows.mapInArrow(_vectors(code), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, toxic int, terms array<bigint>, times array<bigint>")
    held = sorted(vectors.toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["toxic"], r["terms"], r["times"]))
    label = np.array([r["toxic"] for r in held], np.int64)
    votes = np.where(label == 1, total.get(1, 0) / n1, total.get(0, 0) / n0)
    rate = total.get(1, 0) / max(sum(total.values()), 1)
    idf = np.log((1 + n0 + n1) / (1 + df)) + 1
    out = Index(code, idf, np.array([r["doc_id"] for r in held]), label, votes, rate, None, None, None, None)
    n = np.array([len(r["terms"]) for r in held], np.int64)
    example = np.repeat(np.arange(len(held)), n)
    at = np.array([t for r in held for t in r["terms"]], np.int64)
    weight = np.concatenate([np.zeros(0), *(out.vector(np.array(r["terms"], np.int64), np.array(r["times"], np.int64)) for r in held if r["terms"])])
    order = np.argsort(at, kind="stable")
    out.example, out.weight = example[order], weight[order]
    out.starts = np.searchsorted(at[order], np.arange(len(code) + 1))
    out.largest = np.zeros((len(code), -(-len(held) // BLOCK)))
    np.maximum.at(out.largest, (at, example // BLOCK), weight)
    own = [(np.array(r["terms"], np.int64), np.array(r["times"], np.int64)) for r in held]
    out.calibrate(np.array([out.share(*x, without=k)[0] for k, x in enumerate(own)]))
    return out


class _Scorer:
    """Scores of the texts of a slice; texts with the same terms are looked up once."""

    def __init__(self, index: Index, limit: int = 50_000):
        self.index, self.limit = index, limit
        self.known: dict[bytes, tuple[float, np.ndarray]] = {}

    def __call__(self, texts: pa.Array) -> list[tuple[float, np.ndarray]]:
        doc, at, n = _per_text(pa.RecordBatch.from_arrays([texts], ["text"]), self.index.vocabulary)
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            key = at[a:b].tobytes() + n[a:b].tobytes()
            if key not in self.known:
                if len(self.known) >= self.limit:
                    self.known.clear()
                self.known[key] = self.index.score(at[a:b], n[a:b])
            out.append(self.known[key])
        return out


def _apply(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(index)
        for part in slices(batches, size=SLICE):
            found = scorer(part.column("text"))
            near = pa.array([x[1] for x in found], pa.list_(part.schema.field("doc_id").type))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x[0] for x in found], pa.float64()), near], ["doc_id", "score", "evidence"])

    return run


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``doc_id, score, predicted, evidence`` (ids of the neighbours, nearest first).

    Null and empty text have no terms and get the score of a text without neighbours; with no labels at all every score
    is 0. Rows are scored one by one, null and repeated ids too; an empty table gives no rows.
    """
    rows = pick(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(_apply(index), f"doc_id {id_type}, score double, evidence array<{id_type}>")
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def clean(docs: DataFrame, index: Index, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is under ``threshold``, with all their columns. Nothing moves between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(index)
        for part in slices(batches, text_col, SLICE):
            yield part.filter(pa.array([x[0] < threshold for x in scorer(part.column(text_col))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
