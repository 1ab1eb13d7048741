"""Language identification by unigrams of pieces, summed over all segmentations.

The pieces are the fixed vocabulary of a public model file, with every single byte, so any text can be cut. A language gives
each piece a probability; a word (a run of letters, lower-cased, after a mark for its beginning) has the probability of all its
segmentations together, which the forward algorithm sums up over the bytes of the word. A text has the product over its words.
The language with the largest product, weighted by its share of the documents learnt from, is the prediction, and the
share of that product in the sum over all languages is the score.

Piece probabilities are learnt by expectation maximisation: forward and backward sums give how often each piece is expected
in the words of a language. Words are counted by Spark first, so every distinct word of a language is summed once a turn.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from tallyscribe.llm.frames import pick, slices
from tallyscribe.sources.storage import cut_lineage

UNKNOWN = "und"
TURNS = 3
#: Pieces that each language borrows from all languages together, and those that these borrow from the even distribution.
BORROWED, EVEN = 200.0, 1000.0

#: Words that a task counts before it hands them on, and code points of their texts; words that a worker remembers the scores of.
HELD, HELD_CHARS = 200_000, 32_000_000
KNOWN_WORDS, KNOWN_CHARS = 400_000, 10_000_000
#: Bytes of words that are summed at a time (a longer word comes alone), code points from which a text is not listed at once.
BATCH_BYTES, LONG = 1 << 18, 1 << 20

_RUN = re.compile(r"[^\W\d_]+")
_BEGIN = "▁"  # fixed value: the mark of the model file for the beginning of a word


class Pieces:
    """The pieces of a model file that can stand in words, as byte strings, and a trie of the longer ones.

    A node of the trie is a row of ``step``; a byte leads to another row by its class, and 0 is the end. ``piece`` is the piece that
    ends at a node, or -1. Pieces of one byte stand aside in ``single``: there are all 256 of them.
    """

    def __init__(self, path: str):
        model = SentencePieceProcessor(model_file=path)
        found = {bytes([b]).decode("latin-1") for b in range(256)}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                piece = model.id_to_piece(i)
                rest = piece.removeprefix(_BEGIN)
                if not rest or rest == rest.lower() and _RUN.fullmatch(rest):
                    found.add(piece.encode().decode("latin-1"))
        self.pieces = sorted(found)
        self.size = np.array([len(p) for p in self.pieces])
        place = {p: k for k, p in enumerate(self.pieces)}
        self.single = np.array([place[chr(b)] for b in range(256)])
        longer = [p.encode("latin-1") for p in self.pieces if len(p) > 1]
        used = sorted({b for p in longer for b in p})
        self.kind = np.zeros(256, np.int64)
        self.kind[used] = np.arange(1, len(used) + 1)
        nodes: dict[bytes, int] = {b"": 1}  # by what leads there
        for p in longer:
            for n in range(1, len(p) + 1):
                nodes.setdefault(p[:n], len(nodes) + 1)
        self.step = np.zeros((len(nodes) + 1, len(used) + 1), np.int32)
        self.piece = np.full(len(nodes) + 1, -1)
        for way, node in nodes.items():
            if way:
                self.step[nodes[way[:-1]], self.kind[way[-1]]] = node
                if len(way) > 1:
                    self.piece[node] = place.get(way.decode("latin-1"), -1)

    def __len__(self) -> int:
        return len(self.pieces)

    def inside(self, raw: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where it begins, piece) of all pieces in some bytes; a piece that begins at ``i`` ends at ``last[i]`` at most."""
        at = np.arange(len(raw))
        kind, node = self.kind[raw], np.ones(len(raw), np.int32)
        begins, pieces, n = [at], [self.single[raw]], 0
        while len(at):
            node = self.step[node, kind[at + n]]
            n += 1
            whole = self.piece[node]
            hit = whole >= 0
            begins.append(at[hit])
            pieces.append(whole[hit])
            go = (node > 0) & (at + n < last[at])
            at, node = at[go], node[go]
        return np.concatenate(begins), np.concatenate(pieces)


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """One vocabulary per file and worker process."""
    return Pieces(path)


def _log_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Logarithms of the sums of exponentials of runs of rows."""
    most = np.maximum.reduceat(values, starts)
    runs = np.diff(np.append(starts, len(values)))
    return most + np.log(np.add.reduceat(np.exp(values - np.repeat(most, runs, axis=0)), starts))


class Lattice:
    """All pieces inside some words; nodes are the places between bytes, edges the pieces."""

    def __init__(self, words: list[str], pieces: Pieces):
        coded = [(_BEGIN + w).encode() for w in words]
        sizes = np.array([len(c) for c in coded])
        begins = np.append(0, np.cumsum(sizes)[:-1])
        raw = np.frombuffer(b"".join(coded), np.uint8)
        word = np.repeat(np.arange(len(words)), sizes)
        at, self.piece = pieces.inside(raw, (begins + sizes)[word])
        self.word = word[at]
        # One node more than bytes in each word.
        self.first, self.at = begins + np.arange(len(words)), at + self.word
        self.last = self.first + sizes
        self.to = self.at + pieces.size[self.piece]
        self.nodes = int(self.last[-1]) + 1

    def _turns(self, place: np.ndarray):
        """Groups of edges by the distance of ``place`` from the beginning of the word, and the runs of equal ``place`` in each."""
        far = place - self.first[self.word]
        order = np.argsort(far * np.int64(self.nodes) + place, kind="stable")
        cuts = np.flatnonzero(np.diff(far[order])) + 1
        for edges in np.split(order, cuts):
            spot = place[edges]
            starts = np.append(0, np.flatnonzero(np.diff(spot)) + 1)
            yield edges, starts, spot[starts]

    def forward(self, weights: np.ndarray) -> np.ndarray:
        """Per node the log of the sum over all ways to it; ``weights``: edges x columns, logs of probabilities."""
        out = np.zeros((self.nodes, weights.shape[1]))
        for edges, starts, spots in self._turns(self.to):
            out[spots] = _log_sums(out[self.at[edges]] + weights[edges], starts)
        return out

    def plain_forward(self, weights: np.ndarray) -> np.ndarray:
        """The same with numbers instead of logs; it can run out of their range."""
        out = np.ones((self.nodes, weights.shape[1]))
        for edges, starts, spots in self._turns(self.to):
            out[spots] = np.add.reduceat(out[self.at[edges]] * weights[edges], starts)
        return out

    def backward(self, weights: np.ndarray) -> np.ndarray:
        """Per node the log of the sum over all ways from it to the end of its word."""
        out = np.zeros((self.nodes, weights.shape[1]))
        for edges, starts, spots in reversed(list(self._turns(self.at))):
            out[spots] = _log_sums(out[self.to[edges]] + weights[edges], starts)
        return out


#: Each byte counts so many times while numbers are summed as they are, which keeps them in range; smaller sums are repeated as logs.
LIFT, SMALLEST = 16.0, 1e-200


def lifted(table: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Probabilities of a table of logs, lifted by the bytes of the pieces."""
    return np.exp(table + pieces.size[:, None] * np.log(LIFT))


def word_logs(words: list[str], pieces: Pieces, table: np.ndarray, plain: np.ndarray | None = None) -> np.ndarray:
    """Words x languages: the log of the probability of each word, all its segmentations together. ``plain``: the lifted table."""
    if not words:
        return np.zeros((0, table.shape[1]))
    lattice = Lattice(words, pieces)
    plain = lifted(table, pieces) if plain is None else plain
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        sums = lattice.plain_forward(plain[lattice.piece])[lattice.last]
        out = np.log(sums) - ((lattice.last - lattice.first) * np.log(LIFT))[:, None]
    far = np.flatnonzero(~((sums > SMALLEST) & (sums < 1 / SMALLEST)).all(axis=1))
    if len(far):
        again = lattice if len(far) == len(words) else Lattice([words[k] for k in far], pieces)
        out[far] = again.forward(table[again.piece])[again.last]
    return out


def _portions(words: list[str]) -> Iterator[slice]:
    """Parts of a list of words of at most ``BATCH_BYTES`` bytes (or one word), short and long words apart."""
    at = size = 0
    for i, w in enumerate(words):
        n = 4 * len(w)
        if i > at and size + n > BATCH_BYTES:
            yield slice(at, i)
            at, size = i, 0
        size += n
    if at < len(words):
        yield slice(at, len(words))


def words_of(text: str) -> Counter:
    """Words of a text and how often they occur: runs of letters, lower-cased."""
    text = text.lower()
    runs = _RUN.findall(text) if len(text) < LONG else (m.group() for m in _RUN.finditer(text))
    found = Counter(runs)
    if found and not "".join(found).isalpha():  # numerals that are no digits
        found = Counter({w: n for w, n in found.items() if any(c.isalpha() for c in w)})
    return found


# ---- learning ----------------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, dict[str, int]] = {}
    chars = 0

    def out(lang: str, counts: dict[str, int]) -> pa.RecordBatch:
        columns = [pa.array([lang] * len(counts), pa.string()), pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])

    for part in slices(batches):
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
            own = held.setdefault(lang, {})
            before = own.get
            for w, n in words_of(text).items():
                own[w] = before(w, 0) + n
            chars += len(text)
            if chars >= HELD_CHARS or sum(map(len, held.values())) >= HELD:
                for item in held.items():
                    yield out(*item)
                held, chars = {}, 0
    for item in held.items():
        yield out(*item)


def _expected(path: str, languages: list[str], table: np.ndarray):
    """How often each piece is expected in the words of each language, one row per task, piece and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, place = pieces_of(path), {lang: k for k, lang in enumerate(languages)}
        total = np.zeros(table.shape)
        for batch in batches:
            rows = sorted(zip(batch.column("word").to_pylist(), batch.column("lang").to_pylist(), batch.column("n").to_pylist(), strict=True), key=lambda r: len(r[0]))
            words = [r[0] for r in rows]
            for part in _portions(words):
                lattice = Lattice(words[part], pieces)
                lang = np.array([place[r[1]] for r in rows[part]])[lattice.word]
                times = np.array([r[2] for r in rows[part]], float)
                weights = table[lattice.piece, lang][:, None]
                ahead, behind = lattice.forward(weights), lattice.backward(weights)
                whole = ahead[lattice.last][lattice.word]
                share = np.exp(ahead[lattice.at] + weights + behind[lattice.to] - whole)[:, 0]
                np.add.at(total, (lattice.piece, lang), share * times[lattice.word])
        piece, lang = np.nonzero(total)
        columns = [pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["piece", "lang", "n"])

    return run


@dataclass
class Model:
    """Log probabilities of pieces (pieces x languages) and of languages."""

    path: str
    languages: list[str]
    table: np.ndarray
    prior: np.ndarray


def _probabilities(counts: np.ndarray) -> np.ndarray:
    """Logs of smoothed shares: languages borrow from all together, and these from the even distribution."""
    pooled = counts.sum(axis=1) + EVEN / len(counts)
    pooled /= pooled.sum()
    return np.log((counts + BORROWED * pooled[:, None]) / (counts.sum(axis=0) + BORROWED))


def fit(docs: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang", turns: int = TURNS) -> Model:
    """Learn from the rows of ``docs`` with a language; null texts and texts without letters teach only how common it is.

    ``path``: the model file with the vocabulary. All words of all texts count; what comes to the driver is a number per piece and language, and
    the languages themselves. A table without languages gives a model that knows none.
    """
    named = docs.where(F.col(f"`{lang_col}`").isNotNull())
    rows = pick(named, lang_col, text_col).select(F.col("doc_id").cast("string").alias("lang"), "text")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    pieces = pieces_of(path)
    table = np.full((len(pieces), len(languages)), -np.log(len(pieces)))
    if not languages:
        return Model(path, languages, table, np.zeros(0))
    words = rows.mapInArrow(_counted, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = cut_lineage(words, "langid-words")
    for _ in range(turns):
        expected = words.mapInArrow(_expected(path, languages, table), "piece int, lang int, n double")
        found = expected.groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(table.shape)
        counts[found.column("piece").to_numpy(), found.column("lang").to_numpy()] = found.column("n").to_numpy()
        table = _probabilities(counts)
    prior = np.log(np.array([sizes[k] for k in languages], float) / sum(sizes.values()))
    return Model(path, languages, table, prior)


# ---- predicting --------------------------------------------------------------------------


class Scorer:
    """Log probabilities of texts by language; the words that came up lately are remembered."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, pieces_of(model.path)
        self.plain = lifted(model.table, self.pieces)
        self.known: list[tuple[dict[str, int], np.ndarray]] = [self._table(), self._table()]  # newer and older words
        self.chars = 0

    def _table(self) -> tuple[dict[str, int], np.ndarray]:
        return {}, np.zeros((KNOWN_WORDS // 2, len(self.model.languages)))

    def _logs(self, words: list[str]) -> np.ndarray:
        """Words x languages, remembered or summed now."""
        out = np.zeros((len(words), len(self.model.languages)))
        (new, recent), (old, before) = self.known
        found: tuple[list[int], ...] = ([], [], [], [])  # place and row of newer words, of older words
        open_: list[int] = []
        for k, w in enumerate(words):
            if (row := new.get(w)) is not None:
                found[0].append(k)
                found[1].append(row)
            elif (row := old.get(w)) is not None:
                found[2].append(k)
                found[3].append(row)
            else:
                open_.append(k)
        out[found[0]], out[found[2]] = recent[found[1]], before[found[3]]
        open_.sort(key=lambda k: len(words[k]))
        some = [words[k] for k in open_]
        for part in _portions(some):
            out[open_[part]] = word_logs(some[part], self.pieces, self.model.table, self.plain)
        for k in (*found[2], *open_):
            if len(self.known[0][0]) >= KNOWN_WORDS // 2 or 2 * self.chars >= KNOWN_CHARS:
                self.known, self.chars = [self._table(), self.known[0]], 0
            places, table = self.known[0]
            table[len(places)] = out[k]
            places[words[k]] = len(places)
            self.chars += len(words[k])
        return out

    def __call__(self, texts: list[str]) -> list[tuple[str, float]]:
        """Predicted language and its share for each text."""
        counted = [words_of(t) for t in texts]
        place = {w: k for k, w in enumerate(dict.fromkeys(w for c in counted for w in c))}
        logs = self._logs(list(place)) if self.model.languages else None
        out = []
        for c in counted:
            if not c or logs is None:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.model.prior + np.array(list(c.values()), float) @ logs[[place[w] for w in c]]
            best = int(np.argmax(total))
            out.append((self.model.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def _predicted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for part in slices(batches, size=1 << 20):
            found = scorer(part.column("text").to_pylist())
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, lang_pred, score`` (0 to 1, the share of the predicted language).

    Null text and text without a letter get ``und`` and score 0, and so does every text if the model knows no language.
    Of equally likely languages the first by name is predicted. Rows are judged one by one, null and repeated ids too; an
    empty table gives no rows. Nothing moves between tasks.
    """
    rows = pick(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predicted(model), f"doc_id {id_type}, lang_pred string, score double")
