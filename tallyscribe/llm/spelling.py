"""Spelling variants: words one letter apart, found by bit-sliced position indexes, linked to much more frequent ones.

For every (position, letter) a bitset over the vocabulary says which words have that letter there. A word is looked up by
walking over its letters; four bitsets of candidates are carried along and each step is a few word-wide operations:

* ``same``: candidates equal so far,
* ``replaced``: one letter differs so far, ``longer``: the candidate has one letter more so far (so its positions are
  shifted by one), ``shorter``: it has one less.

A whole table of words is looked up in the index of the same table at once, one row of bits per word.

Tables are made small by a fact that loses no pair: cut the shorter of two near words in three parts; one edit touches one of
them, so the words agree in the other two. Words that agree in two parts meet in one block (``_blocks``); blocks of one kind
share tables, and a large block is dealt over tasks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscribe.llm.frames import LOWER, UPPER, pick, slices
from tallyscribe.sources.storage import cut_lineage

MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
RUN = re.compile("[A-Za-zÀ-ÿ]+")
_FOLD = str.maketrans(UPPER, LOWER)

#: Words that a task counts before it hands them on, and their code points.
HELD, HELD_CHARS = 200_000, 8_000_000
#: Code points from which on the runs of a text are not listed all at once.
LONG = 1 << 20
#: Words and code points of one bit-sliced table, and the words of a block that one task looks up.
TABLE, TABLE_CHARS, SHARE = 2048, 1 << 22, 1 << 16


# ---- vocabulary --------------------------------------------------------------------------


def word_of(run: str, salt: int, drop_every: int | None) -> str:
    """The word of a lower-cased run; ``salt`` is the crc32 of what stands before it in the drawn key."""
    if drop_every:
        h = zlib.crc32(run.encode(), salt)
        if h % drop_every == 0:
            at = h % len(run)
            return run[:at] + run[at + 1 :]
    return run


def _counted(min_chars: int, drop_every: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        chars = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for part in slices(batches):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                salt = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                own: dict[str, int] = {}
                runs = RUN.findall(text) if len(text) < LONG else (m.group() for m in RUN.finditer(text))
                for w, n in Counter(runs).items():
                    if len(w) >= min_chars:
                        w = w if w.islower() else w.translate(_FOLD)
                        own[w] = own.get(w, 0) + n
                for w, n in own.items():  # the draw depends on the document and the run alone
                    w = word_of(w, salt, drop_every)
                    if len(w) >= min_chars:
                        before = held.get(w, 0)
                        held[w] = before + n
                        chars += len(w) if not before else 0
                if len(held) >= HELD or chars >= HELD_CHARS:
                    yield out()
                    held, chars = {}, 0
        if held:
            yield out()

    return run


def vocabulary(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    drop_every: int | None = None,
) -> DataFrame:
    """``word, n``: words of at least ``min_chars`` code points that occur ``min_count`` times or more in all texts.

    A word is a run of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. With ``drop_every`` one of so many (document,
    run) pairs loses a code point, drawn by the crc32 of ``<doc_id>:<run>``: slips made on purpose.

    Words are counted in the tasks before they move.
    """
    parts = pick(docs, id_col, text_col).mapInArrow(_counted(min_chars, drop_every), "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---- near words --------------------------------------------------------------------------


def _keys(words: list[str], shorter: int, kind: int) -> list[str]:
    """What words of ``shorter`` or one more letters have outside part ``2 - kind`` of three."""
    one, two = shorter // 3, 2 * shorter // 3
    if kind == 0:
        return [w[:two] for w in words]
    if kind == 1:
        return [w[:one] + w[len(w) - (shorter - two) :] for w in words]
    return [w[len(w) - (shorter - one) :] for w in words]


def _blocks(least: int):
    """Every word under its blocks: for the shorter and the longer place in a pair, three kinds each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            shorter, kind, key, at = [], [], [], []
            for i, w in enumerate(words):
                for size in (len(w), len(w) - 1):
                    if size >= least:
                        for k in range(3):
                            shorter.append(size)
                            kind.append(k)
                            key.append(_keys([w], size, k)[0])
                            at.append(i)
            new = [pa.array(shorter, pa.int32()), pa.array(kind, pa.int32()), pa.array(key, pa.string())]
            old = [batch.column(c).take(pa.array(at, pa.int32())) for c in ("word", "n")]
            yield pa.RecordBatch.from_arrays([*new, *old], ["shorter", "kind", "key", "word", "n"])

    return run


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit numbers."""
    width = -(-flags.shape[1] // 64) * 64
    padded = np.zeros((len(flags), width), bool)
    padded[:, : flags.shape[1]] = flags
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


class PositionIndex:
    """Bitsets over a list of words, one per position and letter."""

    def __init__(self, letters: np.ndarray, sizes: np.ndarray):
        """``letters``: words x positions, 0 behind the end of a word."""
        self.letters, self.sizes = letters, sizes
        self.width = letters.shape[1]
        self.none = _bits(np.zeros((1, len(sizes)), bool))

    def having(self, position: int, letters: np.ndarray) -> np.ndarray:
        """For each of ``letters`` the bitset of the words that have it at ``position``."""
        if not 0 <= position < self.width:
            return np.repeat(self.none, len(letters), axis=0)
        column = self.letters[:, position]
        known, row = np.unique(letters, return_inverse=True)
        return _bits(column[None, :] == known[:, None])[row]

    def of_size(self, sizes: np.ndarray) -> np.ndarray:
        known, row = np.unique(sizes, return_inverse=True)
        return _bits(self.sizes[None, :] == known[:, None])[row]

    def near(self, letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Row per word looked up: the bitset of the words at exactly one insertion, deletion or replacement."""
        everything = _bits(np.ones((1, len(self.sizes)), bool))
        same = np.repeat(everything, len(sizes), axis=0)
        replaced, shorter = np.zeros_like(same), np.zeros_like(same)
        longer = same.copy()  # a letter more before the first one
        found = np.zeros_like(same)
        for i in range(letters.shape[1]):
            going = sizes > i
            letter = letters[:, i]
            here, next_, before = self.having(i, letter), self.having(i + 1, letter), self.having(i - 1, letter)
            shorter = (shorter & before) | same
            replaced = (replaced & here) | (same & ~here)
            same = same & here
            longer = (longer & next_) | same
            done = np.flatnonzero(going & (sizes == i + 1))
            if len(done):
                size = sizes[done]
                found[done] = (
                    (replaced[done] & self.of_size(size)) | (longer[done] & self.of_size(size + 1)) | (shorter[done] & self.of_size(size - 1))
                )
        return found


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words as rows, 0 behind their ends, and their lengths."""
    sizes = np.array([len(w) for w in words])
    wide = np.array(words, dtype=f"U{max(int(sizes.max()), 1)}")
    return wide.view(np.uint32).reshape(len(words), -1), sizes


def _pairs(asking: list[str], index: list[str], shorter: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of two tables (places in each) that belong to this kind of block.

    A pair can agree in more than one choice of two parts; it belongs to the first.
    """
    letters, sizes = _matrix(index)
    asked, asked_sizes = _matrix(asking)
    found = PositionIndex(letters, sizes).near(asked, asked_sizes)
    rows = np.flatnonzero(found.any(axis=1))
    if not len(rows):
        return rows, rows
    flags = np.unpackbits(found[rows].view(np.uint8), axis=1, bitorder="little", count=len(index))
    at, to = np.nonzero(flags)
    at = rows[at]
    keep = (np.minimum(asked_sizes[at], sizes[to])) == shorter
    for k in range(kind + 1):
        left, right = np.array(_keys(asking, shorter, k)), np.array(_keys(index, shorter, k))
        equal = left[at] == right[to]
        keep &= equal if k == kind else ~equal
    return at[keep], to[keep]


def _tables(rows: list, blocks: list, width: int) -> Iterator[tuple[int, int]]:
    """Cut rows where a table is full, between blocks if possible. A block that fits no table is cut inside."""
    limit = max(1, min(TABLE, TABLE_CHARS // (width + 1)))
    at = 0
    while at < len(rows):
        to = min(at + limit, len(rows))
        if to < len(rows):
            back = to
            while back > at and blocks[back] == blocks[back - 1]:
                back -= 1
            if back > at:
                to = back
            else:  # one block: all of it, to be looked up table by table
                while to < len(rows) and blocks[to] == blocks[to - 1]:
                    to += 1
        yield at, to
        at = to


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block and word: how many near words there are in it, and the first of them by (count, word).

    Rows come sorted by (shorter, kind, key, share), so all rows of a block stand together.
    """

    def answers(kind: tuple[int, int], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        shorter, which = kind
        blocks = [(r[0], r[1]) for r in rows]
        for a, b in _tables(rows, blocks, shorter):
            part = rows[a:b]
            words, n, asks = [r[2] for r in part], np.array([r[3] for r in part]), [r[4] for r in part]
            step = max(1, min(TABLE, TABLE_CHARS // (shorter + 1)))
            asking = [i for i, x in enumerate(asks) if x]
            total = np.zeros(len(part), np.int64)
            best: dict[int, tuple[int, str]] = {}
            for i in range(0, len(asking), step):
                mine = np.array(asking[i : i + step])
                for j in range(0, len(part), step):
                    at, to = _pairs([words[k] for k in mine], words[j : j + step], shorter, which)
                    if len(at):
                        at, to = mine[at], to + j
                        together = np.array([blocks[x] == blocks[y] for x, y in zip(a + at, a + to, strict=True)], bool)
                        for x, y in zip(at[together].tolist(), to[together].tolist(), strict=True):
                            total[x] += 1
                            found = (-int(n[y]), words[y])
                            if x not in best or found < best[x]:
                                best[x] = found
            rows_out = sorted(best)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([words[i] for i in rows_out], pa.string()),
                    pa.array([int(total[i]) for i in rows_out], pa.int64()),
                    pa.array([-best[i][0] for i in rows_out], pa.int64()),
                    pa.array([best[i][1] for i in rows_out], pa.string()),
                ],
                ["word", "n_near", "near_n", "near"],
            )

    kind, rows, size = None, [], 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("shorter", "kind", "key", "share", "word", "n", "asks")]
        for shorter, which, key, share, word, n, asks in zip(*columns, strict=True):
            full = (len(rows) >= 4 * TABLE or size >= TABLE_CHARS) and rows[-1][:2] != (key, share)
            if kind != (shorter, which) or full:
                if rows:
                    yield from answers(kind, rows)
                kind, rows, size = (shorter, which), [], 0
            rows.append((key, share, word, n, asks))
            size += len(word)
    if rows:
        yield from answers(kind, rows)


def near_words(words: DataFrame, least: int = 3, share: int = SHARE) -> DataFrame:
    """``word, n_near, near, near_n`` for words with a near word in ``words`` (``word, n``): how many, and the most frequent.

    No word may be shorter than ``least``, which is 3 or more. Of equally frequent near words the smallest by code points counts. A block of more than ``share`` words is dealt out:
    each share of its words is looked up by another task, in the whole block.
    """
    keyed = words.mapInArrow(_blocks(least), "shorter int, kind int, key string, word string, n bigint")
    block = ["shorter", "kind", "key"]
    large = keyed.groupBy(*block).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > share)
    shares = F.coalesce(F.ceil(F.col("size") / share), F.lit(1)).cast("int")
    dealt = (
        keyed.join(large, block, "left")
        .withColumn("shares", shares)
        .withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        .withColumn("asks", F.pmod(F.xxhash64("word"), F.col("shares")) == F.col("share"))
        .select(*block, "share", "word", "n", "asks")
    )
    sorted_rows = dealt.repartition(*block, "share").sortWithinPartitions("shorter", "kind", "key", "share")
    found = sorted_rows.mapInArrow(_near, "word string, n_near bigint, near_n bigint, near string")
    first = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")).select(
        "word", "n_near", F.col("first.word").alias("near"), (-F.col("first.n")).alias("near_n")
    )


# ---- groups ------------------------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``forms (word, form)``: the form that has no form itself.

    Every step at least multiplies the count, so chains are short; each turn doubles how far a word looks.
    """
    ahead = cut_lineage(forms.select("word", F.col("form").alias("root")), "variants-ahead")
    while True:
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        turned = cut_lineage(
            ahead.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "variants-ahead",
        )
        ahead = turned.select("word", "root")
        if turned.where("moved").isEmpty():
            return ahead


def variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
    drop_every: int | None = None,
) -> DataFrame:
    """One row per word of ``vocabulary``: ``word, form, root, n, n_near, form_n``.

    Near words differ by one inserted, deleted or replaced code point. The form of a word is its near word of largest count
    (ties: the smallest by code points) if that is at least ``ratio`` times its own count, else null; ``root`` follows the
    forms to the last one and is the word itself if it has none. ``ratio`` must be at least 2, so that chains end;
    ``min_chars`` at least 3.

    Null and empty texts have no words. Rows that repeat an id or a text count again, a null id draws as an empty one,
    and a table without words gives no rows.
    """
    if ratio < 2 or min_chars < 3:
        raise ValueError("ratio must be at least 2 and min_chars at least 3")
    words = cut_lineage(vocabulary(docs, id_col, text_col, min_chars, min_count, drop_every), "variants-words")
    near = near_words(words, min_chars)
    has = F.col("near_n") >= ratio * F.col("n")
    linked = cut_lineage(
        words.join(near, "word", "left").select(
            "word", F.when(has, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("near_n")).alias("form_n")
        ),
        "variants-linked",
    )
    roots = _roots(linked.where("form IS NOT NULL"))
    return linked.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
