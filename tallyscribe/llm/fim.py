"""Fill-in-middle by content-defined chunks: a rolling hash cuts texts, shared chunks are summarised once.

A text is cut where a rolling hash of its last 16 bytes says so, so passages that texts share fall into the same chunks
wherever they stand. What is needed of a chunk is a short summary of its inside and its two ends (``Chunk``). A worker keeps
the summaries of the chunks that it has seen, by their whole content, so two chunks share one only if all bytes are equal.
Summaries of neighbours are combined at their boundary, which counts the tokens of a text, and a running count finds the
chunks that hold the two cuts; only those chunks are taken apart again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscribe.llm.frames import pick, slices, utf8

SEED = 42
#: Out of 100: texts that are rearranged, and those of them that begin with the suffix.
RATE, SUFFIX_FIRST = 50, 80
# The marks of the three parts, in the order prefix, suffix, middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Mean bytes of a chunk (a power of two), longest chunk that is remembered, bytes that a worker remembers.
MEAN, LONGEST, KNOWN_BYTES = 512, 1 << 14, 24 << 20

_WORD = np.ones(256, np.uint8)
_WORD[[0x20, *range(0x09, 0x0E)]] = 0
_WORD_BYTES = _WORD.tobytes()
_GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29)).astype(np.uint32)


def chunk_ends(raw: np.ndarray, mean: int = MEAN) -> np.ndarray:
    """Where the chunks of some bytes end: after every byte whose rolling hash ends the window of 16 with a chosen value."""
    h = _GEAR[raw]
    for step in (1, 2, 4, 8):  # after it, h covers 2 * step bytes
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    chosen = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - mean.bit_length() + 1)
    ends = np.flatnonzero(chosen == 0) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))


class Chunk(NamedTuple):
    """Summary of a run of bytes; it says nothing of what stands before or after."""

    ends: int  # words that end inside, that is before white space of the same run
    first: bool  # it begins inside or at the start of a word
    last: bool  # its last byte is of a word
    chars: int  # code points that begin in it

    @staticmethod
    def of(content: bytes) -> Chunk:
        flags = content.translate(_WORD_BYTES)
        return Chunk(flags.count(b"\1\0"), flags[0] == 1, flags[-1] == 1, len(content) - _later_bytes(content))


def _later_bytes(content: bytes) -> int:
    """Bytes that continue a code point."""
    if content.isascii():
        return 0
    raw = np.frombuffer(content, np.uint8)
    return int(np.count_nonzero((raw & 0xC0) == 0x80))


class Known:
    """Summaries by content, up to a number of bytes; the older half goes when they are so many."""

    def __init__(self, limit: int = KNOWN_BYTES):
        self.limit, self.size, self.new, self.old = limit // 2, 0, {}, {}

    def __call__(self, content: bytes) -> Chunk:
        found = self.new.get(content)
        if found is None:
            found = self.old.get(content) or Chunk.of(content)
            if len(content) <= LONGEST:
                self.size += len(content) + 200  # the entry itself
                if self.size > self.limit:
                    self.old, self.new, self.size = self.new, {}, len(content) + 200
                self.new[content] = found
        return found


class Counted:
    """The summaries of a text put together: tokens up to each chunk, and the place behind any token."""

    def __init__(self, raw: bytes, ends: list[int], known: Known):
        self.raw = raw
        self.starts, self.before, self.chars = [0], [0], [0]
        words = chars = at = 0
        inside = False  # the byte before is of a word
        for end in ends:
            if end > at:
                c = known(raw[at:end])
                words += (inside and not c.first) + c.ends
                chars += c.chars
                inside, at = c.last, end
                self.starts.append(end)
                self.before.append(words)
                self.chars.append(chars)
        self.words = words + inside
        #: Every word ends a token; white space behind the last one is a token of its own.
        self.tokens = self.words + (bool(raw) and not inside)

    def cut(self, k: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``k`` tokens."""
        if k == 0:
            return 0, 0
        if k == self.tokens:
            return len(self.raw), self.chars[-1]
        # The k-th word ends in the last chunk that has fewer before it, or at that chunk's start.
        c = int(np.searchsorted(self.before, k, side="left")) - 1
        a, b = self.starts[c], self.starts[c + 1]
        flags = self.raw[a:b].translate(_WORD_BYTES)
        left = k - self.before[c]
        at = 0
        if a and _WORD_BYTES[self.raw[a - 1]] and not flags[0]:
            left -= 1  # a word that ends at the boundary
        while left:
            at = flags.index(b"\1\0", at) + 1
            left -= 1
        return a + at, self.chars[c] + at - _later_bytes(self.raw[a : a + at])


def draws(doc_id: object, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 from the seed and the id (a null id counts as an empty one)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4))


def _rearranged(raw: bytes, ends: list[int], doc_id: object, known: Known, seed: int, rate: int, suffix_first: int):
    """(tokens, form, prefix chars, middle chars, output) of one text."""
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    text = Counted(raw, ends, known)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not raw or h3 % 100 >= rate or p in raw or s in raw or m in raw:
        return text.tokens, "plain", None, None, raw
    low, high = sorted((h1 % (text.tokens + 1), h2 % (text.tokens + 1)))
    (a, chars_a), (b, chars_b) = text.cut(low), text.cut(high)
    if h4 % 100 < suffix_first:
        return text.tokens, "spm", chars_a, chars_b - chars_a, b"".join((s, raw[b:], p, raw[:a], m, raw[a:b]))
    return text.tokens, "psm", chars_a, chars_b - chars_a, b"".join((p, raw[:a], s, raw[b:], m, raw[a:b]))


def _run(seed: int, rate: int, suffix_first: int, mean: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for part in slices(batches):
            raw, starts = utf8(part)
            ends = np.union1d(chunk_ends(raw, mean), starts[1:]) if len(raw) else starts[1:]
            whole, found = raw.tobytes(), []
            for doc_id, a, b in zip(part.column("doc_id").to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                own = ends[np.searchsorted(ends, a, side="right") : np.searchsorted(ends, b, side="right")] - a
                found.append(_rearranged(whole[a:b], own.tolist(), doc_id, known, seed, rate, suffix_first))
            n, form, prefix, middle, output = zip(*found, strict=True)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(x, kind) for x, kind in zip((n, form, prefix, middle, output), kinds, strict=True)]
            columns[-1] = columns[-1].cast(pa.string(), safe=False)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
    mean: int = MEAN,
) -> DataFrame:
    """One row per input row: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    A text has ``n`` tokens: each word with the ASCII white space before it, and white space at the end. ``rate`` of 100 texts
    are cut after two token numbers drawn from the seed and the id, ``suffix_first`` of 100 of them in form ``spm``, the
    others in form ``psm``; all others, empty ones and those that hold a mark stay ``plain`` with null lengths.

    Null text is empty. Rows are rearranged one by one: repeated ids draw the same numbers for their own texts, a null id
    draws as an empty one, and an empty table gives no rows. Nothing moves between tasks; a task holds a few MB of text
    or its longest one, and ``KNOWN_BYTES`` of remembered chunks.
    """
    rows = pick(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {id_type}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return rows.mapInArrow(_run(seed, rate, suffix_first, mean), out)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text from its rearranged form. Parts hold no mark, so the marks cut them apart exactly."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    joined = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    text = F.col(output)
    for name, order in joined.items():
        text = F.when(F.col(form) == name, F.concat(*[F.get(parts, k) for k in order])).otherwise(text)
    return text
