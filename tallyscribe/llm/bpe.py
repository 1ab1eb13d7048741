"""Byte-pair encoding by dynamic programming over prefixes.

The encoding of a prefix ends in exactly one token, and that token fixes the rest: cutting it off leaves the encoding of
the shorter prefix. So for each prefix only its last token is stored. The candidates are the vocabulary entries that are
suffixes of the prefix, found by an automaton with suffix links; a candidate is right if it is compatible with the last
token of what it leaves over, that is, if merging the two tokens' symbols gives back exactly these two. Following the
stored tokens from the end gives the ids.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyscribe.llm.frames import pick, slices
from tallyscribe.llm.tokenizing import Encoder, Recent

#: Stands for the end-of-word mark inside the automaton, as a letter of its own after the last one.
END = "\U0010fffe"
NEVER = 1 << 60

#: Pairs of tokens whose compatibility a worker remembers.
KNOWN_PAIRS = 500_000


class PrefixEncoder:
    """Ids of one pre-token (characters of the vocabulary) by the table of last tokens."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end_mark: str | None = None):
        self.mark, self.vocab = end_mark or "", vocab
        self.merged: dict[int, int] = {}  # rank: the token it makes
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # id: rank of its merge, left, right
        for rank, (a, b) in enumerate(merges):
            whole = vocab.get(a + b)
            if whole is None or a not in vocab or b not in vocab:
                continue
            pair = vocab[a], vocab[b]
            self.rank.setdefault(pair, rank)
            self.merged[rank] = whole
            self.parts.setdefault(whole, (rank, *pair))
        self.automaton = ahocorasick.Automaton()
        for text, i in vocab.items():
            ends = bool(self.mark) and text.endswith(self.mark)
            letters = text[: len(text) - len(self.mark)] if ends else text
            if (i in self.parts or len(letters) == 1) and self._whole(i):
                self.automaton.add_word(letters + END if ends else letters, (len(letters), i))
        self.automaton.make_automaton()
        self.fits = Recent(self._fits, KNOWN_PAIRS)

    def _compatible(self, x: int, y: int, limit: int) -> bool:
        """Whether ``x`` and ``y``, side by side, stay apart while merges before ``limit`` are made.

        Walks back in time from the finished tokens: the merge made last is undone first, down to the symbols at the
        seam. On the way a merge across the seam must not have come before the merge that took one of the two in. Of
        equal merges the left one is made first, so a crossing one loses against the left side and beats the right one.
        """
        taken_x = taken_y = limit
        while True:
            across = self.rank.get((x, y))
            if across is not None and across < taken_x and across <= taken_y and across < limit:
                return False
            made_x, made_y = self.parts.get(x), self.parts.get(y)
            if made_x is None and made_y is None:
                return True
            if made_y is None or (made_x is not None and made_x[0] > made_y[0]):
                taken_x, x = made_x[0], made_x[2]
            else:
                taken_y, y = made_y[0], made_y[1]

    def _whole(self, token: int) -> bool:
        """Whether the token's own symbols merge into it."""
        todo = [token]
        while todo:
            made = self.parts.get(todo.pop())
            if made is not None:
                rank, left, right = made
                if not self._compatible(left, right, rank):
                    return False
                todo += [left, right]
        return True

    def _fits(self, pair: int) -> bool:
        return self._compatible(pair >> 32, pair & 0xFFFFFFFF, NEVER)

    def ids(self, word: str) -> list[int]:
        """Ids of ``word``; letters that the vocabulary lacks are left out, as a model without an unknown token does."""
        n, fits = len(word), self.fits
        last = [-1] * (n + 1)  # the last token of each prefix; -1 while none is found
        size = [0] * (n + 1)
        for end, (length, token) in self.automaton.iter(word + END if self.mark else word):
            to = end + 1
            if to == n and self.mark:
                continue  # the last letter carries the end mark
            to = min(to, n)
            if last[to] >= 0:
                continue
            start = to - length
            if start == 0 or (last[start] >= 0 and fits[last[start] << 32 | token]):
                last[to], size[to] = token, length
        if n and last[n] < 0:
            return self._with_gaps(word)
        out, at = [], n
        while at > 0:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _with_gaps(self, word: str) -> list[int]:
        """Some letter is not in the vocabulary: merge what is left by rank, step by step."""
        symbols = [self.vocab.get(c) for c in word[:-1]] + [self.vocab.get(word[-1] + self.mark)]
        return merge_all([s for s in symbols if s is not None], self.rank, self.merged)


def merge_all(symbols: list[int], rank: dict[tuple[int, int], int], whole: dict[int, int]) -> list[int]:
    """Plain byte-pair merging: the lowest rank first, of equal ones the left one."""
    symbols = list(symbols)
    while len(symbols) > 1:
        best, at = min((rank.get(p, NEVER), k) for k, p in enumerate(zip(symbols, symbols[1:], strict=False)))
        if best == NEVER:
            break
        symbols[at : at + 2] = [whole[best]]
    return symbols


def prefix_encoder(path: str) -> PrefixEncoder:
    """The encoder of a tokenizers file with a byte-pair model."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model["type"] != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix"):
        raise ValueError("only plain byte-pair models")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return PrefixEncoder(model["vocab"], merges, model.get("end_of_word_suffix"))


class Codec:
    """Encoding of whole texts, and decoding as the library does without a decoder: tokens joined by a space."""

    def __init__(self, path: str):
        self.prefixes = prefix_encoder(path)
        self.encoder = Encoder(path, self.prefixes.ids)
        tok = self.encoder.tokenizer
        self.joined = tok.decoder is None
        self.token = [tok.id_to_token(i) for i in range(tok.get_vocab_size())]

    def encode(self, text: str) -> bytes:
        return self.encoder.encode(text)

    def decode(self, raw: bytes) -> str:
        ids = np.frombuffer(raw, "<u4").tolist()
        if self.joined:
            return " ".join(map(self.token.__getitem__, ids))
        return self.encoder.tokenizer.decode(ids, skip_special_tokens=False)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _code(path: str, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = codec(path)
        for part in slices(batches, size=1 << 20 if full else 4 << 20):
            ids = [work.encode(x) for x in part.column("text").to_pylist()]
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            if full:
                columns = [pa.array(ids, pa.binary()), pa.array([work.decode(x) for x in ids], pa.string())]
                names = ["ids", "decoded"]
            else:
                columns = [
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(work.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ]
                names = ["ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, *columns], ["doc_id", "n_tokens", *names])

    return run


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids, decoded`` (ids: little-endian unsigned 32-bit integers).

    With ``digests`` the last two are ``ids_sha256, decoded_sha256`` instead, taken where the ids are made. Null and
    empty text have no tokens and decode to an empty text. Rows are coded one by one, null and repeated ids too; an
    empty table gives no rows. Nothing moves between tasks.
    """
    rows = pick(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string"
    return rows.mapInArrow(_code(tokenizer_path, not digests), f"doc_id {id_type}, n_tokens bigint, {tail}")
