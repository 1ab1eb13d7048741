"""Token ids of whole texts with the tokenizers library, at the price of the distinct pieces.

A byte-pair model works inside pre-tokens, and the two file layouts used here never let a pre-token cross a single space
between two visible characters. So a text is split there, each distinct piece is encoded once per worker, and the ids
are joined. Tables of known pieces are bounded. Files of another layout are encoded text by text.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

from tokenizers import Tokenizer

#: Pieces and pre-tokens a worker remembers, by the layout of the file (up to about 200 bytes each); the older half goes when they
#: are this many.
KNOWN = {"word": (600_000, 600_000), "byte": (800_000, 1_400_000), "other": (800_000, 1_400_000)}

_SPACE = "\\t-\\r \\x85\\xa0"
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_NUMBER = "0-9²³¹¼-¾"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
# The pre-token patterns of the two layouts, for texts of Latin-1 letters.
_WORDS = re.compile(f"{_SHORT}|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_BYTES = re.compile(
    f"{_SHORT}| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")


def byte_chars() -> list[str]:
    """The visible character that stands for each byte in the vocabulary of a byte-level model."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return [out[b] for b in range(256)]


class Recent(dict):
    """A table that forgets its older entries when full, and fills itself by ``make``."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, max(2, limit // 2), {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Encoder:
    """Ids of a text as bytes of little-endian unsigned 32-bit integers, equal to ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, word_ids=None):
        """``word_ids``: ids of one mapped pre-token; by default those of the library's model."""
        with open(path, encoding="utf-8") as f:
            layout = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.word_ids = word_ids or (lambda mapped: [t.id for t in self.model.tokenize(mapped)])
        self.special = [t["content"] for t in layout["added_tokens"]]
        self.map = str.maketrans(dict(enumerate(byte_chars())))
        self.kind = self._kind(layout)
        self.words = Recent(self._word, KNOWN[self.kind][1])
        self.pieces = Recent({"word": self._word_piece, "byte": self._later_piece}.get(self.kind, self._whole), KNOWN[self.kind][0])

    def _kind(self, layout: dict) -> str:
        pre, norm = layout.get("pre_tokenizer") or {}, layout.get("normalizer") or {}
        plain = not any(" " in s or t["single_word"] or t["lstrip"] or t["rstrip"] for s, t in zip(self.special, layout["added_tokens"], strict=True))
        if not plain or layout["model"]["type"] != "BPE" or layout["model"].get("dropout"):
            return "other"
        if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not norm:
            return "byte"
        steps, parts = norm.get("normalizers", []), pre.get("pretokenizers", [])
        if [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"]:
            if parts[0]["pattern"] == {"Regex": _WORD_PATTERN} and not parts[1]["use_regex"] and steps[1]["pattern"] == {"Regex": "\\s+"}:
                return "word"
        return "other"

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():  # these letters stand for themselves
            return array("I", self.word_ids(word)).tobytes()
        mapped = word.encode().decode("latin-1").translate(self.map)
        return array("I", self.word_ids(mapped)).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, piece: str) -> bool:
        """Only Latin-1 letters and no special token: then the patterns above say what the library's say."""
        return (piece.isascii() or max(piece) < "Ā") and not ("<" in piece and any(s in piece for s in self.special))

    def _word_piece(self, piece: str) -> bytes:
        if not piece:
            return b""
        if not self._plain(piece):
            return self._whole(piece)
        piece = piece.lower()
        if piece.isalpha():
            return self.words[piece]
        return b"".join(map(self.words.__getitem__, _WORDS.findall(piece)))

    def _later_piece(self, piece: str) -> bytes:
        """A piece that follows a space; a single word is a pre-token with it."""
        spaced = " " + piece
        return self._word(spaced) if piece.isalpha() and max(piece) < "Ā" else self._byte_piece(spaced)

    def _byte_piece(self, piece: str) -> bytes:
        if not piece:
            return b""
        if not self._plain(piece):
            return self._whole(piece)
        return b"".join(map(self.words.__getitem__, _BYTES.findall(piece)))

    def encode(self, text: str) -> bytes:
        if self.kind == "word":
            # White space only separates here. Python's split() also cuts at four control characters that are no white space.
            parts = text.split(" ") if SEPARATORS.search(text) else text.split()
            return b"".join(map(self.pieces.__getitem__, parts))
        if self.kind == "other" or not text:
            return self._whole(text)
        # A space between two visible characters begins a pre-token; any other white space stays inside its piece.
        parts = _INNER_SPACE.split(text) if odd_space(text) else text.split(" ")
        return self._byte_piece(parts[0]) + b"".join(map(self.pieces.__getitem__, parts[1:]))


SEPARATORS = re.compile("[\x1c-\x1f]")
ODD_SPACE = re.compile(r"^ | $|  | [^\S ]|[^\S ] ")
_RARE_SPACE = re.compile(r"[^\S \n]")


def odd_space(text: str) -> bool:
    """Whether ``ODD_SPACE`` is in a text, by plain searches wherever spaces and line ends are its only white space."""
    if text.startswith(" ") or text.endswith(" ") or "  " in text or " \n" in text or "\n " in text:
        return True
    return bool(_RARE_SPACE.search(text) and ODD_SPACE.search(text))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per file and worker process, so that tasks share what it knows."""
    return Encoder(path)
