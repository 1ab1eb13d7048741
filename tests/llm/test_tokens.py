"""Token files, the prefix encoder, and packing against the tokenizers library."""

import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyscribe.llm import bpe, packing, tokenfiles
from tallyscribe.llm.tokenizing import ODD_SPACE, Encoder, Recent, odd_space

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def some_texts():
    rng = random.Random(4)
    letters = " \n\t  abcdeXYZ'!.é\xa0\x85\x1c0½́Σ日<|"
    out = ["", " ", "  a b  c ", "\n\n a\tb", "a <|endoftext|> b<|startoftext|>c <|endoftext", "İstanbul ΑΣ ΑΣ. x", "don't I'LL we've 'sup"]
    out += ["日本語 text 😀", "½ ² 12 345", "ß ẞ ª º µ", "x  y", "a" * 3000, "ab" * 900, "bananananana " * 50]
    return out + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(1500)]


@pytest.mark.parametrize("name", FILES)
def test_pieces_and_prefixes_equal_the_library(name, small):
    path = public_tokenizers.path(name)
    library, pieces, codec = Tokenizer.from_file(path), Encoder(path), bpe.Codec(path)
    for text in some_texts() + [r.text for r in small.limit(40).collect()]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert pieces.encode(text) == array("I", ids).tobytes(), text[:80]
        assert codec.encode(text) == array("I", ids).tobytes(), text[:80]
        assert codec.decode(codec.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_prefix_encoder_on_small_vocabularies():
    """Random merge tables with ties and overlaps: the table of last tokens gives what merging by rank gives."""
    rng = random.Random(5)
    for _ in range(40):
        vocab, merges = {c: k for k, c in enumerate("abc")}, []
        while len(merges) < 12:
            a, b = rng.choice(list(vocab)), rng.choice(list(vocab))
            if a + b not in vocab:
                vocab[a + b] = len(vocab)
                merges.append((a, b))
        enc = bpe.PrefixEncoder(vocab, merges)
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 25)))
            assert enc.ids(word) == bpe.merge_all([vocab[c] for c in word], enc.rank, enc.merged), (merges, word)
        assert enc.ids("axb") == bpe.merge_all([vocab["a"], vocab["b"]], enc.rank, enc.merged)


def test_recent_table_is_bounded_and_right():
    table = Recent(lambda k: k * k, 10)
    assert [table[k % 17] for k in range(200)] == [(k % 17) ** 2 for k in range(200)]
    assert len(table) + len(table.old) <= 11


@pytest.mark.parametrize("top", [1, 200, 70_000, 1 << 31])
def test_codes_give_any_range(top):
    rng = np.random.default_rng(top)
    ids = rng.integers(0, top, 3000).astype(np.uint32)
    raw = tokenfiles.write_codes(ids, np.array([7, 9]), np.array([0, 1000, 3000]))
    file = tokenfiles.TokenFile(lambda at, n: raw[at : at + n])
    assert [x.tolist() for x in file.documents()] == [[7, 9], [0, 1000, 3000]]
    for a, b in [(0, 3000), (0, 0), (511, 513), (2999, 3000), *(sorted(rng.integers(0, 3001, 2)) for _ in range(100))]:
        assert np.array_equal(file.tokens(int(a), int(b)), ids[a:b])
    none = tokenfiles.write_codes(ids[:0], np.zeros(0), np.zeros(1))
    assert len(tokenfiles.TokenFile(lambda at, n: none[at : at + n]).tokens(0, 0)) == 0


def test_token_files_round_trip(odd, empty, tmp_path):
    path, folder = public_tokenizers.path(FILES[0]), f"file:{tmp_path}/tokens"
    library = Tokenizer.from_file(path)
    manifest = tokenfiles.write_tokens(odd, folder, path, file_tokens=500)
    got = [tuple(r) for r in tokenfiles.read_documents(manifest, folder).orderBy("start").collect()]
    ids = lambda t: array("I", [*library.encode(t or "", add_special_tokens=False).ids, 2])
    want = sorted((r.doc_id is not None, r.doc_id or 0, len(ids(r.text)), zlib.crc32(ids(r.text).tobytes())) for r in odd.collect())
    assert sorted((i is not None, i or 0, n, c) for i, _, n, c in got) == want
    assert [i for i, *_ in got] == sorted((i for i, *_ in got), key=lambda i: (i is not None, i or 0))
    assert [s for _, s, *_ in got] == np.cumsum([0, *[n for _, _, n, _ in got]])[:-1].tolist()
    assert tokenfiles.round_trip(empty, path).count() == 0


def test_bpe_codec_rows(odd, empty):
    path = public_tokenizers.path(FILES[1])
    library = Tokenizer.from_file(path)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.encode_decode(odd, path).collect())
    want = []
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id is not None, r.doc_id or 0, len(ids), array("I", ids).tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert bpe.encode_decode(empty, path, digests=True).count() == 0


@pytest.mark.parametrize("window", [64, 4096])
def test_packing(odd, empty, window):
    path = public_tokenizers.path(FILES[1])
    library = Tokenizer.from_file(path)
    pieces = packing.pack(odd.repartition(3), path, window=window).collect()
    spots = sorted((r.sequence_id * window + r.offset, r.length) for r in pieces)
    assert spots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spots, spots[1:], strict=False))
    assert all(r.offset + r.length <= window and r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in pieces)
    total = sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    assert sum(r.length for r in pieces) == total
    per_doc = {}
    for r in sorted(pieces, key=lambda r: r.start):
        per_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    assert per_doc[(8, len(library.encode(odd.where("doc_id = 8").first().text, add_special_tokens=False).ids) + 1)][0][0] == 0
    assert packing.pack(empty, path).count() == 0


def test_sequences_are_padded(odd):
    path = public_tokenizers.path(FILES[1])
    pieces = packing.pack(odd, path, window=64)
    rows = packing.sequences(pieces, window=64, pad_id=7).orderBy("sequence_id").collect()
    assert all(len(r.ids) == 256 or (r.n_tokens & (r.n_tokens - 1) == 0 and len(r.ids) == 4 * r.n_tokens) for r in rows)
    assert all(r.n_tokens == 64 for r in rows[:-1])


def test_odd_spaces_are_found_by_plain_searches():
    spaces = [" ", "\n", "\t", "\xa0", "\u2003", "\x1c"]
    texts = some_texts() + [f"{a}{x}{b}{y}" for a in ("", "a") for x in spaces for y in (*spaces, "z") for b in ("", "b")]
    assert [odd_space(t) for t in texts] == [bool(ODD_SPACE.search(t)) for t in texts]
