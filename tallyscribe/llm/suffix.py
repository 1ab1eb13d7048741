"""Repeated strings of at least ``length`` bytes, by ranks of positions at growing offsets.

Plain prefix doubling ranks every position of the corpus again at each offset. Here a position takes part only while its
string can still be repeated:

1. Every window of ``length`` bytes names one anchor in it: the leftmost of its ``GRAM``-byte strings that come first in
   a fixed order of strings. Equal windows have the same anchor at the same place, so windows of an anchor
   whose string is unique are unique. The windows that share an anchor are a run.
2. Runs that reach equally far and are equal over their whole reach are one class, again by rank. A class with two
   members is repeated through and through; nothing more is asked about it.
3. What is left are single runs beside another class of the same anchor, at the ends of a repeated passage. Their windows
   are ranked at full length among the windows of that anchor.

So each step sorts (rank, place) pairs at a longer reach and goes on with those that are neither unique nor past the
threshold. Ranks are 64-bit numbers of strings instead of counted places; steps 1 and 2 use both numbers together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyscribe.llm.frames import slices, utf8
from tallyscribe.llm.words import ADDENDS, BASE, PRIME, halves, joined, mix, powers, times
from tallyscribe.sources.storage import cut_lineage

LENGTH = 200
GRAM = 50

#: An anchor with more classes than this has its windows ranked by Spark instead of inside one task.
GROUP = 4096

#: Forms of what is left: the bytes, their digest in hex, or the text without characters that were cut.
ARROW = {"bytes": pa.binary(), "sha256": pa.string(), "text": pa.string()}

#: Bytes of text that are ranked at a time.
BLOCK = 1 << 18

_STEPS = {1 << k: pow(BASE, 1 << k, 1 << 64) for k in range(16)}


class Ranks:
    """64-bit numbers of the substrings of ``raw`` of up to ``ADDENDS`` bytes."""

    def __init__(self, raw: np.ndarray):
        self.sums = [np.append(np.uint64(0), np.cumsum(x)) for x in halves(raw, powers(len(raw))[: len(raw)])]
        self.down = powers(len(raw) + 1, pow(BASE, -1, PRIME))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # The sums wrap in very long runs of text; differences of places that are near are right all the same.
        return mix(times(joined(*(x[b] - x[a] for x in self.sums)), self.down[a]))


def _order(raw: np.ndarray) -> np.ndarray:
    """A number of each ``GRAM``-byte string that only serves to choose anchors: strings may share one."""
    value, reach = raw.astype(np.uint64) + np.uint64(1), 1
    while reach < GRAM:
        step = min(reach, GRAM - reach)
        value, reach = value[:-step] * np.uint64(_STEPS[reach]) + value[step:], reach + step
    return mix(value)


def _anchors(rank: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` neighbours the place of its smallest rank, the leftmost if there are several."""
    best, at, k = rank, np.arange(len(rank)), 1
    while k < width:
        step = min(k, width - k)
        left = best[:-step] <= best[step:]
        best, at, k = np.where(left, best[:-step], best[step:]), np.where(left, at[:-step], at[step:]), k + step
    return at


def _block_runs(raw: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    rank = Ranks(raw)
    anchor = _anchors(_order(raw), length - GRAM + 1)
    new = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    first, last = new, np.append(new[1:], len(anchor)) - 1
    anchor = anchor[new]
    gram = rank(anchor, anchor + GRAM)
    reach = (anchor - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)
    return first, last, gram, mix(rank(first, last + length) + mix(reach + gram))


def runs(raw: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """First and last window, rank of the anchor and class of each run of one text. Long texts are cut into blocks."""
    n = len(raw) - length + 1
    parts = []
    for a in range(0, max(n, 0), BLOCK):
        b = min(a + BLOCK, n)
        first, last, gram, kind = _block_runs(raw[a : b + length - 1], length)
        parts.append((first + a, last + a, gram, kind))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in slices(batches):
        raw, starts = utf8(part)
        yield part, [raw[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]


def _list_runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches):
            keys, grams, kinds, counts = [], [], [], []
            for key, raw in zip(part.column("key").to_pylist(), texts, strict=True):
                _, _, gram, kind = runs(raw, length)
                if len(kind):
                    kind, at, n = np.unique(kind, return_index=True, return_counts=True)
                    keys.append(np.full(len(kind), key, np.int64))
                    grams.append(gram[at].view(np.int64))
                    kinds.append(kind.view(np.int64))
                    counts.append(n)
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).astype(np.int64)) for x in (keys, grams, kinds, counts)], ["key", "gram", "kind", "n"]
                )

    return run


def _merge(spans: np.ndarray) -> np.ndarray:
    """Union of half-open spans, touching ones joined."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    far = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > far[:-1])
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], far[np.append(at[1:], len(spans)) - 1]], axis=1)


def _cut_out(raw: np.ndarray, spans: np.ndarray, form: str):
    """(bytes, removed bytes, spans, what is left in the form asked for) of one text."""
    spans = _merge(spans)
    keep = np.ones(len(raw), bool)
    for a, b in spans:
        keep[a:b] = False
    left = raw[keep].tobytes()
    if form == "sha256":
        left = hashlib.sha256(left).hexdigest()
    elif form == "text":
        left = left.decode("utf-8", "ignore")
    return len(raw), int((~keep).sum()), len(spans), left


def _settle(length: int, form: str):
    """Finish the texts without open runs; of the others, list the spans known so far and the strings still open."""
    opened = pa.list_(pa.struct([("gram", pa.int64()), ("single", pa.bool_()), ("hot", pa.bool_()), ("first", pa.int64()), ("bytes", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches):
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": [], "text": [], "spans": [], "open": []}
            for raw, kinds, states in zip(texts, part.column("kinds"), part.column("states"), strict=True):
                first, last, gram, kind = runs(raw, length) if kinds.is_valid else (np.zeros(0, np.int64),) * 4
                state = np.zeros(len(kind), np.int64)
                if kinds.is_valid and len(kind):
                    known, value = kinds.values.to_numpy(), states.values.to_numpy()
                    order = np.argsort(known)
                    at = order[np.minimum(np.searchsorted(known, kind.view(np.int64), sorter=order), len(known) - 1)]
                    state = np.where(known[at] == kind.view(np.int64), value[at], 0)
                full = (state & 1) > 0
                spans = np.stack([first[full], last[full] + length], axis=1)
                ask = np.flatnonzero(state & 6)
                twice = np.zeros(len(ask), bool)
                if len(ask):  # a class is shown once per text
                    twice[np.unique(kind[ask], return_index=True)[1]] = True
                    ask = ask[twice]
                pending = bool((state & 2).any())
                n, gone, n_spans, left = _cut_out(raw, spans, form) if not pending else (len(raw), None, None, None)
                rows = [
                    {"gram": int(gram[k].view(np.int64)), "single": bool(state[k] & 2), "hot": bool(state[k] & 8), "first": int(first[k]), "bytes": raw[first[k] : last[k] + length].tobytes()}
                    for k in ask
                ]
                values = n, gone, n_spans, left, raw.tobytes() if pending else None, spans.ravel() if pending else None, rows or None
                for name, value in zip(out, values, strict=True):
                    out[name].append(value)
            kinds_of = [pa.int64()] * 3 + [ARROW[form], pa.binary(), pa.list_(pa.int64()), opened]
            columns = [pa.array(v, t) for v, t in zip(out.values(), kinds_of, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("others"), part.column("key"), *columns], ["doc_id", "others", "key", *out])

    return run


def _windows(rows: pa.RecordBatch | pa.Table, length: int):
    """Row, first byte in the text and rank of every window of the open strings."""
    raw = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), np.uint8)
    size = np.array([len(x) for x in rows.column("bytes").to_pylist()], np.int64)
    n = size - length + 1
    row = np.repeat(np.arange(len(size)), n)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(size) - size, n) + inner
    first = rows.column("first").to_numpy()[row] + inner
    return row, first, Ranks(raw)(at, at + length)


def _rank_in_task(length: int, most_rows: int = 4096):
    """Rows come sorted by anchor; as many whole anchors as make up ``most_rows`` are ranked together."""

    def repeated(rows: pa.Table) -> pa.RecordBatch:
        row, first, rank = _windows(rows, length)
        order = np.argsort(rank, kind="stable")
        same = rank[order][1:] == rank[order][:-1]
        twice = np.zeros(len(rank), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        hit = np.flatnonzero(twice & rows.column("single").to_numpy()[row])
        new = np.append(True, (np.diff(row[hit]) != 0) | (np.diff(first[hit]) != 1)) if len(hit) else np.zeros(0, bool)
        start, end = hit[new], hit[np.append(new[1:], True)] if len(hit) else hit
        keys = rows.column("key").to_numpy()[row[start]]
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(first[start]), pa.array(first[end] + length)], ["key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) < most_rows:
                continue
            rows = pa.Table.from_batches(held)
            gram = rows.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))  # the last anchor may go on
            if cut:
                yield repeated(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
        if held:
            yield repeated(pa.Table.from_batches(held))

    return run


def _rank_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "bytes", 1 << 18):
            row, first, rank = _windows(part, length)
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(pa.array(row)), part.column("single").take(pa.array(row)), pa.array(first), pa.array(rank.view(np.int64))],
                ["key", "single", "a", "rank"],
            )

    return run


def _finish(form: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = []
            for text, spans, more in zip(part.column("text"), part.column("spans"), part.column("more"), strict=True):
                known = spans.values.to_numpy() if spans.is_valid else np.zeros(0, np.int64)
                extra = more.values.to_numpy() if more.is_valid else np.zeros(0, np.int64)
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                out.append(_cut_out(raw, np.concatenate([known, extra]).reshape(-1, 2), form))
            if out:
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [ARROW[form]], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("others"), *columns], ["doc_id", "others", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, form: str = "bytes", group: int = GROUP
) -> DataFrame:
    """One row per input row: ``doc_id, others, n_bytes, n_removed, n_spans, kept``.

    Every byte that a string of ``length`` bytes covers which also starts anywhere else in the input goes; overlaps
    count, and matches stay inside a text. ``kept`` is what is left of the UTF-8 bytes (which may cut a character), or
    with ``form`` "sha256" their digest in lowercase hex, or with "text" the text without cut characters. ``others`` is
    a struct of the input's other columns. Null text is empty; texts under ``length`` bytes stay whole. Every row
    counts: repeated rows are each other's repeats, whatever their ids, null ones too. An empty table gives no rows.
    """
    if not GRAM < length <= ADDENDS // 2:
        raise ValueError(f"length must be over {GRAM} and at most {ADDENDS // 2}")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    others = F.struct(*rest) if rest and form != "sha256" else F.lit(None).cast("int")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), others.alias("others")
    )
    id_type, others_type = (rows.schema[c].dataType.simpleString() for c in ("doc_id", "others"))
    keyed = rows.select("doc_id", "text", "others", F.xxhash64("doc_id", "text").alias("key"))
    listed = keyed.select("key", "text").mapInArrow(_list_runs(length), "key bigint, gram bigint, kind bigint, n bigint")
    # Classes lie with their anchor, so its figures need no further move.
    classes = (
        listed.select("gram", "kind", "n", "key")
        .repartition("gram")
        .groupBy("gram", "kind")
        .agg(F.sum("n").alias("n"), F.min("key").alias("shown"))
    )
    anchor = Window.partitionBy("gram")
    figures = classes.select(
        "kind", "n", "shown", F.sum("n").over(anchor).alias("all"), F.min("n").over(anchor).alias("least"), F.count(F.lit(1)).over(anchor).alias("kinds")
    ).where("all > 1")
    is_open = (F.col("least") == 1) & (F.col("kinds") > 1)
    # Bits: 1 repeated throughout, 2 single and open, 4 shown to the open ones (by one text), 8 hot anchor
    state = (
        F.when(F.col("n") > 1, 1).otherwise(2).bitwiseOR(F.when(is_open & (F.col("n") > 1), 4).otherwise(0)).bitwiseOR(F.when(F.col("kinds") > group, 8).otherwise(0))
    )
    table = figures.select("kind", "shown", state.alias("state"))
    marked = listed.select("key", "kind").join(table, "kind")
    mine = F.when(F.col("key") == F.col("shown"), F.col("state")).otherwise(F.col("state").bitwiseAND(F.lit(11)))
    marks = marked.groupBy("key").agg(F.collect_list(F.struct("kind", mine.alias("state"))).alias("m"))
    marks = marks.select("key", F.col("m.kind").alias("kinds"), F.transform("m", lambda x: x["state"].cast("bigint")).alias("states"))
    kept = "binary" if form == "bytes" else "string"
    stage = cut_lineage(
        keyed.join(marks, "key", "left").mapInArrow(
            _settle(length, form),
            f"doc_id {id_type}, others {others_type}, key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept {kept}, text binary, spans array<bigint>, "
            "open array<struct<gram: bigint, single: boolean, hot: boolean, first: bigint, bytes: binary>>",
        ),
        "op5-settled",
    )
    strings = stage.where("open IS NOT NULL").select("key", F.explode("open").alias("o")).select("key", "o.*")
    cool = strings.where("NOT hot").drop("hot").repartition("gram").sortWithinPartitions("gram")
    spans = cool.mapInArrow(_rank_in_task(length), "key bigint, a bigint, b bigint")
    hot = strings.where("hot").mapInArrow(_rank_rows(length), "key bigint, single boolean, a bigint, rank bigint")
    twice = hot.groupBy("rank").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("rank")
    more = hot.where("single").join(twice, "rank").select("key", "a", (F.col("a") + length).alias("b"))
    found = spans.unionByName(more).groupBy("key").agg(F.flatten(F.collect_list(F.array("a", "b"))).alias("more"))
    late = stage.where("text IS NOT NULL").select("doc_id", "others", "key", "text", "spans").join(found, "key", "left")
    names = ["doc_id", "others", "n_bytes", "n_removed", "n_spans", "kept"]
    rest = late.mapInArrow(_finish(form), f"doc_id {id_type}, others {others_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept {kept}")
    return stage.where("text IS NULL").select(*names).unionByName(rest)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", **options) -> DataFrame:
    """``docs`` with the repeated strings taken out of their texts, and the number of characters counted again."""
    out = remove_repeats(docs, id_col, text_col, form="text", **options)
    new = {id_col: F.col("doc_id"), text_col: F.col("kept"), chars_col: F.char_length("kept").cast(docs.schema[chars_col].dataType) if chars_col in docs.columns else None}
    return out.select(*[new.get(c, F.col("others").getField(c)).alias(c) for c in docs.columns])
