"""Near-duplicates by one-permutation MinHash, banded buckets and star-shaped candidate links.

A text is the set of its distinct shingles. Texts with equal sets are one class from the start. Each class has a
signature from one hash: the hash range is cut into bins, the smallest number of a bin is its value, and an empty bin
takes the value of the first full one in an order of its own (optimal densification). Bands of a few bins make buckets.
Inside a bucket every class is compared with one centre, not with every other; each band has another centre. Compared
pairs are confirmed on the full sets, and confirmed links give the components. The nodes of buckets that still hold more
than one component then go through an exact prefix-filter join, which leaves out pairs of one component only: no link
between two texts that share a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscribe.llm.frames import beside, pick, slices, utf8
from tallyscribe.llm.graph import components
from tallyscribe.llm.words import Words, mix, shingle_sets
from tallyscribe.sources.storage import cut_lineage

BANDS, ROWS = 32, 4
SHINGLE = 5
SIMILARITY = 80  # per cent

#: Counters by which shingles are ordered, rare ones first; shingles that share one only cost more comparisons.
COUNTERS = 1 << 20

#: Parts of one shingle's rows where they are told how many there are.
SALTS = 16

#: Rows that one copy of a centre's set serves in a join; a busier centre has several copies.
FAN = 256


class Signer:
    """Band keys of a set of 64-bit numbers."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows = bands, rows
        self.bins = bands * rows
        self.edges = np.array([(i << 64) // self.bins for i in range(self.bins)], np.uint64)
        seed = np.arange(self.bins, dtype=np.uint64)
        # Row i: the order in which bin i looks for a full one.
        self.order = np.argsort(mix(mix(seed[:, None] + np.uint64(1)) + seed[None, :] * np.uint64(0x9E3779B97F4A7C15)), axis=1)
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def keys(self, numbers: np.ndarray) -> np.ndarray:
        """``numbers`` sorted and not empty; one key per band."""
        at = np.searchsorted(numbers, self.edges)
        full = at < np.append(at[1:], len(numbers))
        value = numbers[np.minimum(at, len(numbers) - 1)]
        if not full.all():
            source = self.order[np.arange(self.bins), full[self.order].argmax(axis=1)]
            value = value[np.where(full, np.arange(self.bins), source)]
        key = self.salt.copy()
        for k in range(self.rows):
            key = mix(key * np.uint64(31) + value[k :: self.rows][: self.bands])
        return key


def _sets(rows: Iterator[pa.RecordBatch], shingle: int):
    for part in slices(rows, size=1 << 20):
        yield part, shingle_sets(Words(*utf8(part)), shingle)


def _set_code(numbers: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    if not len(numbers):
        return 0, 0
    one, two = mix(numbers + np.uint64(11)).sum(), mix(numbers ^ np.uint64(0x5555555555555555)).sum()
    return int(mix(one.reshape(1) + np.uint64(len(numbers))).view(np.int64)[0]), int(two.reshape(1).view(np.int64)[0])


def _sketch(shingle: int, bands: int, rows_of: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows_of)
        for part, sets in _sets(batches, shingle):
            codes = [_set_code(s) for s in sets]
            keys = [signer.keys(s).view(np.int64) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([c[0] for c in codes], pa.int64()), pa.array([c[1] for c in codes], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "code", "code2", "bands"],
            )

    return run


def _full_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, shingle):
            code = pa.array([_set_code(s)[0] for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), code, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "code", "members"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The stored ``pairs (a, b)`` whose full sets are similar enough. ``a`` may be in very many pairs: its set is copied per ``FAN``."""
    n = pairs.count()
    busy = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(FAN)).cast("int").alias("copies"))
    copies = (
        sets.select(F.col("node").alias("a"), F.col("members").alias("left"))
        .join(beside(busy, n), "a")
        .select("a", "left", "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    )
    dealt = pairs.join(beside(busy, n), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("copy"))
    with_b = sets.select(F.col("node").alias("b"), F.col("members").alias("right")).join(beside(dealt, n), "b")
    both = with_b.join(beside(copies.select("a", "copy", "left")), ["a", "copy"])
    same = F.size(F.array_intersect("left", "right"))
    return (
        both.select("a", "b", same.alias("same"), (F.size("left") + F.size("right") - same).alias("all"))
        .where(F.col("same") * 100 >= F.col("all") * similarity)
        .select("a", "b")
    )


def _star(members: DataFrame, similarity: int) -> DataFrame:
    """One centre per bucket, another in each bucket, paired with the others whose size allows a link."""
    order = F.struct(F.xxhash64("node", "bucket").alias("h"), "node", "n_shingles")
    centre = members.groupBy("bucket").agg(F.min(order).alias("c")).select("bucket", "c.node", "c.n_shingles").toDF("bucket", "a", "na")
    fits = (F.least("na", "n_shingles") * 100 >= F.greatest("na", "n_shingles") * similarity) & (F.col("a") != F.col("node"))
    return members.join(beside(centre), "bucket").where(fits).select("a", F.col("node").alias("b")).distinct()


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, with their component."""
    tagged = members.join(beside(labels), "node", "left").select("node", "n_shingles", "bucket", F.coalesce("component", "node").alias("comp"))
    several = tagged.groupBy("bucket").agg(F.min("comp").alias("one"), F.max("comp").alias("other")).where("one <> other")
    return tagged.join(beside(several.select("bucket")), "bucket", "left_semi")


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int64)
    for part in batches:
        total += np.bincount(part.column("members").flatten().to_numpy() & (COUNTERS - 1), minlength=COUNTERS)
    at = np.flatnonzero(total)
    for a in range(0, len(at), 100_000):
        some = at[a : a + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["counter", "n"])


def _prefixes(counts: np.ndarray, similarity: int):
    """The rarest shingles of each set, so many that two sets with a link share one of them; rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            members = part.column("members")
            flat, n = members.flatten().to_numpy(), np.diff(members.offsets.to_numpy())
            first = []
            for to, size in zip(np.cumsum(n), n, strict=True):
                own = flat[to - size : to]
                first.append(own[np.lexsort((own, counts[own & (COUNTERS - 1)]))[: size + (-size * similarity) // 100 + 1]])
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), part.column("comp"), pa.array(n, pa.int32()), pa.array(first, pa.list_(pa.int64()))], ["node", "comp", "n", "first"]
            )

    return run


def _rest_pairs(open_sets: DataFrame, similarity: int) -> DataFrame:
    """Every pair ``(a, b)`` of different components of ``open_sets (node, comp, members)`` that can have a link.

    Sets with a link share one of their prefixes, and the first shared shingle leaves enough of both behind it. The order
    is by how often a shingle's counter was hit: rare ones are first, and it is the same everywhere. Members of a hot
    shingle are dealt to blocks of about ``FAN``, and every two blocks meet.
    """
    rows = open_sets.select("members").mapInArrow(_bucket_counts, "counter bigint, n bigint")
    hits = rows.groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # at most COUNTERS rows
    counts = np.zeros(COUNTERS, np.int64)
    counts[hits.column("counter").to_numpy()] = hits.column("n").to_numpy()
    kinds = {f.name: f.dataType.simpleString() for f in open_sets.schema}
    first = open_sets.mapInArrow(_prefixes(counts, similarity), f"node {kinds['node']}, comp {kinds['comp']}, n int, first array<bigint>")
    first = cut_lineage(first.select("node", "comp", "n", F.posexplode("first").alias("place", "shingle")), "op1-prefixes")
    met = first.groupBy("shingle").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("one"), F.max("comp").alias("other")).where("one <> other")
    met = met.select("shingle", F.ceil(F.col("m") / F.lit(FAN)).cast("int").alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = first.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(beside(met), ["shingle", "salt"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = cut_lineage(dealt.select("shingle", "node", "comp", "n", "place", "block", "blocks"), "op1-dealt")
    low = dealt.select("shingle", *(F.col(c).alias(f"{c}1") for c in ("node", "comp", "n", "place")), F.col("block").alias("lo"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("hi"))
    high = dealt.select("shingle", *(F.col(c).alias(f"{c}2") for c in ("node", "comp", "n", "place")), F.explode(F.sequence(F.lit(0), "block")).alias("lo"), F.col("block").alias("hi"))
    enough = F.least(F.col("n1") - F.col("place1"), F.col("n2") - F.col("place2")) * (100 + similarity) >= (F.col("n1") + F.col("n2")) * similarity
    keys = [low[c] == high[c] for c in ("shingle", "lo", "hi")]
    once = (low["lo"] < low["hi"]) | (F.col("node1") < F.col("node2"))
    both = low.join(beside(high), [*keys, F.col("comp1") != F.col("comp2"), once, enough])
    return both.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after ``links`` between nodes of different components: only the components are linked anew."""
    ends = links
    for end in ("a", "b"):
        mine = labels.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        ends = ends.join(beside(mine), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    moved = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return labels.join(beside(to), "component", "left").select("node", F.coalesce("to", "component").alias("component")).unionByName(moved)


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    similarity: int = SIMILARITY,
    bands: int = BANDS,
    rows_of: int = ROWS,
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Texts with Jaccard similarity of at least ``similarity`` per cent are linked; ``component_id`` is the smallest id
    reachable, and the row that has it as its id is ``kept``. A pair at the threshold shares no bucket once in 20 million.
    Texts without a word (null, empty, blank) have no shingles and stay alone. Rows of one id and one text are the same node and share its fate; a null id is smaller
    than all others. An empty table gives no rows.
    """
    rows = pick(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    sketch = rows.mapInArrow(
        _sketch(shingle, bands, rows_of), f"doc_id {id_type}, n_shingles bigint, code bigint, code2 bigint, bands array<bigint>"
    )
    sketch = cut_lineage(sketch, "op1-sketch")
    # Classes of equal sets. A node is (smallest id of the class, code of its set), so ids that repeat can't clash.
    classes = (
        sketch.where("n_shingles > 0")
        .groupBy("code", "code2", "n_shingles")
        .agg(F.min(F.struct("doc_id", "bands")).alias("first"))
        .select("code", "code2", "n_shingles", F.struct(F.col("first.doc_id").alias("doc_id"), "code").alias("node"), F.col("first.bands").alias("bands"))
    )
    exploded = classes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("bucket")
    members = cut_lineage(exploded.join(beside(shared), "bucket", "left_semi"), "op1-buckets")
    n_members = members.count()
    nodes = members.select("node").distinct()
    key = F.struct(F.col("doc_id")).alias("key")
    ids = nodes.select(F.struct(F.col("node.doc_id").alias("doc_id")).alias("key")).distinct()
    wanted = rows.select(key, "doc_id", "text").join(beside(ids, n_members), "key", "left_semi").select("doc_id", "text")
    sets = (
        wanted.mapInArrow(_full_sets(shingle), f"doc_id {id_type}, code bigint, members array<bigint>")
        .select(F.struct("doc_id", "code").alias("node"), "members")
        .join(beside(nodes, n_members), "node", "left_semi")
        .dropDuplicates(["node"])
    )
    sets = cut_lineage(sets, "op1-sets")
    pairs = cut_lineage(_star(members, similarity), "op1-pairs")
    labels = components(_confirmed(pairs, sets, similarity))
    several = cut_lineage(_open(members, labels).select("node", "comp").distinct(), "op1-open")
    open_sets = cut_lineage(sets.join(beside(several, several.count()), "node").select("node", "comp", "members"), "op1-open-sets")
    rest = cut_lineage(_rest_pairs(open_sets, similarity), "op1-rest")
    links = cut_lineage(_confirmed(rest, sets, similarity), "op1-links")
    if not links.isEmpty():
        labels = cut_lineage(_merged(labels, links), "op1-labels")
    classes = classes.select("code", "code2", "n_shingles", "node").join(beside(labels), "node", "left")
    found = classes.select("code", "code2", "n_shingles", F.coalesce("component", "node")["doc_id"].alias("component_id"), F.lit(True).alias("_in"))
    out = sketch.select("doc_id", "n_shingles", "code", "code2").join(beside(found), ["code", "code2", "n_shingles"], "left")
    component = F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``near_dedup`` keeps, with all their columns; rows that share an id stay or go together."""
    kept = near_dedup(docs, id_col, text_col, **options).where("kept").select(F.struct("doc_id").alias("_key")).distinct()
    return docs.withColumn("_key", F.struct(F.col(f"`{id_col}`").alias("doc_id"))).join(beside(kept), "_key", "left_semi").drop("_key")
