"""Near duplicates by order MinHash.

A text's k-mers are its runs of five words, labelled by occurrence so that repeats count.
Each of several sketches takes the few k-mers with the smallest hashes and keeps them in
text order; texts that agree on a whole sketch are candidates. This follows edit
similarity: moved passages break the order that plain MinHash ignores.

A candidate pair is verified by banded alignment of the two k-mer sequences: with L
k-mers aligned in order, the similarity is L / (n + m - L), and the band is as wide as
that similarity allows, so no pair at or over the threshold is lost to it.

Equal texts are one node. Every node is paired with one member of its first buckets (a
star), which joins most of each group. In large buckets that still hold several classes,
nodes are then sorted by their further sketches, and neighbours of different classes paired.
Last, all nodes of different classes that share a bucket, and agree in at least AGREE
sketches, are compared: bucket by bucket, large ones in blocks, so that no pairs are written
out, and a pair in the first bucket that it shares alone. Classes are connected components
of the verified pairs.

Defined results: words are lower-cased for A-Z; a text of one to four words is one k-mer;
texts without words equal only identical texts; null text counts as empty. A very long text
has all its k-mers, and is compared whole. class_id is the smallest doc_id of the class
(null ids last), whose first row stays. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Classes, across, components, dealt_units, each_unit, joined, mixed_buckets, units_apart, with_texts
from .shared import keep_rows, matching, materialise
from .text import LOWER, Block, blocks, id_text, mix64, prefix_hash, seeds, shingles, span_hash

K = 5
SIMILARITY = 0.8
SKETCHES = 16
#: k-mers of a sketch.
LENGTH = 3
#: Bands of the first round.
FIRST_BANDS = 4
#: Sketches that two texts of different classes must share to be compared. At a similarity
#: of 0.8, where half of them agree on average, all but 0.15 % of pairs do.
AGREE = 3
#: Texts of a block of those still apart in a bucket: each is copied once for every so many others.
BLOCK = 512


def kmers(texts: list[bytes], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-mers in text order, and each text's first (n + 1)."""
    block = Block(texts)
    start, end, first = block.words()
    return shingles(span_hash(prefix_hash(LOWER[block.data]), start, end), first, k)


def labelled(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """k-mers told apart by their occurrence in their text."""
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    key = mix64(hashes + doc * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(key) else np.zeros(0, bool)
    if new.all():
        return hashes
    begin = np.flatnonzero(new)
    count = np.empty(len(key), np.uint64)
    count[order] = (np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))).astype(np.uint64)
    return np.where(count > 0, mix64(hashes + count * np.uint64(0xC2B2AE3D27D4EB4F)), hashes)


def sketches(texts: list[bytes], number: int = SKETCHES, length: int = LENGTH, k: int = K) -> np.ndarray:
    """(texts, number) keys; 0 for texts without words."""
    hashes, first = kmers(texts, k)
    lab = labelled(hashes, first)
    out = np.zeros((len(texts), number), np.uint64)
    count = np.diff(first)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    begin, size = first[:-1][full], count[full]
    last = np.uint64(0xFFFFFFFFFFFFFFFF)
    flip, mul = seeds(number, 101), seeds(number, 202)
    for i in range(number):
        v = (lab ^ flip[i]) * mul[i]
        at = np.full((length, len(full)), np.iinfo(np.int64).max)
        for r in range(length):
            low = np.minimum.reduceat(v, begin)
            hit = np.flatnonzero(v == np.repeat(low, size))
            doc = np.searchsorted(begin, hit, "right") - 1
            one = np.concatenate([[True], doc[1:] != doc[:-1]])
            hit, doc = hit[one], doc[one]
            at[r, doc] = np.where(r < size[doc], hit, np.iinfo(np.int64).max)
            v[hit] = last
        at.sort(axis=0)
        key = np.full(len(full), i + 1, np.uint64)
        for r in range(length):
            there = at[r] != np.iinfo(np.int64).max
            key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + np.where(there, lab[np.where(there, at[r], 0)], 0))
        out[full, i] = key
    return out


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """L / (n + m - L) of two k-mer sequences, exact where it is least or more, else 0.

    L is the longest common subsequence inside the band, by bit-parallel rows.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    need = int(np.ceil(least * (n + m) / (1 + least) - 1e-9))
    if min(n, m) < need:
        return 0.0
    # In any order first: what two sequences share bounds what they align.
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if int(np.minimum(ca[ia], cb[ib]).sum()) < need:
        return 0.0
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    tail = 0
    if head < short:
        differ = np.flatnonzero(a[::-1][: short - head] != b[::-1][: short - head])
        tail = int(differ[0]) if len(differ) else short - head
    common = head + tail
    left, top = a[head : n - tail].tolist(), b[head : m - tail].tolist()
    if left and top:
        places: dict[int, int] = {}
        for i, x in enumerate(left):
            places[x] = places.get(x, 0) | 1 << i
        over, under = n - need, m - need  # at most so many of a and of b stay out
        band = (1 << (over + under + 1)) - 1
        row = full = (1 << len(left)) - 1
        for j, x in enumerate(top):
            if match := places.get(x, 0):
                match &= band << (j - under) if j >= under else band >> (under - j)
                both = row & match
                row = ((row + both) | (row - both)) & full
        common += len(left) - row.bit_count()
    score = common / (n + m - common)
    return score if score >= least - 1e-9 else 0.0


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row, texts in blocks(b):
            keys = sketches(texts)
            flat = pa.array(keys.view(np.int64).ravel())
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * np.int32(keys.shape[1]))
            part = b.slice(row, len(texts))
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "key": part.column("key"), "some": pa.array(keys[:, 0] != 0), "bands": pa.ListArray.from_arrays(offsets, flat)})


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = b.column("a").to_numpy(), b.column("b").to_numpy()
            ta, tb = b.column("text_a"), b.column("text_b")
            cached: dict[int, np.ndarray] = {}
            ok = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                if c[i] not in cached:  # pairs of one representative stand together
                    cached = {c[i]: kmers([(tb[i].as_py() or "").encode()])[0]}
                ok[i] = aligned(kmers([(ta[i].as_py() or "").encode()])[0], cached[c[i]], least) > 0
            yield pa.RecordBatch.from_pydict({"a": pa.array(a[ok], pa.int64()), "b": pa.array(c[ok], pa.int64())})

    return run


def text_key(column):
    return F.unhex(F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256))


def _texts(rows: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes; copies of a text carry one key, and the first will do."""
    named = materialise(wanted.join(nodes.select("node", "key"), "node"))
    keyed = matching(rows.select(text_key(F.col("text")).alias("key"), "text"), materialise(named.select("key")), "key")
    once = keyed.groupBy("key").agg(F.first("text").alias("text"))
    return materialise(once.join(named, "key").select("node", "text"))


def _verified(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts align."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    return materialise(with_texts(pairs, _texts(rows, nodes, wanted)).mapInArrow(_verify(least), "a long, b long"))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket and further sketches: neighbours of one bucket and different classes."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        bucket, node, kind = (b.column(c).to_numpy() for c in ("bucket", "node", "class"))
        if last is not None:
            bucket, node, kind = (np.concatenate([[x], y]) for x, y in zip(last, (bucket, node, kind), strict=True))
        at = np.flatnonzero((bucket[1:] == bucket[:-1]) & (kind[1:] != kind[:-1]))
        yield pa.RecordBatch.from_pydict({"a": pa.array(np.maximum(node[at], node[at + 1])), "b": pa.array(np.minimum(node[at], node[at + 1]))})
        last = bucket[-1], node[-1], kind[-1]


def _agreeing(u: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a unit's rows to be compared: of different classes, with AGREE sketches in common, of which this bucket's is the first."""
    bands = u.column("bands").flatten().to_numpy().reshape(u.num_rows, -1)
    here = int(np.flatnonzero(bands[0] == u.column("bucket")[0].as_py())[0])
    apart = across(u)
    seen = np.zeros(apart.shape, np.int8)
    for k in range(bands.shape[1]):
        same = bands[:, k][:, None] == bands[:, k][None, :]
        if k < here:
            apart &= ~same
        else:
            seen += same
    i, j = np.nonzero(apart & (seen >= AGREE))
    order = np.argsort(-seen[i, j], kind="stable")
    return i[order], j[order]


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each unit that are to be compared with another one."""
    for u in each_unit(batches):
        i, j = _agreeing(u)
        if len(i):
            yield u.take(pa.array(np.unique(np.concatenate([i, j]))))


def _meet(least: float):
    """Classes of each unit that texts link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u in each_unit(batches):
            kind = u.column("class").to_pylist()
            held: dict[int, np.ndarray] = {}
            classes, a, b = Classes(), [], []
            i, j = _agreeing(u)
            for m, n in zip(i.tolist(), j.tolist(), strict=True):
                if classes.find(kind[m]) == classes.find(kind[n]):
                    continue
                for k in (m, n):
                    if k not in held:
                        held[k] = kmers([(u.column("text")[k].as_py() or "").encode()])[0]
                if aligned(held[m], held[n], least) > 0:
                    classes.join(kind[m], kind[n])
                    a.append(kind[m])
                    b.append(kind[n])
            if a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, text key, class_id, class_size, kept for each row of docs."""
    rows = id_text(docs)
    sketched = rows.withColumn("key", text_key(F.col("text"))).mapInArrow(_sketch, "doc_id long, key binary, some boolean, bands array<long>")
    read = materialise(sketched.withColumn("row", F.monotonically_increasing_id()))
    firsts = materialise(read.groupBy("key").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies")))
    nodes = read.where("some").join(firsts.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    nodes = materialise(nodes.select("node", "key", "bands"))
    names = nodes.select("node", "key")

    # The first bands join most of each group: every node with its lowest representative there.
    bands = nodes.select("node", F.explode(F.slice("bands", 1, FIRST_BANDS)).alias("bucket"))
    buckets = materialise(bands.groupBy("bucket").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "b"))
    star = materialise(bands.join(buckets, "bucket").groupBy("node").agg(F.min("b").alias("b")).where("node <> b").select(F.col("node").alias("a"), "b"))
    label = materialise(components(_verified(rows, names, star, least)))

    # A pair that agrees in AGREE sketches meets first in one of the others.
    members = nodes.select("node", F.posexplode(F.slice("bands", 1, SKETCHES - AGREE + 1)).alias("turn", "bucket"))
    known, mixed = mixed_buckets(members, label)
    mixed = materialise(mixed.select("bucket", "total"))
    large = mixed.where(F.col("total") > BLOCK).select("bucket")
    if large.limit(1).count():
        inside = known.join(large, "bucket").join(nodes.select("node", "bands"), "node")
        further = F.expr("concat(slice(bands, turn + 1, size(bands)), slice(bands, 1, turn))")
        inside = inside.select("bucket", "node", "class", further.alias("further"))
        beside = inside.repartitionByRange("bucket", "further").sortWithinPartitions("bucket", "further").mapInArrow(_neighbours, "a long, b long")
        pairs = materialise(beside.distinct().join(star, ["a", "b"], "left_anti"))
        closer = materialise(_verified(rows, names, pairs, least).join(label.select(F.col("node").alias("a"), F.col("component").alias("one")), "a", "left").join(label.select(F.col("node").alias("b"), F.col("component").alias("two")), "b", "left"))
        label = materialise(joined(label, closer.select(F.coalesce("one", "a").alias("a"), F.coalesce("two", "b").alias("b"))))

    # Then nodes of different classes in one bucket; those of one class so far stay so.
    members = known.join(mixed.select("bucket"), "bucket").select("bucket", "node")
    apart = units_apart(members, label, BLOCK, once=False).join(nodes.select("node", "bands"), "node")
    met = materialise(apart.repartition("unit").sortWithinPartitions("unit").mapInArrow(_needed, apart.schema))
    texts = _texts(rows, names, met.select("node").distinct())
    found = materialise(dealt_units(met, texts).mapInArrow(_meet(least), "a long, b long"))
    if found.limit(1).count():
        label = materialise(joined(label, found))

    of_key = materialise(firsts.join(label, "node", "left").select("key", F.coalesce("component", "node").alias("class")))
    named = materialise(read.select("doc_id", "row", "key").join(of_key, "key"))
    best = materialise(named.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("class_size")))
    return named.join(best, "class").select("doc_id", "key", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("best.row") == F.col("row")).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs, all its columns, with one row of each class."""
    return keep_rows(docs, near_classes(docs).select("doc_id", "key", "kept"), text_key)
