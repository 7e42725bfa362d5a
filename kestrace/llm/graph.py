"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, materialise


def _lowest(directed: DataFrame) -> DataFrame:
    """Each node's lowest neighbour or itself. Written out, so that a join with it can split a hub's edges."""
    return materialise(directed.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))


#: Nodes that a task joins before it sends what it found, and edges for each such task.
LOCAL = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a task's edges: each node with the lowest one that it reaches there."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[y]
        return x

    def found() -> pa.RecordBatch:
        some = [x for x in parent if parent[x] != x]
        root = [find(x) for x in some]
        parent.clear()
        return pa.RecordBatch.from_pydict({"u": pa.array(some, pa.int64()), "v": pa.array(root, pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > LOCAL:
            yield found()
    yield found()


def _stars(now: DataFrame) -> bool:
    """Whether every node points at one node that points nowhere."""
    ends = now.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(now.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    by = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not by.where("out > 1 or out + into > 1").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b); component is the lowest node.

    Distributed union-find with path compression: each task joins its own edges, LOCAL
    nodes at a time; then large-star and small-star steps alternate until every node points
    at its component's lowest, in a number of rounds logarithmic in the longest path left.
    Self-loops, repeats and nulls are ignored; an empty table gives no rows.
    """
    some = materialise(edges.where("a <> b").select("a", "b"))
    tasks = -(-some.count() // LOCAL)
    now = materialise(some.coalesce(max(1, tasks)).mapInArrow(_forest, "u long, v long").distinct())
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both)
        large = materialise(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low2 = _lowest(large)
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = materialise(small.unionByName(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        for x in (low, large, low2, now):
            forget(x)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (node, component) after links (a, b) between components, or nodes that are their own."""
    more = materialise(components(links))
    named = label.join(more.select(F.col("node").alias("component"), F.col("component").alias("into")), "component", "left")
    known = named.select("node", F.coalesce("into", "component").alias("component"))
    alone = more.join(label.select("node"), "node", "left_anti")
    return known.unionByName(alone)


#: Pairs of one representative that share a copy of its text.
PAIRS_A_COPY = 256


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) with text_a and text_b from texts (node, text), one row for each node.

    A node that many pairs name as b gets a copy for every PAIRS_A_COPY of them, so that
    no task receives all pairs of one representative.
    """
    load = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select("b", F.ceil(F.col("n") / PAIRS_A_COPY).cast("int").alias("copies"))
    load = materialise(load)
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).join(load, "b").select("b", "text_b", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).join(pairs.join(load, "b"), "a")
    left = left.withColumn("copy", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int")).drop("copies")
    return left.join(right, ["b", "copy"]).select("a", "b", "text_a", "text_b")


def asked_texts(pairs: DataFrame) -> DataFrame:
    """Rows (node, a, b, copy), each of which asks for node's text, so that one join by node serves both ends.

    A pair's end of more pairs is b. It is asked for once for every PAIRS_A_COPY of its
    pairs, with a null; a for each of its pairs. So no node asks for a copy for each of many
    pairs.
    """
    load = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n")))
    of = lambda c: load.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"))
    more = F.col("n_a") > F.col("n_b")
    ends = F.when(more, F.struct(F.col("b").alias("a"), F.col("a").alias("b"))).otherwise(F.struct("a", "b"))
    found = pairs.join(of("a"), "a").join(of("b"), "b").select(ends.alias("x"), F.ceil(F.greatest("n_a", "n_b") / PAIRS_A_COPY).alias("copies"))
    found = materialise(found.select("x.a", "x.b", F.pmod(F.xxhash64("x.a"), F.col("copies")).cast("int").alias("copy")))
    none = F.lit(None).cast("long")
    once = found.select("b", "copy").distinct().select(F.col("b").alias("node"), none.alias("a"), "b", "copy")
    return found.select(F.col("a").alias("node"), "a", "b", "copy").unionByName(once)


def mixed_buckets(members: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members with their class, and the buckets of more than one class: total, big and major (the largest class), print."""
    known = materialise(members.join(label, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component"))
    by = known.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(node))").alias("print"))
    sizes = by.groupBy("bucket").agg(F.sum("n").alias("total"), F.max("n").alias("big"), F.max_by("class", "n").alias("major"), F.count(F.lit(1)).alias("classes"), F.expr("bit_xor(print)").alias("print"))
    return known, sizes.where("classes > 1")


def units_apart(members: DataFrame, label: DataFrame, block: int, once: bool = True) -> DataFrame:
    """Rows (unit, node, class, whole, side, and members' other columns) in which nodes of different classes meet.

    members: distinct (bucket, node). Any two nodes of one bucket and different classes share
    a unit, where they are to be compared if whole or if their sides differ. Buckets of one
    class are left out; once: of buckets with the same nodes one is taken, and rows don't name it.
    A unit has about two blocks of nodes at most: those outside a bucket's largest class meet
    block by block, and that class only meets them, so it is copied once for each of their blocks.
    """
    known, mixed = mixed_buckets(members, label)
    same = mixed.groupBy("print", "total").agg(F.min(F.struct("bucket", "big", "major")).alias("x")).select("x.bucket", "total", "x.big", "x.major")
    some = materialise(same if once else mixed.select("bucket", "total", "big", "major"))
    one, major = F.col("total") <= block, F.col("class") == F.col("major")
    h, q, p = F.xxhash64(F.lit(block), "node"), F.col("q"), F.col("p")
    rows = known.join(some, "bucket").withColumn("q", F.when(one, 1).otherwise(F.ceil((F.col("total") - F.col("big")) / block)).cast("int"))
    rows = rows.withColumn("p", F.when(one, 0).otherwise(F.ceil(F.col("big") / block)).cast("int"))
    part = F.when(one, 0).when(major, q + F.pmod(h, F.greatest(p, F.lit(1)))).otherwise(F.pmod(h, q)).cast("int")
    rows = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(major & ~one, q - 1).otherwise(q + p - 1))))
    unit = F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other"))
    rows = rows.withColumn("unit", unit).withColumn("whole", F.col("part") == F.col("other")).withColumn("side", F.col("part") < F.col("other"))
    return rows.drop(*(["bucket"] if once else []), "total", "big", "major", "q", "p", "part", "other")


def dealt_units(units: DataFrame, texts: DataFrame) -> DataFrame:
    """units with the text of each node, those of a unit one after the other in one task."""
    return units.join(texts, "node").repartition("unit").sortWithinPartitions("unit")


def each_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one unit at a time."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        b = b if rest is None else pa.concat_batches([rest, b])
        key = b.column("unit").to_numpy()
        at = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]
        for s, e in zip(at, at[1:]):
            yield b.slice(s, e - s)
        rest = b.slice(at[-1])
    if rest is not None:
        yield rest


class Classes:
    """Classes of a unit, joined as links are found."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.parent.get(x, x)) != x:
            x = y
        return x

    def join(self, a: int, b: int) -> None:
        self.parent[self.find(a)] = self.find(b)


def across(unit: pa.RecordBatch) -> np.ndarray:
    """Which pairs (i, j) of a unit's rows are to be compared."""
    kind, side, whole = (unit.column(c).to_numpy(zero_copy_only=False) for c in ("class", "side", "whole"))
    apart = kind[:, None] != kind[None, :]
    return np.triu(apart, 1) if whole[0] else apart & side[:, None] & ~side[None, :]
