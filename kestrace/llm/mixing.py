"""Mixing sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources that they belong to), and
those few sums are routed: pattern nodes offer their words, once at cost 0, again at cost
1, and so on (convex costs of repetition); source nodes want their targets. The flow says
how many words of each pattern's n-th copies a source gets. A seeded place on a line then
picks the documents: a histogram of the places, finer and finer around the point where the
words are reached, gives the threshold below which all are taken, and the next few
documents fill what is open. So no source is ever sorted or held in one task.

Defined results: a document's size is its number of words, null text has none, and a very
long text all it has; a document without any source belongs to the source null. Documents
of size 0 take 0. An empty table gives no rows. Repeated rows are separate documents, of
which any may be taken: their place also depends on their number in the table, and tells
only rows apart that are equal in id and text.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise
from .text import fresh

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
COPIES = 2
SEED = 17
#: A place is two numbers of LEVELS digits of DIGIT bits; the histogram takes a digit at a time.
DIGIT = 12
LEVELS = 5
#: Documents next on the line that are tried, in turn, for the words still open; a digit with more is split by the next one.
TRIED = 2000
#: Rows beyond the thresholds are broadcast up to this many, else joined by a shuffle.
BROADCAST_ROWS = 250_000
_SPACES = " \\x09-\\x0D"


def word_count(column):
    """Number of [^\\x20\\x09-\\x0D]+ in a text, null: 0."""
    text = F.coalesce(column, F.lit(""))
    # One sign a word: what stands before a word goes with it, and what follows the last one too.
    marks = F.regexp_replace(text, f"[{_SPACES}]*+[^{_SPACES}]++(?:[{_SPACES}]++\\z)?", "w")
    return F.when(text.rlike(f"[^{_SPACES}]"), F.length(marks)).otherwise(0).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = COPIES) -> dict[str | None, float]:
    """Words wanted of each source.

    Sources by code point, null last, weigh weights in turn and share share times all
    sizes; a target stops at most times its source's size, and what is over goes to the
    others by weight until none is above.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, total = dict(order), share * sum(n for _, n in order)
    out: dict[str | None, float] = {}
    free = set(size)
    while free:
        scale = (total - sum(out.values())) / sum(weight[s] for s in free)
        over = {s for s in free if scale * weight[s] > most * size[s]}
        if not over:
            return out | {s: scale * weight[s] for s in free}
        out |= {s: float(most * size[s]) for s in over}
        free -= over
    return out


def route(capacity: dict[tuple, float], want: dict, copies: int = COPIES) -> dict[tuple, float]:
    """Min-cost flow of words: (pattern, source, copy) -> words, by successive shortest paths.

    Each pattern offers its capacity copies times, the n-th time at cost n - 1 a word, so
    that the second copy of a document is used only where first copies cannot do.
    """
    nodes: dict = {}
    graph: list[list[list]] = []

    def node(key) -> int:
        if key not in nodes:
            nodes[key] = len(graph)
            graph.append([])
        return nodes[key]

    def edge(a: int, b: int, cap: float, cost: int) -> list:
        there, back = [b, cap, cost, len(graph[b])], [a, 0.0, -cost, len(graph[a])]
        graph[a].append(there)
        graph[b].append(back)
        return there

    begin, end = node("begin"), node("end")
    carried = {}
    for p, words in sorted(capacity.items(), key=lambda x: repr(x[0])):
        for c in range(copies):
            edge(begin, node(("copy", p, c)), float(words), c)
            for s in p:
                carried[p, s, c] = edge(node(("copy", p, c)), node(("source", s)), float("inf"), 0)
    for s, words in sorted(want.items(), key=lambda x: repr(x[0])):
        edge(node(("source", s)), end, float(words), 0)

    potential = [0] * len(graph)
    while True:
        far, via = [float("inf")] * len(graph), [None] * len(graph)
        far[begin], queue = 0, [(0, begin)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for e in graph[a]:
                if e[1] > 1e-6 and d + e[2] + potential[a] - potential[e[0]] < far[e[0]]:
                    far[e[0]] = d + e[2] + potential[a] - potential[e[0]]
                    via[e[0]] = (a, e)
                    heapq.heappush(queue, (far[e[0]], e[0]))
        if far[end] == float("inf"):
            break
        potential = [p + d if d < float("inf") else p for p, d in zip(potential, far, strict=True)]
        path, b = [], end
        while b != begin:
            path.append(via[b])
            b = via[b][0]
        flow = min(e[1] for _, e in path)
        for _, e in path:
            e[1] -= flow
            graph[e[0]][e[3]][1] += flow
    sent = {}
    for (p, s, c), e in carried.items():
        back = graph[e[0]][e[3]]
        if back[1] > 1e-6:
            sent[p, s, c] = back[1]
    return sent


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of one (pattern, copy) that are tried in the order of their places: those that fit what is open."""
    rows = rows.sort_values(["hi", "lo"])
    open_, took = float(rows["gap"].iloc[0]), []
    for size in rows["size"]:
        fits = size <= open_
        took.append(fits)
        open_ -= size if fits else 0
    if len(rows) and open_ > 0:  # one more where that comes nearer
        left = [(size, i) for i, (size, t) in enumerate(zip(rows["size"], took, strict=True)) if not t and 0 < size < 2 * open_]
        if left:
            took[min(left)[1]] = True
    return rows.assign(took=took)[["row", "took"]]


def placed(docs: DataFrame, members: str | None, seed: int, carry: list[str]) -> tuple[DataFrame, str]:
    """The columns carry of docs, written out with one more, whose name is also returned: a struct of key, pattern, size, hi, lo, row."""
    sources = F.array(F.col("source").cast("string")) if members is None else F.coalesce(F.col(members), F.array().cast("array<string>"))
    sources = F.when(F.size(sources) == 0, F.array(F.lit(None).cast("string"))).otherwise(F.array_sort(F.array_distinct(sources)))
    text, row, name = F.col("text").cast("string"), F.monotonically_increasing_id(), fresh(docs, "mixed")
    cut = lambda h: F.shiftrightunsigned(h, 64 - DIGIT * LEVELS)
    parts = [F.to_json(F.struct(sources.alias("p"))).alias("key"), sources.alias("pattern"), word_count(text).alias("size"), cut(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text)).alias("hi"), cut(F.xxhash64(F.lit(seed), row)).alias("lo"), row.alias("row")]
    return materialise(docs.select(*carry, F.struct(*parts).alias(name))), name


def _within(left: str, right: str):
    """Whether a row's place lies in a range of places (h0 to h1 and l0 to l1)."""
    return F.col(f"{left}.hi").between(F.col(f"{right}.h0"), F.col(f"{right}.h1")) & F.col(f"{left}.lo").between(F.col(f"{right}.l0"), F.col(f"{right}.l1"))


_RANGE = "key string, copy int, h0 long, h1 long, l0 long, l1 long"
_END = (1 << DIGIT * LEVELS) - 1


def thresholds(rows: DataFrame, part: list[tuple[str, int, float]]) -> tuple[dict[tuple[str, int], tuple[int, int]], list[tuple]]:
    """For each (key, copy, words): the place below which all rows are taken, and the range of rows to try with the words open.

    Each round reads the histogram of one digit around each place: 2 ** DIGIT rows for
    each reach the driver. Rounds end when few rows share all digits so far.
    """
    spark, below, tried = rows.sparkSession, {}, []
    asked = {(key, copy): (0, 0, words) for key, copy, words in part}
    for level in range(2 * LEVELS):
        if not asked:
            break
        first, shift = level < LEVELS, DIGIT * (LEVELS - 1 - level % LEVELS)
        wide = (1 << shift + DIGIT) - 1

        def spot(h: int, l: int, digit: int, until: int, first=first, shift=shift) -> tuple[int, int, int, int]:
            """The range of the digits digit to until."""
            return (h + (digit << shift), h + ((until + 1) << shift) - 1, 0, _END) if first else (h, h, l + (digit << shift), l + ((until + 1) << shift) - 1)

        ranges = spark.createDataFrame([(k, c, h, h + wide, 0, _END) if first else (k, c, h, h, l, l + wide) for (k, c), (h, l, _) in asked.items()], _RANGE)
        digit = F.shiftright(F.col("hi" if first else "lo"), shift).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int").alias("digit")
        found = rows.alias("r").join(F.broadcast(ranges).alias("x"), (F.col("r.key") == F.col("x.key")) & _within("r", "x"))
        bins: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
        for r in found.groupBy("x.key", "copy", digit).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect():
            bins.setdefault((r.key, r.copy), []).append((r.digit, int(r.words), int(r.n)))
        following = {}
        for (key, copy), (h, l, left) in asked.items():
            here = sorted(bins.get((key, copy), []))
            at = 0
            while at < len(here) and here[at][1] <= left:
                left -= here[at][1]
                at += 1
            if at == len(here):  # all of them
                below[key, copy] = (h + wide + 1, 0) if first else (h, l + wide + 1)
            elif here[at][2] > TRIED and level < 2 * LEVELS - 1:
                r = spot(h, l, here[at][0], here[at][0])
                following[key, copy] = (r[0], r[2], left)
            else:
                last, count = at, here[at][2]
                while last + 1 < len(here) and count + here[last + 1][2] <= TRIED:
                    last += 1
                    count += here[last][2]
                r = spot(h, l, here[at][0], here[last][0])
                below[key, copy] = (r[0], r[2])
                tried.append((key, copy, *r, left))
        asked = following
    return below, tried


def _planned(rows: DataFrame, weights: tuple[float, ...], share: float, copies: int) -> tuple[DataFrame, DataFrame | None]:
    """Facts of each pattern (key_, target, source_size, full, cuts), and rows taken beyond the cuts (row_, more)."""
    spark = rows.sparkSession
    # What the driver gets is one row for each pattern; patterns are few (sources, and overlaps that occur).
    found = rows.groupBy("key").agg(F.first("pattern").alias("pattern"), F.sum("size").alias("words")).collect()
    sums = {r.key: (tuple(r.pattern), int(r.words)) for r in found}
    by_source: dict[str | None, int] = {}
    for p, words in sums.values():
        for s in p:
            by_source[s] = by_source.get(s, 0) + words
    want = targets(list(by_source.items()), weights, share, copies)
    sent: dict[tuple, float] = {}
    for (p, _, c), words in route({p: w for p, w in sums.values() if w}, want, copies).items():
        sent[p, c] = sent.get((p, c), 0.0) + words
    flows = [(key, c, min(sent.get((p, c), 0.0), w), float(w)) for key, (p, w) in sums.items() for c in range(copies) if w]
    whole = [key for key, _, words, w in flows if words >= w - 0.5]
    part = [(key, c, words) for key, c, words, w in flows if 0.5 <= words < w - 0.5]
    below, tried = thresholds(rows.where("size > 0"), part)
    facts = spark.createDataFrame(
        [(key, float(want[p[0]]), by_source[p[0]], whole.count(key), [below[k] for k in below if k[0] == key]) for key, (p, _) in sums.items()],
        "key_ string, target double, source_size long, full int, cuts array<struct<h: long, l: long>>",
    )
    if not tried:
        return facts, None
    near = rows.where("size > 0").alias("r").join(F.broadcast(spark.createDataFrame(tried, f"{_RANGE}, gap double")).alias("x"), (F.col("r.key") == F.col("x.key")) & _within("r", "x"))
    near = near.select("row", "hi", "lo", "size", "gap", "copy", "r.key")
    fit = near.groupBy("key", "copy").applyInPandas(_fill, "row long, took boolean").where("took")
    return facts, materialise(fit.groupBy(F.col("row").alias("row_")).agg(F.count(F.lit(1)).cast("int").alias("more")))


def _mixed(docs: DataFrame, members: str | None, weights: tuple[float, ...], share: float, copies: int, seed: int, carry: list[str]) -> tuple[DataFrame, str]:
    """The columns carry of docs and a struct: pattern, size, source_size, target, repeats. Its name is also returned."""
    table, name = placed(docs, members, seed, carry)
    facts, more = _planned(table.select(f"{name}.*"), weights, share, copies)
    field = lambda x: F.col(f"{name}.{x}")
    out = table.join(F.broadcast(facts.select(F.struct("*").alias(f"{name}_fact"))), field("key") == F.col(f"{name}_fact.key_"))
    drawn = F.aggregate(f"{name}_fact.cuts", F.lit(0), lambda n, x: n + ((field("hi") < x["h"]) | ((field("hi") == x["h"]) & (field("lo") < x["l"]))).cast("int"))
    if more is not None:
        few = more.select(F.struct("*").alias(f"{name}_more"))
        out = out.join(F.broadcast(few) if more.count() <= BROADCAST_ROWS else few, field("row") == F.col(f"{name}_more.row_"), "left")
        drawn = drawn + F.coalesce(F.col(f"{name}_more.more"), F.lit(0))
    repeats = F.when(field("size") > 0, F.col(f"{name}_fact.full") + drawn).otherwise(0).cast("int")
    got = F.struct(field("pattern").alias("pattern"), field("size").alias("size"), F.col(f"{name}_fact.source_size").alias("source_size"), F.col(f"{name}_fact.target").alias("target"), repeats.alias("repeats"))
    return out.select(*carry, got.alias(name)), name


def mix(docs: DataFrame, members: str | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES, seed: int = SEED) -> DataFrame:
    """doc_id, pattern, size, source_size, target, repeats, taken for each row of docs.

    members: a column with an array of sources, else the column source alone. repeats is
    how often the mix uses the document. target and source_size are those of the first
    source in the pattern.
    """
    out, name = _mixed(docs, members, weights, share, copies, seed, ["doc_id"])
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), f"{name}.*").withColumn("taken", F.col("size") * F.col("repeats"))


def select_mix(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix uses, all columns, with repeats and taken (words, repeats counted).

    Each row has its own repeats, also where ids repeat. Where docs has columns of these
    names, the added ones get an underscore.
    """
    out, name = _mixed(docs, None, WEIGHTS, SHARE, COPIES, SEED, docs.columns)
    repeats, size = F.col(f"{name}.repeats"), F.col(f"{name}.size")
    return out.where(repeats > 0).select(*docs.columns, repeats.alias(fresh(docs, "repeats")), (size * repeats).alias(fresh(docs, "taken")))
