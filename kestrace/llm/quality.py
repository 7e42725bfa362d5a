"""Quality grades by ordinal cumulative-link regression on hashed text.

The labels give a graded rating: 2 for good and harmless text, 1 when one of the two
fails, 0 when both do. One weight vector over hashed token features is shared by all
grades, with ordered thresholds: P(grade <= k) = sigmoid(threshold[k] - w . x). It gives
each document an expected grade and the probability of the top grade, which selects.

Features are the distinct runs of letters, digits or other signs, letters in lower case,
the first bytes of longer runs, and the shares of capital, digit and sign bytes in steps. The fit uses a bounded sample of
labelled documents; every whole text is scored.

Defined results: null text counts as empty. Labels with a null grade or id are left out;
without any usable label every document gets the middle grade's prior and is kept.
Of labels that repeat an id the worst counts. Very long texts are scored whole. Equal texts
tie in grade and probability; at SELECT exactly a document is kept. Repeated rows repeat; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, Block, blocks, mix64, per_document, prefix_hash, span_hash

DIMS = 1 << 18
GRADES = 3
#: Labelled documents that the fit uses at most, about.
SAMPLE = 8000
FIT_STEPS = 80
RIDGE = 1e-3
#: Rows that a feature must be in.
LEAST = 8
#: Chi-square that a feature must have against the grades.
SCREEN = 30.0
STEPS = 12
#: Longer runs also count by their first bytes, so that endings don't hide a word.
STEMS = (4, 6)
#: Documents are kept from this probability of the top grade on.
SELECT = 0.5

_CLASS = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 sign
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 0
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[48:58] = 2


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text, in one array, and each text's first (n + 1)."""
    block = Block(texts)
    kind = _CLASS[block.data]
    edge = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1], [True]]))
    start, end = edge[:-1], edge[1:]
    real = kind[start] != 0
    start, end = start[real], end[real]
    prefix = prefix_hash(LOWER[block.data])
    doc = np.searchsorted(block.end, start).astype(np.int64) * DIMS
    slot = lambda h, kind: (mix64(h + np.uint64(kind)) >> np.uint64(46)).astype(np.int64)
    keys = [doc + slot(span_hash(prefix, start, end), 1)]
    for size in STEMS:
        long = end - start > size
        keys.append(doc[long] + slot(span_hash(prefix, start[long], start[long] + size), 1 + size))
    # Shares of capitals among letters, of digits and of signs among all, in STEPS steps.
    upper = (block.data >= 65) & (block.data <= 90)
    add = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[np.stack([block.start, block.end])], axis=0)[0]
    letters, size = np.maximum(1, add(kind == 1)), np.maximum(1, block.end - block.start)
    at = np.arange(len(texts), dtype=np.int64) * DIMS
    shares = [np.sqrt(add(upper) / letters), np.sqrt(add(kind == 2) / size), np.sqrt(add(kind == 3) / size)]
    extra = [at + DIMS - 1 - i * (STEPS + 1) - (s * STEPS).astype(np.int64) for i, s in enumerate(shares)]
    key = np.unique(np.concatenate([*keys, *extra]))
    return key & (DIMS - 1), np.searchsorted(key, np.append(at, len(texts) * DIMS))


@dataclass
class Ordinal:
    """weights (DIMS) and ascending thresholds (grades - 1)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, z: np.ndarray) -> np.ndarray:
        """(n, grades - 1): the probability of a grade over k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -40, 40)))


def linear(weights: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(weights[at], dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def fit_ordinal(at: np.ndarray, first: np.ndarray, grade: np.ndarray, grades: int = GRADES, steps: int = FIT_STEPS, ridge: float = RIDGE, least: int = LEAST, screen: float = SCREEN) -> Ordinal:
    """Maximum likelihood with a ridge penalty, by L-BFGS; thresholds are a base and positive steps."""
    n = len(grade)
    share = np.clip(np.array([(grade <= k).mean() for k in range(grades - 1)]), 0.01, 0.99)
    base = np.log(share / (1 - share))
    used, place = np.unique(at, return_inverse=True)
    row = np.repeat(np.arange(n), np.diff(first))
    # Screened by chi-square against the grades: words of single documents say nothing, and would explain all.
    seen = np.bincount(place, minlength=len(used))
    prior = np.bincount(grade, minlength=grades) / n
    chi = sum((np.bincount(place, grade[row] == k, minlength=len(used)) - seen * q) ** 2 / np.maximum(seen * q, 1e-9) for k, q in enumerate(prior) if q)
    often = (seen >= least) & (chi >= screen)
    # Only their occurrences go on.
    some = often[place]
    first = np.concatenate([[0], np.cumsum(some)])[first]
    used, place, row = used[often], (np.cumsum(often) - 1)[place[some]], row[some]
    d, each = len(used), np.arange(n)

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, theta = x[:d], x[d:]
        cut = np.concatenate([theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))])
        z = linear(w, place, first)
        s = 1 / (1 + np.exp(np.clip(z[:, None] - cut[None, :], -40, 40)))  # P(grade <= k)
        full = np.concatenate([np.zeros((n, 1)), s, np.ones((n, 1))], 1)
        p = np.maximum(full[each, grade + 1] - full[each, grade], 1e-12)
        slope = np.concatenate([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))], 1)
        up, down = slope[each, grade + 1] / p, slope[each, grade] / p
        dcut = np.array([-up[grade == k].sum() + down[grade == k + 1].sum() for k in range(grades - 1)]) / n
        gw = np.bincount(place, ((up - down) / n)[row], minlength=d) + ridge * w
        gtheta = [dcut.sum(), *(dcut[k:].sum() * np.exp(theta[k]) for k in range(1, grades - 1))]
        return float(-np.log(p).mean() + ridge / 2 * (w @ w)), np.concatenate([gw, gtheta])

    x = np.concatenate([np.zeros(d), base[:1], np.log(np.maximum(np.diff(base), 0.05))])
    f, g = value(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, held = g.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (y @ s)
            q -= a * y
            held.append(a)
        if past:
            q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(held), strict=True):
            q += s * (a - (y @ q) / (y @ s))
        size = 1.0 if past else min(1.0, 1.0 / (np.abs(g).sum() + 1e-12))
        while True:
            moved = x - size * q
            f2, g2 = value(moved)
            if f2 <= f - 1e-4 * size * (g @ q) or size < 1e-10:
                break
            size /= 2
        step, turn = moved - x, g2 - g
        if step @ turn > 1e-14:
            past = [*past[-9:], (step, turn)]
        done = abs(f - f2) < 1e-8
        x, f, g = moved, f2, g2
        if done:
            break
    weights = np.zeros(DIMS, np.float32)
    weights[used] = x[:d]
    theta = x[d:]
    return Ordinal(weights, np.concatenate([theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal | None:
    """Fits on about sample labelled documents, drawn by a hash of the id and the text."""
    rated = labels.where("doc_id is not null and quality is not null and toxic is not null")
    rated = rated.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"), F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = rated.count()
    if not total:
        return None
    drawn = rated.where(F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(1 << 20)) < (1 << 20) * min(1.0, sample / total))
    grade = ((F.col("quality") > 0).cast("int") + (F.col("toxic") <= 0).cast("int")).alias("grade")
    few = F.broadcast(drawn.select(F.col("doc_id").alias("rated_id"), grade))  # about sample rows of 12 bytes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(few, F.col("doc_id") == F.col("rated_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, texts in blocks(b):
                at, first = features(texts)
                part = b.slice(row, len(texts))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "grade": part.column("grade"), "at": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(at.astype(np.int32)))})

    got = rows.select("doc_id", "text", "grade").mapInArrow(run, "doc_id long, grade int, at array<int>").orderBy("doc_id", F.xxhash64("at")).limit(2 * sample).toArrow()
    grades = got.column("grade").to_numpy()
    if not len(grades):
        return None
    lists = got.column("at").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size = np.array([len(x) for x in lists])
    return fit_ordinal(lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)]), grades)


def graded(docs: DataFrame, labels: DataFrame, model: Ordinal | None = None, select: float = SELECT) -> DataFrame:
    """doc_id, expected_grade, p_top, kept for each row."""
    model = model or fit(docs, labels)

    def score(texts: list[bytes]) -> dict:
        if model is None:
            above = np.full((len(texts), GRADES - 1), 0.5)
        else:
            above = model.above(linear(model.weights, *features(texts)))
        return {"expected_grade": pa.array(above.sum(1)), "p_top": pa.array(above[:, -1]), "kept": pa.array(above[:, -1] >= select)}

    return per_document(docs, "expected_grade double, p_top double, kept boolean", score)
