"""Personal data by fixed shapes and by bootstrapped contexts.

The fixed kinds (e-mail, IP, card and phone) are found first. They seed the lexical
patterns around them: the word before, the two words before, and the words on both
sides. A second pass counts every occurrence of those patterns in the corpus and lists the
identifier-like tokens that they extract. Spark then scores the pattern-instance graph: a
pattern's confidence is the score of all that it extracts over the number of its
occurrences, an instance's score is the chance that one of its patterns is right, and the
seeds stay at 1. Identifier-like tokens that confident patterns extract are added as kind
`context`.

Defined results: null text counts as empty; rows are independent of each other but for
the learned patterns, which are induced once, from the base kinds' seeds. Patterns and
instances that tie at a threshold both count. Very long texts are read whole; an empty
table gives no rows. Offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise
from .text import LOWER, Block, blocks, id_text, mix64, prefix_hash, span_hash

BASE = ("email", "ip", "card", "phone")
#: A pattern counts from so many different seeds on.
SUPPORT = 3
ROUNDS = 3
#: An instance is reported from this score on; patterns under CONFIDENT add nothing to it.
ACCEPT = 0.6
CONFIDENT = 0.5
SLOTS = 1 << 20

# The shapes of the contract, read so that long runs cost linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9.]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_LONG_DIGIT = re.compile(rb"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                last = m.end()
        at = text.find("@", max(at + 1, last))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers: each chain of numbers with single dots is read in fours."""
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        chain: list[tuple[int, int]] = []
        for m in re.finditer(r"[0-9]+", run[0]):
            if chain and m.start() != chain[-1][1] + 1:
                chain = []
            chain.append(m.span())
            if len(chain) == 4:
                parts = [run[0][a:b].lstrip("0") for a, b in chain]
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                    yield run.start() + chain[0][0], run.start() + chain[3][1]
                chain = []


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by kind as listed, then start."""
    if not _ANY.search(text):
        return []
    out = [(s, e, "email") for s, e in emails(text)]
    out += [(s, e, "ip") for s, e in addresses(text)]
    for m in _CARD.finditer(text):
        if 16 <= len(m[0]) and 16 <= len(digits := re.sub(r"[ -]", "", m[0])) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((*m.span(), "phone"))
    return out


def _tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, end, first, lower-case hash, and whether a token looks like an identifier."""
    low = LOWER[block.data]
    start, end, first = block.words()
    h = span_hash(prefix_hash(low), start, end)
    digit = np.concatenate([[0], np.cumsum(((block.data >= 48) & (block.data <= 57)) | (block.data == 64))])
    return start, end, first, h, (digit[end] > digit[start]) & (end - start >= 4)


def _patterns(h: np.ndarray, first: np.ndarray, at: np.ndarray, doc: np.ndarray, stop: np.ndarray | None = None) -> np.ndarray:
    """Hashes (3, n) of the patterns round the tokens at; 0 where the text has too few words.

    stop: the first token after the instance, at + 1 unless an instance has several.
    """
    after = at + 1 if stop is None else stop
    with np.errstate(over="ignore"):
        pad = np.concatenate([h, np.zeros(2, np.uint64)])
        one = pad[at - 1]
        two = mix64(pad[at - 2] * np.uint64(3) + one)
        both = mix64(one * np.uint64(5) + pad[np.minimum(after, len(h))])
        one = mix64(one + np.uint64(1))
    has1, has2, right = at - first[doc] >= 1, at - first[doc] >= 2, after < first[doc + 1]
    return np.stack([np.where(has1, one, 0), np.where(has2, two, 0), np.where(has1 & right, both, 0)]).astype(np.uint64)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pattern, seed) of every base span."""
    for b in batches:
        for _, texts in blocks(b):
            block = None
            out_p, out_i = [], []
            for d, raw in enumerate(texts):
                if not _LONG_DIGIT.search(raw) or not (spans := base_spans(text := raw.decode())):
                    continue
                if block is None:
                    block = Block(texts)
                    start, end, first, h, _ = _tokens(block)
                for s, e, _ in spans:
                    a = int(block.start[d]) + len(text[:s].encode())
                    z = a + len(text[s:e].encode())
                    at = int(np.searchsorted(end, a, "right"))
                    stop = int(np.searchsorted(start, z, "left"))
                    for p in _patterns(h, first, np.array([at]), np.array([d]), np.array([stop]))[:, 0]:
                        if p:
                            out_p.append(p)
                            out_i.append(h[at:stop].sum(dtype=np.uint64))
            yield pa.RecordBatch.from_pydict({"pattern": pa.array(np.array(out_p, np.uint64).view(np.int64)), "seed": pa.array(np.array(out_i, np.uint64).view(np.int64))})


def _extract(slots: np.ndarray):
    """One row for each text: base spans, candidates that patterns extract; and the pattern counts of each task."""
    schema = {
        "kind": pa.int32(), "doc_id": pa.int64(), "base": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])),
        "found": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("instance", pa.int64()), ("seed", pa.bool_()), ("pattern", pa.int64())])), "pattern": pa.int64(), "n": pa.int64(),
    }

    def counted(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        seen, at = np.unique(np.concatenate([s for s, _ in held]), return_inverse=True)
        return seen, np.bincount(at, np.concatenate([n for _, n in held]), minlength=len(seen)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the task's pattern counts, at most SLOTS and their namesakes
        for b in batches:
            ids = b.column("doc_id")
            for row, texts in blocks(b):
                block = Block(texts)
                start, end, first, h, like = _tokens(block)
                doc = np.repeat(np.arange(len(texts)), np.diff(first))
                p = _patterns(h, first, np.arange(len(h)), doc)
                hit = slots[(p & np.uint64(SLOTS - 1)).astype(np.int64)] & (p != 0)
                seen, count = np.unique(p[hit], return_counts=True)
                which, at = np.nonzero(hit & like[None, :])
                found: list[list] = [[] for _ in texts]
                base: list[list[tuple[int, int, str]]] = [base_spans(t.decode()) if _LONG_DIGIT.search(t) else [] for t in texts]
                before: dict[int, np.ndarray] = {}
                for w, t in zip(which.tolist(), at.tolist(), strict=True):
                    d = int(doc[t])
                    if d not in before:
                        before[d] = np.concatenate([[0], np.cumsum((np.frombuffer(texts[d], np.uint8) & 0xC0) != 0x80)])
                    s, e = int(before[d][start[t] - block.start[d]]), int(before[d][end[t] - block.start[d]])
                    seed = any(s < z and a < e for a, z, _ in base[d])
                    found[d].append({"start": s, "end": e, "instance": int(h[t : t + 1].view(np.int64)[0]), "seed": seed, "pattern": int(p[w, t : t + 1].view(np.int64)[0])})
                held.append((seen, count))
                if len(held) >= 64:
                    held = [counted(held)]
                n = len(texts)
                yield pa.RecordBatch.from_pydict({
                    "kind": pa.array(np.zeros(n, np.int32)), "doc_id": ids.slice(row, n), "base": pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in x] for x in base], schema["base"]),
                    "found": pa.array(found, schema["found"]), "pattern": pa.nulls(n, pa.int64()), "n": pa.nulls(n, pa.int64()),
                })
        if held:
            seen, count = counted(held)
            m = len(seen)
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array(np.ones(m, np.int32)), "doc_id": pa.nulls(m, pa.int64()), "base": pa.nulls(m, schema["base"]), "found": pa.nulls(m, schema["found"]),
                "pattern": pa.array(seen.view(np.int64)), "n": pa.array(count),
            })

    return run


def find_personal(docs: DataFrame, support: int = SUPPORT, rounds: int = ROUNDS, accept: float = ACCEPT) -> DataFrame:
    """doc_id, base: the fixed kinds' spans; added: spans found by learned contexts, (start, end) arrays."""
    rows = id_text(docs)
    seeds = rows.mapInArrow(_seeds, "pattern long, seed long")
    patterns = materialise(seeds.groupBy("pattern", "seed").count().groupBy("pattern").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= support))
    # A bit for each of SLOTS hash slots (at most SLOTS rows reach the driver); exact joins on the hash follow.
    slots = np.zeros(SLOTS, bool)
    slots[[r.slot for r in patterns.select((F.col("pattern").bitwiseAND(F.lit(SLOTS - 1))).alias("slot")).distinct().collect()]] = True
    schema = "kind int, doc_id long, base array<struct<start: long, end: long, kind: string>>, found array<struct<start: long, end: long, instance: long, seed: boolean, pattern: long>>, pattern long, n long"
    read = materialise(rows.mapInArrow(_extract(slots), schema).withColumn("row", F.monotonically_increasing_id()))

    total = read.where("kind = 1").groupBy("pattern").agg(F.sum("n").alias("n")).join(patterns, "pattern")
    found = read.where("kind = 0 and size(found) > 0").select("row", F.inline("found"))
    edges = materialise(found.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("times"), F.sum(F.col("seed").cast("long")).alias("seeds")).join(total, "pattern"))
    score = edges.select("instance", (F.col("seeds") / F.col("times")).alias("score")).groupBy("instance").agg(F.max("score").alias("score"))
    for _ in range(rounds):
        confidence = edges.join(score, "instance").groupBy("pattern").agg((F.sum(F.col("times") * F.col("score")) / (F.first("n") + F.lit(1.0))).alias("confidence"))
        odds = edges.join(confidence, "pattern").withColumn("confidence", F.when(F.col("confidence") >= CONFIDENT, F.col("confidence")).otherwise(0.0))
        missed = F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))))
        score = materialise(odds.groupBy("instance").agg(F.greatest(F.max(F.col("seeds") / F.col("times")), 1 - missed).alias("score")))
    good = confidence.where(F.col("confidence") >= CONFIDENT).select("pattern")
    added = found.where(~F.col("seed")).join(good, "pattern").join(score.where(F.col("score") >= accept), "instance")
    added = added.select("row", "start", "end").distinct().groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("added"))
    out = read.where("kind = 0").select("row", "doc_id", "base").join(added, "row", "left")
    return out.select("doc_id", "base", F.coalesce("added", F.array().cast("array<struct<start: long, end: long>>")).alias("added"))


def personal_digest(docs: DataFrame) -> DataFrame:
    """The operator's spans as counts, a hash of the base kinds' spans, and text."""
    found = find_personal(docs)
    base = F.array_join(F.transform("base", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    added = F.array_join(F.transform("added", lambda x: F.concat_ws(":", F.lit("context"), x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_join(F.filter(F.array(base, added), lambda x: x != ""), ",").alias("spans")
    return found.select("doc_id", *map(count, BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"), spans)
