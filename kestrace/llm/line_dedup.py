"""Fuzzy duplicates of lines by MinHash over character shingles.

A line's shingles are its runs of five characters, A-Z in lower case. Lines that agree on
all four minima of one of BANDS bands share a bucket: at a Jaccard similarity of 0.8 all
but 0.5 % of pairs do. Pairs of a bucket whose sketches resemble each other are candidates:
all of them in buckets of at most SMALL lines. In larger buckets each line is first a
candidate with one of a few leaders that it resembles; where the bucket then still holds
several classes, all its resembling lines of different classes are compared, in blocks. A
candidate pair stands when the exact Jaccard similarity of the two shingle sets is at
least 0.8. Classes are connected components, by distributed union-find; of each class the
first line, by document and place, stays.

Bucket keys are dealt in slices by their leading bits. A map task sends its lines of a slice
as one piece, so that rows are packed and sorted by numpy, not one by one by Spark.

Each map task pairs its own resembling lines of a large bucket with leaders, so a bucket
of near copies that holds a third of all lines costs its task a few rows a map task; the
others are dealt by line. Of a large bucket that no task reduced so, lines that resemble no
other line there are left out. Texts are read again only for candidates and the lines of large
buckets; those of large buckets are sent only where classes apart resemble each other.

Defined results: lines end at \\n; blank lines (white space alone) are no lines. A line of
fewer than five characters is one shingle; a very long line has all its shingles. Null text
has no lines. Lines are told apart by 64-bit hashes. Null ids come first. Lines that tie by
document and place are repeated rows: one of them stays. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Classes, across, asked_texts, components, dealt_units, each_unit, joined, units_apart
from .shared import forget, matching, materialise, slot_words
from .text import P_INV, P, blocks, id_text, mix64, power, seeds

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 10
ROWS = 4
#: Minima whose lowest two bits make a line's sketch, and how many of them candidates share.
#: At a similarity of 0.8 a sketch shares 27.2 of 32 on average, with a deviation of 2.
SKETCH = 32
SHARED = 20
#: Lines of a task whose minima are held before their bands are sent.
HELD = 100_000
#: Buckets of at most so many lines are compared at once.
SMALL = 12
#: Leaders of a larger bucket that a line is compared with at first.
LEADERS = 24
#: Lines of a larger bucket that are all compared by their sketches, to leave out those like no other.
WHOLE = 1024
#: Bytes of input for a slice, slices at least and at most, and slices of an input of unknown size: powers of 2.
SLICE_BYTES, LEAST_SLICES, MOST_SLICES, SOME_SLICES = 1 << 20, 1 << 6, 1 << 20, 1 << 12
#: Rows of a slice that a task holds before it reduces large buckets to leaders.
SLICE_ROWS = 4_000_000
#: Lines of a block of those still apart in a bucket.
BLOCK = 512
#: Labels of lines are broadcast up to this many (24 bytes each), else joined by a shuffle.
BROADCAST_LABELS = 500_000
#: Kinds of rows: lines of a bucket, leaders of a large one, those already sent as its members, members, and pairs.
LINE, LEAD, SENT, OTHER, PAIR = range(5)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_CODE = mix64(np.arange(1 << 14, dtype=np.uint64) + np.uint64(77))


class Lines:
    """The lines of some texts as code points: start, end, document, number in the text, and hash."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        code = np.frombuffer(joined.decode(errors="replace").encode("utf-32-le"), np.uint32)
        stop = np.flatnonzero(code == 10)
        begin = np.concatenate([[0], stop[:-1] + 1])
        breaks = np.array([t.count(b"\n") + 1 for t in texts])
        ink = code > 32
        ink |= (code < 9) | ((code > 13) & (code < 32))
        real = np.logical_or.reduceat(ink, begin)
        doc = np.repeat(np.arange(len(texts)), breaks)
        number = np.arange(len(stop)) - np.repeat(np.cumsum(breaks) - breaks, breaks)
        self.start, self.end, self.doc, self.number = begin[real], stop[real], doc[real], number[real]
        self.code = code + ((code - np.uint32(65)) < 26) * np.uint32(32)
        # One prefix sum gives the hash of any run of characters.
        self.total = np.zeros(len(code) + 1, np.uint64)
        value = _CODE[np.minimum(self.code, len(_CODE) - 1)]
        if (rare := np.flatnonzero(self.code >= len(_CODE) - 1)).size:
            value[rare] = mix64(self.code[rare].astype(np.uint64) + np.uint64(77))
        value *= power(P, len(code))
        np.cumsum(value, out=self.total[1:])
        self.inverse = power(P_INV, len(code) + 1)
        self.node = (mix64(self.run(self.start, self.end)) >> np.uint64(1)).astype(np.int64)

    def run(self, start, end) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.inverse[start]

    def minima(self, pick: np.ndarray) -> np.ndarray:
        """(BANDS * ROWS, picked lines) lowest hashes of the lines' shingles."""
        n = len(self.code)
        gram = np.zeros(n, np.uint64)
        if n > SHINGLE:
            np.subtract(self.total[SHINGLE:], self.total[:-SHINGLE], out=gram[: n - SHINGLE + 1])
            gram[: n - SHINGLE + 1] *= self.inverse[: n - SHINGLE + 1]
        start, end = self.start[pick], self.end[pick]
        short = end - start < SHINGLE
        gram[start[short]] = self.run(start[short], end[short])
        gram ^= gram >> np.uint64(29)
        gram *= np.uint64(0xBF58476D1CE4E5B9)
        half = (gram >> np.uint64(32)).astype(np.uint32)
        # Alternate ranges: shingles of a line, then what lies up to the next line.
        until = np.maximum(start + 1, end - SHINGLE + 1)
        cuts = np.stack([start, np.minimum(until, n)], 1).ravel()
        cuts[-1] = min(cuts[-1], n - 1)
        buffer, low = np.empty(n, np.uint32), np.empty((BANDS * ROWS, len(pick)), np.uint32)
        for out, f, m in zip(low, *(seeds(BANDS * ROWS, k).astype(np.uint32) | np.uint32(1) for k in (5, 6)), strict=True):
            np.bitwise_xor(half, f, out=buffer)
            np.multiply(buffer, m, out=buffer)
            out[:] = np.minimum.reduceat(buffer, cuts)[0::2]
        return low


def bands(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(BANDS, lines) bucket keys, and the lines' sketches, of the lines' minima."""
    keys = np.empty((BANDS, low.shape[1]), np.uint64)
    for b in range(BANDS):
        key = np.full(low.shape[1], b + 1, np.uint64)
        for r in range(ROWS):
            key = mix64(key * _MUL + low[b * ROWS + r])
        keys[b] = key
    sketch = np.zeros(low.shape[1], np.uint64)
    for x in low[:SKETCH]:
        sketch = sketch << np.uint64(2) | mix64(x.astype(np.uint64)) & np.uint64(3)
    return keys, sketch


_ODD = np.uint64(0x5555555555555555)


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of the sketches that differ."""
    x = a ^ b
    return np.bitwise_count((x | x >> np.uint64(1)) & _ODD)


def resemble(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return unlike(a, b) <= SKETCH - SHARED


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys."""
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    return cut[:-1], cut[1:]


def _star(node: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a bucket's leaders, and pairs of other lines with the first of LEADERS leaders that they resemble.

    Lines that resemble none of these lead, too.
    """
    rest, lead, a, b = np.arange(len(node)), [], [], []
    for _ in range(LEADERS):
        if not len(rest):
            break
        i, rest = rest[0], rest[1:]
        near = resemble(sketch[rest], sketch[i])
        a.append(node[rest[near]])
        b.append(np.full(int(near.sum()), node[i]))
        lead.append(i)
        rest = rest[~near]
    none = np.empty(0, node.dtype)
    return np.concatenate([np.array(lead, np.int64), rest]), np.concatenate([none, *a]), np.concatenate([none, *b])


def _rows(*parts: tuple[np.ndarray, np.ndarray, np.ndarray, int]) -> pa.RecordBatch:
    """bucket, node, sketch, kind; of a pair, bucket and node are its nodes."""
    kind = np.concatenate([np.full(len(p[0]), p[3], np.int32) for p in parts])
    bucket, node, sketch = (np.concatenate([p[i].view(np.int64) for p in parts]) for i in range(3))
    return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket), "node": pa.array(node), "sketch": pa.array(sketch), "kind": pa.array(kind)})


def _pair_rows(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]), np.zeros(len(both), np.int64), PAIR


def _close(key: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All resembling pairs inside the runs of equal keys, each of at most SMALL rows."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for d in range(1, SMALL):
        at = np.flatnonzero(key[d:] == key[:-d])
        if not len(at):
            break
        at = at[resemble(sketch[at], sketch[at + d]) & (node[at] != node[at + d])]
        a.append(node[at])
        b.append(node[at + d])
    return np.concatenate(a), np.concatenate(b)


#: Bytes of a packed row by kind: bucket (of LINE and LEAD without what the slice tells), node and sketch.
_KEY_BYTES, _ROW_BYTES = 6, {LINE: 22, LEAD: 22, OTHER: 24, PAIR: 16}


def slice_bits(docs: DataFrame) -> int:
    """Leading bits of a bucket key that make its slice, by the size that Spark knows of docs."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    slices = SOME_SLICES if size >= 1 << 62 else min(MOST_SLICES, max(LEAST_SLICES, size // SLICE_BYTES))
    return (slices - 1).bit_length()


def _packed(bucket: np.ndarray, node: np.ndarray, sketch: np.ndarray, kind: int, bits: int) -> pa.RecordBatch:
    """slice, kind, piece: rows of one kind, a piece for each slice. Members are dealt by node, pairs by their first one."""
    bucket, node, sketch = (np.ascontiguousarray(x).view(np.uint64) for x in (bucket, node, sketch))
    by = bucket if kind < OTHER else mix64(node if kind == OTHER else bucket)
    part = (by >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, wide = part[order], _ROW_BYTES[kind]
    key = _KEY_BYTES if kind < OTHER else 8
    out = np.empty((len(part), wide), np.uint8)
    out[:, :key] = bucket[order].view(np.uint8).reshape(-1, 8)[:, :key]
    out[:, key : key + 8] = node[order].view(np.uint8).reshape(-1, 8)
    if kind != PAIR:
        out[:, key + 8 :] = sketch[order].view(np.uint8).reshape(-1, 8)
    start, end = _runs(part) if len(part) else (np.empty(0, np.int64),) * 2
    offsets = pa.py_buffer((np.append(start, len(part)) * wide).astype(np.int32))
    piece = pa.Array.from_buffers(pa.binary(), len(start), [None, offsets, pa.py_buffer(out)])
    return pa.RecordBatch.from_pydict({"slice": pa.array(part[start]), "kind": pa.array(np.full(len(start), kind, np.int32)), "piece": piece})


def _unpacked(part: int, kind: int, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bucket, node, sketch, kind of a piece's rows."""
    rows = piece.reshape(-1, _ROW_BYTES[kind])
    key = _KEY_BYTES if kind < OTHER else 8
    column = lambda s: np.ascontiguousarray(rows[:, s : s + 8]).view(np.int64).ravel()
    bucket = np.zeros((len(rows), 8), np.uint8)
    bucket[:, :key] = rows[:, :key]
    bucket = bucket.view(np.int64).ravel()
    if kind < OTHER:
        bucket |= np.uint64((part & 0xFFFF) << 48).astype(np.int64)
    sketch = np.zeros(len(rows), np.int64) if kind == PAIR else column(key + 8)
    return bucket, column(key), sketch, np.full(len(rows), kind, np.int32)


def _buckets(bits: int):
    """A task's lines in all their buckets; of a bucket with many of them leaders, the others, and pairs."""
    # A bucket is known by its slice and its lowest bits from here on.
    known = np.uint64(0xFFFF_FFFF_FFFF)

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        node, once = np.unique(np.concatenate([x[0] for x in held]), return_index=True)
        keys, sketch = bands(np.concatenate([x[1] for x in held], 1)[:, once])
        held.clear()
        keys = keys.ravel()
        order = np.argsort(keys)
        key, line = keys[order], order % len(node)
        start, end = _runs(key)
        large = end - start > SMALL
        plain = np.repeat(~large, end - start)
        out: dict[int, list] = {k: [] for k in _ROW_BYTES}
        out[LINE].append((key[plain], node[line[plain]], sketch[line[plain]]))
        for s, e in zip(start[large].tolist(), end[large].tolist(), strict=True):
            who = np.sort(line[s:e])
            lead, a, b = _star(node[who], sketch[who])
            rest = np.setdiff1d(np.arange(e - s), lead)
            bucket = key[s] & known | (key[s] >> np.uint64(64 - bits) & np.uint64(0xFFFF)) << np.uint64(48)
            out[LEAD].append((np.full(len(lead), key[s]), node[who[lead]], sketch[who[lead]]))
            out[OTHER].append((np.full(len(rest), bucket), node[who[rest]], sketch[who[rest]]))
            out[PAIR].append(_pair_rows(a, b)[:3])
        for kind, some in out.items():
            if some:
                yield _packed(*(np.concatenate([np.ascontiguousarray(x[i]).view(np.int64) for x in some]) for i in range(3)), kind, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            for _, texts in blocks(b, limit=1 << 17):
                lines = Lines(texts)
                node, pick = np.unique(lines.node, return_index=True)
                if len(pick):
                    order = np.argsort(pick)
                    held.append((node[order], lines.minima(pick[order])))
            if sum(len(x[0]) for x in held) > HELD:
                yield from flush(held)
        yield from flush(held)

    return run


_Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _met(rows: _Rows, final: bool) -> tuple[list, _Rows]:
    """What the rows of a slice give, and, unless they are all, those to go on with: of large buckets some leaders."""
    order = np.argsort(rows[0])
    start, end = _runs(rows[0][order])
    several = np.repeat(end - start > 1, end - start)
    pick = order[several]
    # Lines that several tasks sent are one; a line sent as a leader stands for its kind.
    pick = pick[np.lexsort((-rows[3][pick], rows[1][pick], rows[0][pick]))]
    key, node = rows[0][pick], rows[1][pick]
    once = np.ones(len(pick), bool)
    once[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node, sketch, kind = (x[pick][once] for x in rows)
    if not len(key):
        return [], rows
    start, end = _runs(key)
    top = np.maximum.reduceat(kind, start)
    large = (end - start > SMALL) | (top > LINE)
    out, rest = [], []
    near = np.repeat(~large, end - start)
    if final:
        out.append(_pair_rows(*_close(key[near], node[near], sketch[near].view(np.uint64))))
    else:
        alone = order[~several]
        rest = [tuple(x[alone] for x in rows), (key[near], node[near], sketch[near], kind[near])]
    for i in np.flatnonzero(large).tolist():
        who = np.arange(start[i], end[i])
        if final and top[i] == LINE and len(who) <= WHOLE:
            who = who[resemble(sketch[who, None].view(np.uint64), sketch[None, who].view(np.uint64)).sum(1) > 1]
            if len(who) <= SMALL:
                out.append(_pair_rows(*_close(key[who], node[who], sketch[who].view(np.uint64))))
                continue
        lead, a, b = _star(node[who], sketch[who].view(np.uint64))
        new = who[kind[who] != SENT]
        out += [(key[new], node[new], sketch[new], OTHER), _pair_rows(a, b)]
        on = who[lead[:LEADERS]]
        rest.append((key[on], node[on], sketch[on], np.full(len(on), SENT, np.int32)))
    return out, rest if final else tuple(np.concatenate(x) for x in zip(*rest, strict=True))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces sorted by slice: pairs, and the lines of large buckets. A slice may go on in the next batch."""
    held, size, now = [], 0, None

    def done(final: bool) -> list:
        nonlocal held, size
        if not held:
            return []
        out, rest = _met(tuple(np.concatenate(x) for x in zip(*held, strict=True)), final)
        held = [] if final else [rest]
        # Rows of small buckets alone can't be reduced: then twice as many are held.
        size = 0 if final else max(0, len(rest[0]) - SLICE_ROWS // 2)
        return out

    for b in batches:
        out = []
        for part, kind, piece in zip(b.column("slice").to_pylist(), b.column("kind").to_pylist(), b.column("piece"), strict=True):
            rows = _unpacked(part, kind, np.frombuffer(piece.as_buffer(), np.uint8))
            if kind >= OTHER:
                out.append((*rows[:3], kind))
                continue
            if part != now:
                out += done(True)
                now = part
            held.append(rows)
            size += len(rows[0])
            if size > SLICE_ROWS:
                out += done(False)
        if out:
            yield _rows(*out)
    if out := done(True):
        yield _rows(*out)


def grams(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


_LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(line: str) -> set[str]:
    return grams(line.translate(_LOWER))


#: Bits of a sign: each batch numbers the signs that it has, from 1, and packs five numbers into one.
_BITS = 12


class Grams:
    """Distinct shingles of lower-cased lines as ascending numbers, which agree inside one batch of lines."""

    def __init__(self, lines: list[str]):
        size = np.fromiter(map(len, lines), np.int64, len(lines))
        self.lines, self.end = lines, np.cumsum(size)
        self.start = self.end - size
        code = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
        seen = np.zeros(int(code.max(initial=0)) + 1, bool)
        seen[code] = True
        self.known: dict[str, int] | None = None
        if np.count_nonzero(seen) >= 1 << _BITS:  # too many signs to pack
            self.known = {}
            return
        number = np.cumsum(seen)[code]
        self.packed = number.copy()
        for k in range(1, SHINGLE):
            self.packed[: len(code) - k] |= number[k:] << (_BITS * k)

    def of(self, i: int) -> np.ndarray:
        if self.known is not None:
            return np.array(sorted(self.known.setdefault(g, len(self.known)) for g in grams(self.lines[i])), np.int64)
        start, n = self.start[i], self.end[i] - self.start[i]
        if n < SHINGLE:  # one shingle, padded by nothing
            return self.packed[start : start + 1] & np.int64((1 << _BITS * int(n)) - 1)
        out = np.sort(self.packed[start : start + n - SHINGLE + 1])
        new = np.empty(len(out), bool)
        new[0] = True
        np.not_equal(out[1:], out[:-1], out=new[1:])
        return out[new]


def jaccard_reaches(one: np.ndarray, two: np.ndarray, least: float) -> bool:
    if min(len(one), len(two)) < least * max(len(one), len(two)) - 1e-9:
        return False
    merged = np.concatenate([one, two])
    merged.sort()
    both = np.count_nonzero(merged[1:] == merged[:-1])
    return both >= least * (len(merged) - both) - 1e-9


def _similar(least: float):
    """Pairs (a, b) that reach least. Each b's text comes first, with a null, then those of its a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = ""
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                text = part.column("text").to_pylist()
                shingles, ok, place, held = Grams([*text, other]), [], len(text), None
                for i, a in enumerate(part.column("a").to_pylist()):
                    if a is None:
                        place, held = i, None
                        ok.append(False)
                        continue
                    if held is None:
                        held = shingles.of(place)
                    ok.append(bool(jaccard_reaches(shingles.of(i), held, least)))
                if place < len(text):
                    other = text[place]
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _across(u: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a unit's rows that are to be compared and resemble each other, the most alike first."""
    sketch = u.column("sketch").to_numpy().view(np.uint64)
    differ = unlike(sketch[:, None], sketch[None, :])
    i, j = np.nonzero(across(u) & (differ <= SKETCH - SHARED))
    order = np.argsort(differ[i, j], kind="stable")
    return i[order], j[order]


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each unit that resemble one of another class there."""
    for u in each_unit(batches):
        i, j = _across(u)
        if len(i):
            yield u.take(pa.array(np.unique(np.concatenate([i, j]))))


def _meet(least: float):
    """Classes of each unit that resembling lines link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u in each_unit(batches):
            kind = u.column("class").to_pylist()
            text, held, classes = Grams(u.column("text").to_pylist()), {}, Classes()
            a, b = [], []
            i, j = _across(u)
            for m, n in zip(i.tolist(), j.tolist(), strict=True):
                if classes.find(kind[m]) == classes.find(kind[n]):
                    continue
                for k in (m, n):
                    if k not in held:
                        held[k] = text.of(k)
                if jaccard_reaches(held[m], held[n], least):
                    classes.join(kind[m], kind[n])
                    a.append(kind[m])
                    b.append(kind[n])
            if a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _in(words: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Which nodes the slots hold, as slot_words made them."""
    slot = node.view(np.uint64) & np.uint64(64 * len(words) - 1)
    return (words[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _read(words: np.ndarray, paired: np.ndarray):
    """Each line's place and node, and the lower-cased text of a block's distinct lines in the slots; ask: whether paired has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, texts in blocks(b, limit=1 << 18):
                lines = Lines(texts)
                want = _in(words, lines.node)
                some = np.flatnonzero(want)
                pick = some[np.unique(lines.node[some], return_index=True)[1]]
                text, code = np.full(len(want), None, object), lines.code.astype("<u4")
                for i in pick.tolist():
                    text[i] = code[lines.start[i] : lines.end[i]].tobytes().decode("utf-32-le")
                ids = b.column("doc_id").slice(row, len(texts)).take(pa.array(lines.doc))
                yield pa.RecordBatch.from_pydict({"doc_id": ids, "line_no": pa.array(lines.number.astype(np.int64)), "node": pa.array(lines.node), "text": pa.array(text, pa.string()), "ask": pa.array(_in(paired, lines.node))})

    return run


def line_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, line_no (from 0), keep_doc_id, keep_line_no, class_size, kept for each line that is not blank."""
    rows = id_text(docs)
    schema = "bucket long, node long, sketch long, kind int"
    sent = rows.select("text").mapInArrow(_buckets(slice_bits(docs)), "slice long, kind int, piece binary")
    dealt = sent.repartition("slice").sortWithinPartitions("slice")
    met = materialise(dealt.mapInArrow(_candidates, "bucket long, node long, sketch long, kind int"))
    pairs = materialise(met.where(F.col("kind") == PAIR).select(F.col("bucket").alias("a"), F.col("node").alias("b")).distinct())
    members = materialise(met.where(F.col("kind") == OTHER).select("bucket", "node", "sketch").distinct())
    forget(met)
    paired = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    wanted = slot_words(materialise(paired.unionByName(members.select("node")).distinct()))
    read = rows.mapInArrow(_read(wanted, slot_words(paired)), "doc_id long, line_no long, node long, text string, ask boolean")
    read = materialise(read.withColumn("row", F.monotonically_increasing_id()))
    # The shuffle that makes a line's texts one also brings them to the pairs that ask for them.
    lines = read.where("ask and text is not null").groupBy("node").agg(F.first("text").alias("text"))
    sent = materialise(lines.join(materialise(asked_texts(pairs)), "node")).select("a", "b", "copy", "text")
    sorted_ = sent.repartition("b", "copy").sortWithinPartitions("b", "copy", F.col("a").asc_nulls_first())
    edges = materialise(sorted_.mapInArrow(_similar(least), "a long, b long"))
    forget(sent)
    label = materialise(components(edges))
    # In a large bucket a line has met one leader only. Few of its lines are still apart from one that they resemble.
    apart = units_apart(members, label, BLOCK)
    met = materialise(apart.repartition("unit").sortWithinPartitions("unit").mapInArrow(_needed, apart.schema))
    texts = matching(read.where("text is not null").select("node", "text"), materialise(met.select("node").distinct()), "node")
    texts = texts.groupBy("node").agg(F.first("text").alias("text"))
    found = materialise(dealt_units(met, texts).mapInArrow(_meet(least), "a long, b long"))
    if found.limit(1).count():
        label = materialise(joined(label, found))

    few = F.broadcast(label) if label.count() <= BROADCAST_LABELS else label
    places = read.select("doc_id", "line_no", "row", "node").join(few, "node", "left")
    places = materialise(places.select("doc_id", "line_no", "row", F.coalesce("component", "node").alias("class")))
    forget(read)
    first = F.min(F.struct("doc_id", "line_no", "row")).alias("first")
    best = materialise(places.groupBy("class").agg(first, F.count(F.lit(1)).alias("class_size")).where("class_size > 1"))
    alone = F.col("first").isNull()
    of = lambda c: F.when(alone, F.col(c)).otherwise(F.col(f"first.{c}"))
    kept = alone | (F.col("first.row") == F.col("row"))
    return places.join(best, "class", "left").select("doc_id", "line_no", of("doc_id").alias("keep_doc_id"), of("line_no").alias("keep_line_no"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), kept.alias("kept"))
