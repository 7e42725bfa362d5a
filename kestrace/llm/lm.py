"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Words are grouped in classes: each of the most frequent words is a class of its own, all
others share classes by their ending and length, and the end of a text is one more. The
log-bilinear network predicts the next class from the three words before it; inside a
class a word has its add-one share of the class's count, with one unseen word a class. The
next KNOWN most frequent words have vectors of their own besides, as context and in their
class, where a softmax shifts their shares by context and leaves the other words in
proportion. So the model's probabilities of all words, seen or not, sum to 1.

Counting, training and scoring all read every text whole. Each partition trains on all
its learning tokens from a common warm start and the parameters are averaged by tokens,
as a table. Frequent words' counts (a bounded number of hashes) are with every scorer;
all other words are looked up by a join, so no hot word meets in one task.

Defined results: null text counts as empty (one token, the end); null ids count as the
empty string for the split. With nothing to learn from, every count is 0. Words are told
apart by 64-bit hashes. An empty table gives no rows; repeats repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import held_out
from .shared import materialise
from .text import LOWER, Block, blocks, id_text, mix64, prefix_hash, span_hash

#: Words that are classes of their own, classes of the others; then one for the end.
FREQUENT = 96
SHAPES = 95
#: Words after these that have vectors of their own, at most: about 0.1 KB each with every task.
KNOWN = 4096
CONTEXT = 3
WIDTH = 16
NOISE = 32
BATCH = 4096
#: Tokens of a step of the shares inside classes, and parameters of a row.
INNER_BATCH = 16384
WIDE = 32
#: Tokens whose classes are scored at once, and whose shares inside them are: what fits the processor's caches, and few calls.
SCORED = 1024
INNER_SCORED = 65536
RATE = 0.1
#: Counts that every scorer holds at most, beside those of FREQUENT words: 16 bytes each.
HELD = 1 << 19
#: The warm start: about so many documents, of each so many tokens at most.
WARM_DOCS = 400
WARM_TOKENS = 2048


@dataclass
class Words:
    """What maps words to numbers: sorted hashes of the frequent words, and of the known ones with their class and share of it."""

    frequent: np.ndarray
    known: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    kind: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    share: np.ndarray = field(default_factory=lambda: np.empty(0))
    classes: int = field(init=False)

    def __post_init__(self):
        self.classes = len(self.frequent) + SHAPES + 1
        order = np.argsort(self.kind, kind="stable")  # numbers of known words ascend by class
        self.slot = np.empty(len(order), np.int64)
        self.slot[order] = np.arange(len(order))
        self.kind, self.share = self.kind[order], self.share[order]
        self.first = np.searchsorted(self.kind, np.arange(self.classes + 1))
        self.class_of = np.concatenate([np.arange(self.classes + 1), self.kind])
        self.rest = 1 - np.bincount(self.kind, self.share, minlength=self.classes)

    def of(self, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """The numbers of words: their class (the end is the last), or for known words those after one more."""
        n = len(self.frequent)
        out = n + shape.astype(np.int64)
        for hashes, number in ((self.frequent, np.arange(n)), (self.known, self.classes + 1 + self.slot)):
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                out = np.where(hashes[at] == h, number[at], out)
        return out


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape class of each word (lower-cased A-Z), and each text's first word (n + 1)."""
    block = Block(texts)
    low = LOWER[block.data]
    start, end, first = block.words()
    h = span_hash(prefix_hash(low), start, end)
    size = end - start
    tail = low[end - 1].astype(np.uint64) << np.uint64(8) | low[np.maximum(end - 2, start)]
    shape = mix64(tail * np.uint64(7) + (size > 3) + (size > 7) + np.uint64(1)) % np.uint64(SHAPES)
    return h, shape.astype(np.int64), first


@dataclass
class Bilinear:
    """source: (C + 1, D) of context classes, the last for places before the text; turn: (CONTEXT, D, D); target: (C, D); bias: (C).

    Of known words: own (K, D), added to their class as context; inner (K, D) and inside (K), their logits in it.
    """

    source: np.ndarray
    turn: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    own: np.ndarray
    inner: np.ndarray
    inside: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parameters()])

    def parameters(self) -> list[np.ndarray]:
        return [self.source, self.turn, self.target, self.bias, self.own, self.inner, self.inside]

    def contexts(self, kind: np.ndarray) -> np.ndarray:
        """The vectors of all numbers of words as context."""
        return np.concatenate([self.source, self.source[kind] + self.own]) if len(kind) else self.source

    @staticmethod
    def shaped(flat: np.ndarray, classes: int, known: int = 0) -> Bilinear:
        sizes = [(classes + 1, WIDTH), (CONTEXT, WIDTH, WIDTH), (classes, WIDTH), (classes,), (known, WIDTH), (known, WIDTH), (known,)]
        cut = np.cumsum([0, *[int(np.prod(s)) for s in sizes]])
        return Bilinear(*[flat[a:b].reshape(s).astype(np.float32).copy() for a, b, s in zip(cut, cut[1:], sizes, strict=False)])

    @staticmethod
    def start(unigram: np.ndarray, share: np.ndarray = np.empty(0)) -> Bilinear:
        rng = np.random.default_rng(9)
        classes = len(unigram)
        normal = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        turn = np.stack([np.eye(WIDTH, dtype=np.float32) / (i + 1) for i in range(CONTEXT)])
        return Bilinear(normal(classes + 1, WIDTH), turn, normal(classes, WIDTH), np.log(unigram).astype(np.float32), *np.zeros((2, len(share), WIDTH), np.float32), np.log(share).astype(np.float32))


def sequences(cls: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Target words with each text's end, their contexts (CONTEXT, tokens), and the texts' bounds."""
    n = len(first) - 1
    bounds = first + np.arange(n + 1)
    seq = np.empty(bounds[-1], np.int64)
    seq[bounds[1:] - 1] = end
    word = np.ones(len(seq), bool)
    word[bounds[1:] - 1] = False
    seq[word] = cls
    place = np.arange(len(seq)) - np.repeat(bounds[:-1], np.diff(bounds))
    ctx = np.stack([np.where(place >= i, seq[np.maximum(np.arange(len(seq)) - i, 0)], end + 1) for i in range(1, CONTEXT + 1)])
    return seq, ctx, bounds


def _sums(at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of at, ascending, and the sum of the rows of x with each."""
    order = np.argsort(at.astype(np.uint16) if at.max(initial=0) < 1 << 16 else at, kind="stable")
    sorted_ = at[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return sorted_[first], np.add.reduceat(x[order], first)


class Trainer:
    """Adagrad on the noise-contrastive loss of classes and on that of shares inside them, one batch after another."""

    def __init__(self, model: Bilinear, unigram: np.ndarray, seed: int, rate: float = RATE, words: Words | None = None):
        self.model, self.rate, self.words = model, rate, words
        self.kind = words.kind if words else np.empty(0, np.int64)
        self.noise = unigram.astype(np.float64)
        self.cumulated = np.cumsum(self.noise)
        self.log_noise = np.log(NOISE * unigram).astype(np.float32)
        self.square = [np.full_like(x, 0.1) for x in model.parameters()[:5]] + [np.ones_like(x) for x in model.parameters()[5:]]
        self.rng = np.random.default_rng(seed)
        self.seen = 0

    def predicted(self, ctx: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        table = self.model.contexts(self.kind)
        r = [table[c] for c in ctx]
        return r, sum(x @ m for x, m in zip(r, self.model.turn, strict=True))

    def step(self, target: np.ndarray, ctx: np.ndarray, loss: bool = True) -> float | None:
        """One batch; returns the mean loss if asked for it."""
        m, n = self.model, len(target)
        r, q = self.predicted(ctx)
        drawn = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE) * self.cumulated[-1]), len(self.noise) - 1)
        qt, qn = m.target[target], m.target[drawn]
        dp = np.einsum("nd,nd->n", q, qt) + m.bias[target] - self.log_noise[target]
        dn = q @ qn.T + m.bias[drawn] - self.log_noise[drawn]
        gp = -1 / (1 + np.exp(np.clip(dp, -30, 30)))
        gn = 1 / (1 + np.exp(np.clip(-dn, -30, 30)))
        mean = float(-np.log(1e-9 + 1 + gp).mean() - np.log(1e-9 + 1 - gn).sum(1).mean()) if loss else None
        gp, gn = gp / n, gn / n
        dq = gp[:, None] * qt + gn @ qn
        classes = len(m.bias)
        g_target, g_source = np.zeros_like(m.target), np.zeros_like(m.source)
        to, g = _sums(target, gp[:, None] * q)
        g_target[to] = g
        np.add.at(g_target, drawn, gn.T @ q)
        g_bias = np.bincount(target, gp, minlength=classes)
        np.add.at(g_bias, drawn, gn.sum(0))
        g_turn = np.stack([x.T @ dq for x in r])
        to, g = _sums(ctx.ravel(), np.concatenate([dq @ t.T for t in m.turn]))
        own = np.searchsorted(to, classes + 1)
        g_source[to[:own]], to, g_own = g[:own], to[own:] - classes - 1, g[own:]
        if len(to):
            kind, g = _sums(self.kind[to], g_own)
            g_source[kind] += g
        # Known words without a gradient stay as they are.
        for p, g, s, at in zip(m.parameters()[:5], (g_source, g_turn, g_target, g_bias, g_own), self.square, (..., ..., ..., ..., to), strict=False):
            g = g * np.float32(100.0)
            s[at] += g * g
            p[at] -= (self.rate * g / np.sqrt(s[at])).astype(np.float32)
        self.seen += n
        return mean

    def inner_step(self, target: np.ndarray, ctx: np.ndarray) -> None:
        """One batch of the shares inside classes; the contexts' vectors stay."""
        m, g_inner, g_inside = self.model, np.zeros_like(self.model.inner), np.zeros_like(self.model.inside)
        q = self.predicted(ctx)[1]
        for who, a, z, p, total, some, place in each_class(m, self.words, target, q):
            p /= total[:, None]
            p[some, place] -= 1
            g_inner[a:z], g_inside[a:z] = p.T @ q[who], p.sum(0)
        for x, g, s in zip((m.inner, m.inside), (g_inner, g_inside), self.square[5:], strict=True):
            s += g * g
            x -= self.rate * g / np.sqrt(s)

    def fit(self, target: np.ndarray, ctx: np.ndarray) -> None:
        classes = self.words.class_of[target] if self.words else target
        for at in range(0, len(target), BATCH):
            self.step(classes[at : at + BATCH], ctx[:, at : at + BATCH], loss=False)
        if len(self.kind):
            for at in range(0, len(target), INNER_BATCH):
                self.inner_step(target[at : at + INNER_BATCH], ctx[:, at : at + INNER_BATCH])


def each_class(model: Bilinear, words: Words, target: np.ndarray, q: np.ndarray):
    """For each class with known words: its tokens, its known words from a to z, their (tokens, words) weights, all weights' sum, and where tokens are known words."""
    cls = words.class_of[target]
    order = np.argsort(cls.astype(np.uint16), kind="stable")
    cut = np.searchsorted(cls[order], np.arange(words.classes + 1))
    for c in np.flatnonzero((np.diff(cut) > 0) & (np.diff(words.first) > 0)).tolist():
        who, a, z = order[cut[c] : cut[c + 1]], words.first[c], words.first[c + 1]
        weight = q[who] @ model.inner[a:z].T
        weight += model.inside[a:z]
        np.exp(np.minimum(weight, 30, out=weight), out=weight)
        place = target[who] - (words.classes + 1) - a
        some = np.flatnonzero(place >= 0)
        yield who, a, z, weight, weight.sum(1) + np.float32(words.rest[c]), some, place[some]


def inner_scores(model: Bilinear, words: Words, target: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """log10 of each known word's probability in its class; of other words, of the factor of their share."""
    out = np.zeros(len(target))
    if len(words.kind):
        source = model.contexts(words.kind)
        tables = [source @ t for t in model.turn]
        for at in range(0, len(target), INNER_SCORED):
            t = target[at : at + INNER_SCORED]
            q = sum(table[c] for table, c in zip(tables, ctx[:, at : at + INNER_SCORED], strict=True))
            for who, _, _, weight, total, some, place in each_class(model, words, t, q):
                out[at + who] = -np.log10(total)
                out[at + who[some]] += np.log10(np.maximum(weight[some, place], 1e-30))
    return out


def class_scores(model: Bilinear, target: np.ndarray, ctx: np.ndarray, kind: np.ndarray = np.empty(0, np.int64)) -> np.ndarray:
    """log10 of each target class's normalised probability."""
    out = np.empty(len(target))
    source = model.contexts(kind)
    tables = [source @ t for t in model.turn]
    side, ones = np.ascontiguousarray(model.target.T), np.ones(len(model.bias), np.float32)
    for at in range(0, len(target), SCORED):
        c, t = ctx[:, at : at + SCORED], target[at : at + SCORED]
        q = tables[0][c[0]]
        for table, x in zip(tables[1:], c[1:], strict=True):
            q += table[x]
        logits = q @ side
        logits += model.bias
        own = logits[np.arange(len(t)), t].astype(np.float64)
        if max(-logits.min(), logits.max()) < 60:  # no power overflows, nor do all vanish
            top = 0.0
        else:
            top = logits.max(1)
            logits -= top[:, None]
        np.exp(logits, out=logits)
        out[at : at + SCORED] = own - top - np.log(logits @ ones)
    return out / np.log(10)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, shape, n) of a partition, merged as far as a bounded buffer allows."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, shape, n = (np.concatenate(x) for x in zip(*held, strict=True))
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        return u, shape[first], np.bincount(inverse, n, minlength=len(u)).astype(np.int64)

    def rows() -> Iterator[pa.RecordBatch]:
        if held:
            u, shape, n = merged()
            yield pa.RecordBatch.from_pydict({"word": pa.array(u.view(np.int64)), "shape": pa.array(shape.astype(np.int32)), "n": pa.array(n)})
            held.clear()

    for b in batches:
        for _, texts in blocks(b):
            h, shape, _ = tokens(texts)
            if len(h):
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                held.append((u, shape[first], n))
            if sum(len(x[0]) for x in held) > 3_000_000:
                held[:] = [merged()]
                if len(held[0][0]) > 1_500_000:
                    yield from rows()
    yield from rows()


def _warm(words: Words, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, texts in blocks(b):
            h, shape, first = tokens(texts)
            cls = words.of(h, shape)
            yield pa.RecordBatch.from_pydict({"classes": pa.array([cls[a : min(z, a + WARM_TOKENS)] for a, z in zip(first, first[1:], strict=False)], pa.list_(pa.int64()))})


def _train(words: Words, begin: Bilinear, unigram: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trains on all texts of a partition; gives each parameter times the tokens seen, and these, WIDE in a row."""
    trainer = Trainer(Bilinear.shaped(begin.flat(), words.classes, len(words.known)), unigram, 7, RATE / 2, words)
    for b in batches:
        for _, texts in blocks(b):
            h, shape, first = tokens(texts)
            target, ctx, _ = sequences(words.of(h, shape), first, words.classes - 1)
            trainer.fit(target, ctx)
    if trainer.seen:
        flat = np.append(trainer.model.flat().astype(np.float64) * trainer.seen, trainer.seen)
        rows = np.append(flat, np.zeros(-len(flat) % WIDE)).reshape(-1, WIDE)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(rows), dtype=np.int32)), **{f"x{i}": pa.array(rows[:, i]) for i in range(WIDE)}})


def _score(words: Words, model: Bilinear, held: np.ndarray, log_count: np.ndarray, log_total: np.ndarray, log_end: float):
    """Everything of a text but its words that are not held: those are listed by hash."""
    own = len(words.frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, texts in blocks(b):
                h, shape, first = tokens(texts)
                number = words.of(h, shape)
                cls = words.class_of[number]
                target, ctx, bounds = sequences(number, first, words.classes - 1)
                total = lambda x, at: np.diff(np.concatenate([[0.0], np.cumsum(x)])[at])
                network = total(class_scores(model, words.class_of[target], ctx, words.kind) + inner_scores(model, words, target, ctx), bounds)
                u, inverse = np.unique(h, return_inverse=True)
                at = np.minimum(np.searchsorted(held, u), max(0, len(held) - 1))
                found = held[at] == u if len(held) else np.zeros(len(u), bool)
                known = found[inverse]
                seen = np.where(known, log_count[at][inverse] if len(held) else 0.0, 0.0)
                inside = np.where((cls >= own) & (number < words.classes), np.where(known, seen, 0.0) - log_total[np.maximum(cls - own, 0)], 0.0)
                rare = np.flatnonzero(~known)
                offsets = pa.array(np.searchsorted(rare, first).astype(np.int32))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column("doc_id").slice(row, len(texts)), "held_out": b.column("held_out").slice(row, len(texts)), "n_tokens": pa.array(np.diff(bounds)),
                    "known": pa.array(np.diff(np.concatenate([[0], np.cumsum(known)])[first])), "base": pa.array(total(seen, first) + log_end), "model": pa.array(network + total(inside, first)),
                    "rare": pa.ListArray.from_arrays(offsets, pa.array(h[rare].view(np.int64))),
                })

    return run


def count_level(n):
    """n cut down to its eight highest bits, so that all counts have a few thousand levels; a level is the lowest count in it."""
    bits = F.greatest(F.length(F.bin(n)) - 8, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", n, bits), bits)


def language_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    rows = id_text(docs).withColumn("held_out", held_out(F.col("doc_id"), 7, 2))
    learn = rows.where("not held_out").select("text")
    counts = materialise(learn.mapInArrow(_counts, "word long, shape int, n long").groupBy("word").agg(F.first("shape").alias("shape"), F.sum("n").alias("n")))
    train_docs = learn.count()
    totals = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    n_train, distinct = (totals[0] or 0) + train_docs, totals[1] + (train_docs > 0)

    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT + KNOWN).collect()
    top = [(np.int64(r.word).view(np.uint64), r.shape, r.n) for r in top]
    top, known = sorted(top[:FREQUENT]), sorted(top[FREQUENT:])
    size, kinds = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # SHAPES rows
        size[r.shape], kinds[r.shape] = r.n, r.v
    for _, shape, n in top:
        size[shape] -= n
        kinds[shape] -= 1
    kind = np.array([x[1] for x in known], np.int64)
    share = (np.array([x[2] for x in known], np.float64) + 1) / (size + kinds + 1)[kind]
    words = Words(np.array([x[0] for x in top], np.uint64), np.array([x[0] for x in known], np.uint64), len(top) + kind, share)
    unigram = np.concatenate([[x[2] for x in top], size, [train_docs]]) + 0.5
    unigram /= unigram.sum()

    # The counts that all scorers hold: from the lowest level on at which at most HELD words qualify.
    by_level = {r.level: r.v for r in counts.groupBy(count_level(F.col("n")).alias("level")).agg(F.count(F.lit(1)).alias("v")).collect()}
    least, sum_ = max(by_level, default=0) * 2 + 1, 0
    for level in sorted(by_level, reverse=True):
        sum_ += by_level[level]
        if sum_ > HELD:
            break
        least = level
    got = counts.where(F.col("n") >= least).select("word", "n").toArrow()
    # Words that are classes of their own or known are always held: their counts give no share of a class.
    held = np.concatenate([got.column("word").to_numpy().view(np.uint64), words.frequent, words.known])
    held, once = np.unique(held, return_index=True)
    log_count = np.log10(np.concatenate([got.column("n").to_numpy(), np.array([x[2] for x in top + known], np.int64)])[once] + 1.0)

    model = Bilinear.start(unigram, words.share)
    if train_docs:
        # Warm start on a bounded sample, then one pass over all learning texts.
        sample = learn.where(F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(1 << 20)) < (1 << 20) * min(1.0, WARM_DOCS / train_docs))
        drawn = sample.mapInArrow(lambda x: _warm(words, x), "classes array<long>").orderBy(F.xxhash64("classes"), "classes").limit(4 * WARM_DOCS).toArrow()
        if drawn.num_rows:
            listed = [np.asarray(x, np.int64) for x in drawn.column("classes").to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(x) for x in listed])])
            target, ctx, _ = sequences(np.concatenate(listed), first, words.classes - 1)
            trainer = Trainer(model, unigram, 3, words=words)
            for _ in range(3):
                trainer.fit(target, ctx)
        begin = model
        sums = learn.mapInArrow(lambda x: _train(words, begin, unigram, x), "at int, " + ", ".join(f"x{i} double" for i in range(WIDE)))
        sums = sums.groupBy("at").agg(*[F.sum(f"x{i}").alias(f"x{i}") for i in range(WIDE)]).orderBy("at").toArrow()
        if sums.num_rows:
            flat, n = np.stack([sums.column(f"x{i}").to_numpy() for i in range(WIDE)], 1).ravel(), len(model.flat())
            model = Bilinear.shaped(flat[:n] / flat[n], words.classes, len(words.known))

    log_total = np.log10(size + kinds + 1)
    log_end = float(np.log10(train_docs + 1.0))
    scored = rows.mapInArrow(_score(words, model, held, log_count, log_total, log_end), "doc_id long, held_out boolean, n_tokens long, known long, base double, model double, rare array<long>")
    scored = materialise(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode("rare").alias("word")).join(counts.where(F.col("n") < least).select("word", F.log10(F.col("n") + 1).alias("l")), "word")
    rare = rare.groupBy("row").agg(F.sum("l").alias("l"), F.count(F.lit(1)).alias("k"))
    out = scored.drop("rare").join(rare, "row", "left").fillna(0, ["l", "k"])
    types = F.lit(float(np.log10(n_train + 1.0 * (distinct + 1))))
    known = F.col("known") + F.col("k") + F.lit(int(train_docs > 0))
    return out.select(
        "doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("l") - F.col("n_tokens") * types).alias("base_score"), (F.col("model") + F.col("l")).alias("score"),
    )


