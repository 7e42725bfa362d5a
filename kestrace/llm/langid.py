"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time on windows of a
bounded sample of labelled documents. It gives every byte of every text a distribution
over the languages and one more label, no language, that it learns from the same windows
with their bytes shuffled and from windows of random signs. A document's probabilities pool
those of all its bytes (normalised geometric mean over the languages). The pipeline's stage
rejects a document whose bytes speak for no language by EVIDENCE more, summed, than for the
best language. Texts are read whole, as windows that run side by side.

Defined results: `und` with score 0 for a null text, one without a letter, or when there
is nothing to learn from; every other text gets a learned language. Where languages tie,
the first by name. Null ids count as the empty string for the split. Rows are independent:
repeats repeat, an empty table gives none. Only the LANGUAGES most frequent values of lang
are learned. A very long text is read as the many windows that it has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blocks, bounded_batches, per_document

WINDOW = 64
HIDDEN = 8
#: Labelled documents sampled for each language, and windows taken from each at most.
SAMPLE = 700
WINDOWS_A_DOC = 12
EPOCHS = 6
RATE = 0.02
LANES = 2048
#: Values of lang that are learned, the most frequent ones.
LANGUAGES = 64
#: Windows of no language for each window of a language.
CONTRAST = 0.3
#: Natural log units by which no language must lead for the stage to reject a text; a few bytes can't reach it.
EVIDENCE = 30.0


@dataclass
class Model:
    """embed: (2, 3H, 256); recur: (2, 3H, H); bias: (2, H); out: (K, 2H); shift: (K). Without contrast, K is the number of langs; else the last label is no language."""

    langs: list[str]
    embed: np.ndarray
    recur: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.recur, self.bias, self.out, self.shift]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def _direction(model: Model, d: int, windows: np.ndarray, keep: bool):
    """States (T, H, B) of one direction over windows (T, B); keep: also what backpropagation needs."""
    steps, lanes = windows.shape
    hid = model.bias.shape[1]
    h = np.zeros((hid, lanes), np.float32)
    states = np.empty((steps, hid, lanes), np.float32)
    held = []
    gate, x = np.empty((3 * hid, lanes), np.float32), np.empty((3 * hid, lanes), np.float32)
    for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
        np.take(model.embed[d], windows[t], axis=1, out=x, mode="clip")
        np.matmul(model.recur[d], h, out=gate)
        zr = _sigmoid(gate[: 2 * hid] + x[: 2 * hid])
        own = gate[2 * hid :] + model.bias[d][:, None]
        n = zr[hid:] * own
        n += x[2 * hid :]
        np.tanh(n, out=n)
        before = h
        h = states[t]
        np.subtract(before, n, out=h)
        h *= zr[:hid]
        h += n
        if keep:
            held.append((t, before, zr, n, own))
    return states, held


def log_probabilities(model: Model, windows: np.ndarray) -> np.ndarray:
    """(K, T, B): natural log of the language distribution at every byte of windows (T, B)."""
    hid, (steps, lanes) = model.bias.shape[1], windows.shape
    logits = np.empty((steps, len(model.out), lanes), np.float32)
    np.matmul(model.out[:, :hid], _direction(model, 0, windows, False)[0], out=logits)
    logits += np.matmul(model.out[:, hid:], _direction(model, 1, windows, False)[0])
    logits += model.shift[:, None]
    logits -= logits.max(1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(1, keepdims=True))
    return logits.transpose(1, 0, 2)


def gradients(model: Model, windows: np.ndarray, valid: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all valid positions of windows (T, B), and its gradients."""
    steps, lanes = windows.shape
    hid, k = model.bias.shape[1], len(model.out)
    both = [_direction(model, d, windows, True) for d in (0, 1)]
    logits = np.matmul(model.out[:, :hid], both[0][0]) + np.matmul(model.out[:, hid:], both[1][0]) + model.shift[:, None]
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(1, keepdims=True)
    share = (valid / max(1, valid.sum())).astype(np.float32)
    loss = -float((np.log(p[:, label, np.arange(lanes)] + 1e-9) * share).sum())
    delta = p
    delta[:, label, np.arange(lanes)] -= 1
    delta *= share[:, None, :]
    grads = [np.zeros_like(x) for x in model.parameters()]
    grads[4] += delta.sum((0, 2))
    for d in (0, 1):
        states, held = both[d]
        grads[3][:, d * hid : (d + 1) * hid] = np.einsum("tkb,thb->kh", delta, states, optimize=True)
        above = np.matmul(model.out[:, d * hid : (d + 1) * hid].T, delta)
        inward = np.empty((steps, 3 * hid, lanes), np.float32)
        dh = np.zeros((hid, lanes), np.float32)
        for t, before, zr, n, own in reversed(held):
            dh = dh + above[t]
            z, r = zr[:hid], zr[hid:]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (before - n) * z * (1 - z)
            dr = dn * own * r * (1 - r)
            inward[t] = np.concatenate([dz, dr, dn])
            gate = np.concatenate([dz, dr, dn * r])
            grads[1][d] += gate @ before.T
            grads[2][d] += gate[2 * hid :].sum(1)
            dh = dh * z + model.recur[d].T @ gate
        flat = windows.ravel()
        rows = inward.transpose(1, 0, 2).reshape(3 * hid, -1)
        for i in range(3 * hid):
            grads[0][d, i] = np.bincount(flat, rows[i], minlength=256)
    return loss, grads


def contrast(windows: np.ndarray, size: np.ndarray, share: float = CONTRAST, seed: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Windows of no language and their sizes: some of windows with their bytes in another order, half of them of random signs instead."""
    rng = np.random.default_rng(seed)
    pick = np.flatnonzero(size >= 16)
    pick = np.sort(rng.choice(pick, int(share * len(pick)), replace=False))
    out, n = windows[pick].copy(), size[pick]
    signs = np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/=_-", np.uint8)
    for i, k in enumerate(n.tolist()):
        out[i, :k] = rng.permutation(out[i, :k]) if i % 2 else signs[rng.integers(0, len(signs), k)]
    return out, n


def train(windows: np.ndarray, size: np.ndarray, label: np.ndarray, langs: list[str], hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """Adam on shuffled batches; windows (N, T) bytes, size: their valid bytes, label: index in langs, or len(langs) for no language."""
    labels = max(len(langs), int(label.max()) + 1)
    rng = np.random.default_rng(seed)
    normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    model = Model(langs, normal(0.3, 2, 3 * hidden, 256), normal(0.3, 2, 3 * hidden, hidden), np.zeros((2, hidden), np.float32), normal(0.2, labels, 2 * hidden), np.zeros(labels, np.float32))
    mean = [np.zeros_like(x) for x in model.parameters()]
    square = [np.zeros_like(x) for x in model.parameters()]
    seen = np.bincount(label, minlength=labels)
    weight = np.where(np.arange(labels) < len(langs), seen[: len(langs)].max() / np.maximum(1, seen), 1.0)
    step, batch, total = 0, 256, epochs * (-(-len(windows) // 256))
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            valid = (np.arange(windows.shape[1])[:, None] < size[pick][None, :]) * weight[label[pick]][None, :]
            _, grads = gradients(model, np.ascontiguousarray(windows[pick].T), valid, label[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for p, g, m, v in zip(model.parameters(), grads, mean, square, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def cut(text: bytes, window: int = WINDOW) -> np.ndarray:
    """text as rows of window bytes, the last filled with 0."""
    rows = max(1, -(-len(text) // window))
    out = np.zeros(rows * window, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(rows, window)


_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode(errors="replace")))


def pooled(model: Model, texts: list[bytes]) -> np.ndarray:
    """(texts, labels): the natural log of the labels' probabilities, summed over all bytes of each text, which has some."""
    rows = [cut(t) for t in texts]
    count = np.array([len(r) for r in rows])
    size = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), count)
    left = size[owner] - (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    windows = np.concatenate(rows)
    total = np.zeros((len(texts), len(model.out)))
    for at in range(0, len(windows), LANES):
        part = np.ascontiguousarray(windows[at : at + LANES].T)
        logp = log_probabilities(model, part)
        logp *= np.arange(WINDOW)[:, None] < left[at : at + LANES][None, :]
        for k, x in enumerate(logp.sum(1)):
            total[:, k] += np.bincount(owner[at : at + LANES], x, minlength=len(texts))
    return total


def classify(model: Model | None, texts: list[bytes]) -> tuple[list[str], list[float], list[float]]:
    """Language, its score, and by how much the bytes, summed, speak for no language instead (natural log)."""
    langs, scores, none = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    take = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
    if not take:
        return langs, scores, none
    total = pooled(model, [texts[i] for i in take])
    known = total[:, : len(model.langs)]
    mean = known / np.array([[len(texts[i])] for i in take])
    p = np.exp(mean - mean.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = known.argmax(1)
    for j, i in enumerate(take):
        langs[i], scores[i] = model.langs[best[j]], float(min(1.0, p[j, best[j]]))
        none[i] = float(total[j, -1] - known[j, best[j]]) if total.shape[1] > known.shape[1] else 0.0
    return langs, scores, none


def held_out(column: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves remainder; a null id counts as the empty string."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learns from documents that are not held out: about sample of each language, picked by a hash of the id."""
    known = bounded_batches(docs).where(~held_out(F.col("doc_id"), 3, 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # LANGUAGES rows come to the driver at most.
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return None
    # Drawn by a hash: about 1.0 x sample rows a language, whatever the table's size.
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample / n))]), F.col("lang"))
    drawn = known.where(F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(1 << 20)) < share * (1 << 20))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"lang": [], "bytes": [], "size": []}
            for i in range(b.num_rows):
                text = b.column("text")[i].as_py().encode()
                if not has_letter(text):
                    continue
                rows = cut(text)
                pick = np.unique(np.linspace(0, len(rows) - 1, WINDOWS_A_DOC).astype(int))
                for j in pick:
                    out["lang"].append(b.column("lang")[i].as_py())
                    out["bytes"].append(rows[j].tobytes())
                    out["size"].append(min(WINDOW, len(text) - int(j) * WINDOW))
            yield pa.RecordBatch.from_pydict({"lang": pa.array(out["lang"], pa.string()), "bytes": pa.array(out["bytes"], pa.binary()), "size": pa.array(out["size"], pa.int32())})

    got = drawn.mapInArrow(windows, "lang string, bytes binary, size int").orderBy("lang", "bytes").toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    if not langs:
        return None
    data = np.frombuffer(b"".join(got.column("bytes").to_pylist()), np.uint8).reshape(-1, WINDOW)
    label = np.searchsorted(np.array(langs), np.array(got.column("lang").to_pylist()))
    size = got.column("size").to_numpy()
    more, its = contrast(data, size)
    return train(np.concatenate([data, more]), np.concatenate([size, its]), np.concatenate([label, np.full(len(more), len(langs))]), langs)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; trains on docs unless a model is given."""
    model = model or fit(docs)

    def score(texts: list[bytes]) -> dict:
        langs, scores, _ = classify(model, texts)
        return {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}

    return per_document(docs, "lang_pred string, score double", score).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, evidence: float = EVIDENCE, model: Model | None = None) -> DataFrame:
    """docs, all columns, without the texts that have no language: null, without a letter, or by the network's labels.

    A text goes when its bytes, summed, speak for no language by evidence more than for the
    best language; short or mixed texts of known languages stay. Where there is nothing to
    learn from, every text with a letter stays. An empty table gives none.
    """
    model = model or fit(docs)
    columns = docs.columns
    ours = "text" if "text" in columns else next(c for c in columns if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in blocks(b, ours):
                _, _, none = classify(model, texts)
                ok = pa.array([has_letter(t) and x < evidence for t, x in zip(texts, none, strict=True)], pa.bool_())
                yield b.slice(first, len(texts)).filter(ok)

    return bounded_batches(docs).mapInArrow(run, docs.schema)
