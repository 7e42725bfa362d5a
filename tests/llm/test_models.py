"""Learned operators: gradients, normalisation, held-out accuracy, exact base scores."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kestrace.llm import langid as G
from kestrace.llm import lm as M
from kestrace.llm import quality as Q


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    syllables = {"aa": ["ka", "lo", "mi", "ter"], "bb": ["öx", "qu", "zé", "ny"], "cc": ["th", "ing", "ou", "er"]}
    out = []
    for i in range(n):
        lang = ["aa", "bb", "cc"][i % 3]
        out.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 120))).capitalize() + ".", lang))
    return out


def test_gradients_by_difference():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 256, (24, 16)).astype(np.uint8)
    model = G.train(w, np.full(24, 16), np.arange(24) % 3, ["a", "b", "c"], hidden=4, epochs=1)
    valid = np.ones((16, 24))
    _, grads = G.gradients(model, np.ascontiguousarray(w.T), valid, np.arange(24) % 3)
    for p, g in zip(model.parameters(), grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, loss = p[at], []
        for step in (0.01, -0.01):
            p[at] = old + step
            loss.append(G.gradients(model, np.ascontiguousarray(w.T), valid, np.arange(24) % 3)[0])
        p[at] = old
        assert abs((loss[0] - loss[1]) / 0.02 - g[at]) < 0.02 * abs(g[at]) + 1e-4


def test_language_held_out(make):
    rows = corpus()
    got = {r.doc_id: r for r in G.identify(make(*rows)).collect()}
    for i, _, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    held = [(i, lang) for i, _, lang in rows if got[i].held_out]
    assert np.mean([got[i].lang_pred == lang for i, lang in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_every_byte_counts_and_company_does_not(make):
    rows = corpus()
    model = G.fit(make(*rows))
    texts = [t.encode() for _, t, _ in rows[:20]]
    alone = [G.classify(model, [t])[1][0] for t in texts]
    assert np.allclose(alone, G.classify(model, texts)[1], atol=1e-4)
    joined = (texts[0] * 3) + texts[1] * 30
    assert G.classify(model, [joined])[0] == ["bb"]  # the long rest outweighs the start


def test_language_odd(make, odd, empty):
    got = G.identify(make(*corpus(60), (1000, None), (1001, "123 !?"), (1002, ""), (None, "kalo"))).collect()
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0 and by[None].lang_pred != "und"
    assert G.identify(empty).count() == 0 and G.identify(odd).count() == 12
    assert {r.lang_pred for r in G.identify(make((1, "text", None))).collect()} == {"und"}
    kept = G.keep_identified(odd)
    assert kept.columns == odd.columns and kept.where("text is null").count() == 0


def test_base_scores_are_exact(make):
    rows = [(i, t) for i, t, _ in corpus(90)] + [(500, None), (501, ""), (None, "Kalo unseenword")]
    got = M.language_scores(make(*rows)).collect()
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in low(t))
    n, v = sum(c.values()), len(c)
    text = dict(rows)
    for r in got:
        ws = low(text[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, held(r.doc_id))
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_class_probabilities_sum_to_one():
    unigram = np.full(20, 1 / 20)
    model = M.Bilinear.start(unigram)
    ctx = np.tile(np.array([[3], [7], [20]]), (1, 20))
    assert abs((10 ** M.class_scores(model, np.arange(20), ctx)).sum() - 1) < 1e-6


def test_noise_contrast_learns_an_order():
    rng = np.random.default_rng(2)
    target = np.zeros(20000, np.int64)
    for i in range(1, len(target)):
        target[i] = (target[i - 1] + 1) % 5 if rng.random() < 0.9 else rng.integers(5)
    ctx = np.stack([np.concatenate([np.full(k, 5), target[:-k]]) for k in (1, 2, 3)])
    unigram = np.bincount(target, minlength=5) / len(target)
    trainer = M.Trainer(M.Bilinear.start(unigram), unigram, 1)
    before = M.class_scores(trainer.model, target, ctx).mean()
    for _ in range(6):
        trainer.fit(target, ctx)
    assert M.class_scores(trainer.model, target, ctx).mean() > before + 0.2


def test_scores_odd(odd, empty):
    got = M.language_scores(odd).collect()
    assert len(got) == 12 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert M.language_scores(empty).count() == 0


def graded_rows(words, n=600):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        text, toxic, junk = [rng.choice(words) for _ in range(60)], i % 7 == 0, i % 11 == 0
        if toxic:
            text[rng.randrange(60)] = "grumbol" + rng.choice(["a", "e", "issimo"])
        rows.append((i, " ".join(w + "!!" if junk else w for w in text)))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_grades_held_out(spark, make, words):
    rows, labels = graded_rows(words)
    known = [x for x in labels if x[0] % 3] + [(1, None, 0), (None, 1, 1)]
    got = {r.doc_id: r for r in Q.graded(make(*rows), spark.createDataFrame(known, LABELS)).collect()}
    rest = [x for x in labels if x[0] % 3 == 0]
    assert np.mean([got[i].kept == bool(q and not t) for i, q, t in rest]) > 0.97
    assert all(0 <= r.expected_grade <= 2 for r in got.values())


def test_thresholds_rise():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 50, (400, 3))
    grade = np.clip((x < 10).sum(1), 0, 2)
    m = Q.fit_ordinal(x.ravel(), np.arange(0, 1201, 3), grade)
    assert m.thresholds[0] < m.thresholds[1]
    above = m.above(Q.linear(m.weights, x.ravel(), np.arange(0, 1201, 3)))
    assert (above[:, 0] >= above[:, 1]).all() and np.corrcoef(above.sum(1), grade)[0, 1] > 0.7


def test_grades_odd(spark, odd, empty):
    none = spark.createDataFrame([], LABELS)
    assert Q.graded(odd, none).where("kept").count() == 12 and Q.graded(empty, none).count() == 0
    some = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (6, 1, 0), (7, 1, 1)], LABELS)
    assert Q.graded(odd, some).count() == 12


@pytest.mark.parametrize("text", ["", "A", "!!!", "é1!"])
def test_features_of_tiny_texts(text):
    at, first = Q.features([text.encode(), b"next one"])
    assert first[0] == 0 and first[-1] == len(at) and len(first) == 3


def test_stage_rejects_what_the_network_finds_no_language_in(make, empty):
    """Letters alone would keep all of these rows."""
    rng = random.Random(3)
    rows = corpus(300)
    junk = [(1000 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(300)), None) for i in range(20)]
    kept = {r.doc_id for r in G.keep_identified(make(*rows, *junk)).collect()}
    assert kept >= {i for i, _, _ in rows} and len(kept - {i for i, _, _ in rows}) <= 2
    # Without anything to learn from, texts with a letter stay.
    bare = make(*[(i, t, None) for i, t, _ in rows[:20]], (900, "12 !", None), (901, None, None))
    assert {r.doc_id for r in G.keep_identified(bare).collect()} == {i for i, _, _ in rows[:20]}
    assert G.keep_identified(empty).count() == 0


def test_languages_against_a_plain_network(make):
    """Labels and scores of every text against the network written as loops."""
    rows = corpus(90)
    model = G.fit(make(*rows))
    sig = lambda x: 1 / (1 + np.exp(-x))
    hid = model.bias.shape[1]
    for _, text, _ in rows[:6]:
        total = np.zeros(len(model.out))
        data = text.encode()
        for at in range(0, len(data), G.WINDOW):
            window = data[at : at + G.WINDOW].ljust(G.WINDOW, b"\0")
            states = np.zeros((2, G.WINDOW, hid))
            for d, order in ((0, range(G.WINDOW)), (1, reversed(range(G.WINDOW)))):
                h = np.zeros(hid)
                for t in order:
                    x, g = model.embed[d][:, window[t]], model.recur[d] @ h
                    z, r = sig(x[:hid] + g[:hid]), sig(x[hid : 2 * hid] + g[hid : 2 * hid])
                    n = np.tanh(x[2 * hid :] + r * (g[2 * hid :] + model.bias[d]))
                    h = states[d, t] = z * h + (1 - z) * n
            for t in range(min(G.WINDOW, len(data) - at)):
                logits = model.out @ np.concatenate([states[0, t], states[1, t]]) + model.shift
                total += logits - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
        p = np.exp((total[: len(model.langs)] - total[: len(model.langs)].max()) / len(data))
        lang, score, none = G.classify(model, [data])
        assert lang[0] == model.langs[total[: len(model.langs)].argmax()] and abs(score[0] - (p / p.sum()).max()) < 1e-3
        assert abs(none[0] - (total[-1] - total[: len(model.langs)].max())) < 1e-2 * abs(none[0]) + 0.5


def test_counts_that_scorers_hold_are_bounded(make, monkeypatch):
    """Whatever the counts, at most HELD words are held, and base scores stay exact."""
    rows = [(i, "hot " * 40 + f"word{i % 7} rare{i}") for i in range(60)]
    want = {r.doc_id: (r.base_score, r.n_known, r.score) for r in M.language_scores(make(*rows)).collect()}
    for held in (0, 1, 4):
        monkeypatch.setattr(M, "HELD", held)
        for r in M.language_scores(make(*rows)).collect():
            assert abs(r.base_score - want[r.doc_id][0]) < 1e-6 and r.n_known == want[r.doc_id][1] and abs(r.score - want[r.doc_id][2]) < 0.5


def test_levels_of_counts(spark):
    from pyspark.sql import functions as F

    for n, level in [(r.n, r.level) for r in spark.createDataFrame([(x,) for x in [1, 7, 255, 256, 257, 511, 512, 1023, 99_999, 100_001, 10**12 + 12345]], "n long").select("n", M.count_level(F.col("n")).alias("level")).collect()]:
        shift = max(0, n.bit_length() - 8)
        assert level == n >> shift << shift


def test_grades_against_a_plain_sum(spark, make, words):
    """Probabilities of every document against the weights summed in Python."""
    rows, labels = graded_rows(words, 200)
    model = Q.fit(make(*rows), spark.createDataFrame(labels, LABELS))
    got = {r.doc_id: r for r in Q.graded(make(*rows), spark.createDataFrame(labels, LABELS), model).collect()}
    for i, text in rows[:40]:
        at, _ = Q.features([text.encode()])
        z = sum(float(model.weights[a]) for a in at.tolist())
        above = [1 / (1 + math.exp(t - z)) for t in model.thresholds]
        assert abs(got[i].expected_grade - sum(above)) < 1e-4 and abs(got[i].p_top - above[-1]) < 1e-4 and got[i].kept == (above[-1] >= Q.SELECT)


def test_rarer_words_of_one_shape_are_told_apart(make, monkeypatch):
    """Which of two words of one class follows depends on which of two words of one class came before."""
    monkeypatch.setattr(M, "FREQUENT", 4)
    rng = np.random.default_rng(5)
    both = lambda a, b: " ".join(["kalora " + a, "milora " + b] * 100)
    texts = [" ".join("the " + ("kalora tesuna" if x else "milora resuna") + " of a" for x in rng.permutation([True, False] * 50)) for _ in range(200)]
    got = {r.doc_id: r for r in M.language_scores(make(*enumerate([*texts, both("tesuna", "resuna"), both("resuna", "tesuna")]))).collect()}
    right, wrong = got[200], got[201]
    assert right.n_tokens == wrong.n_tokens and abs(right.base_score - wrong.base_score) < 1e-6
    assert right.score > wrong.score + 0.1 * right.n_tokens


def test_shares_inside_a_class_sum_to_one():
    words = M.Words(np.array([5], np.uint64), np.array([3, 9, 11], np.uint64), np.array([2, 1, 2]), np.array([0.3, 0.2, 0.5]))
    model = M.Bilinear.start(np.full(words.classes, 1 / words.classes), words.share)
    rng = np.random.default_rng(2)
    model.own[:], model.inner[:] = rng.standard_normal((2, 3, M.WIDTH))
    ids = np.array([*words.of(np.array([3, 11], np.uint64), np.array([1, 1])), 2])  # both known words of class 2, and its others
    got = 10 ** M.inner_scores(model, words, ids, np.tile([[0], [words.classes], [words.classes + 1]], 3))
    assert abs(got[0] + got[1] + got[2] * words.rest[2] - 1) < 1e-5


def test_steps_touch_only_what_a_batch_has(monkeypatch):
    """Parameters after some steps are those of plain sums, and one step's work does not grow with the known words."""
    known = 30_000
    words = M.Words(np.array([5], np.uint64), np.arange(10, 10 + known, dtype=np.uint64), np.arange(known) % 90 + 1, np.full(known, 1e-4))
    unigram = np.full(words.classes, 1 / words.classes)
    rng = np.random.default_rng(3)
    start = M.Bilinear.start(unigram, words.share)
    start.own[:] = rng.standard_normal(start.own.shape) * 0.1
    trainer = M.Trainer(M.Bilinear.shaped(start.flat(), words.classes, known), unigram, 1, words=words)
    target, ctx = rng.integers(0, words.classes, 500), rng.integers(0, words.classes + 1 + 60, (3, 500))
    gradient = {}
    for at, x in [*zip(ctx.ravel(), np.ones((1500, 2)), strict=True)]:
        gradient[int(at)] = gradient.get(int(at), 0) + x
    at, summed = M._sums(ctx.ravel(), np.ones((1500, 2)))
    assert at.tolist() == sorted(gradient) and all((summed[i] == gradient[k]).all() for i, k in enumerate(at.tolist()))
    trainer.step(target, ctx, loss=False)
    seen = np.unique(ctx[ctx > words.classes]) - words.classes - 1
    moved = (trainer.model.own != start.own).any(1)
    assert moved[seen].all() and not np.delete(moved, seen).any()
    assert (np.delete(trainer.square[4], seen, 0) == np.float32(0.1)).all()


def test_class_scores_of_any_size():
    """Logits beyond what a power holds are scaled first."""
    unigram = np.full(20, 1 / 20)
    model = M.Bilinear.start(unigram)
    ctx = np.tile(np.array([[3], [7], [20]]), (1, 20))
    plain = M.class_scores(model, np.arange(20), ctx)
    for shift in (500, -500):
        model.bias = np.log(unigram).astype(np.float32) + np.float32(shift)
        assert np.abs(M.class_scores(model, np.arange(20), ctx) - plain).max() < 1e-4
