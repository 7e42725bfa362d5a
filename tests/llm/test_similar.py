"""Near copies, fuzzy lines and benchmark passages against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from kestrace.llm.decontam import Item, answer_of, confirm, contaminated, drop_contaminated, latent_space, words_of
from kestrace.llm.graph import components
from kestrace.llm import line_dedup
from kestrace.llm.line_dedup import line_classes, shingle_set
from kestrace.llm.near_dedup import aligned, drop_near_copies, kmers, near_classes, sketches


def union(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union(400, pairs)
    assert all(got[i] == want[i] for i in got) and set(got) == {x for p in pairs if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_against_dynamic_programming():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 40, rng.integers(0, 60)).astype(np.uint64)
        b = a.copy()
        for _ in range(rng.integers(0, 9)):
            at = rng.integers(0, len(b) + 1)
            b = np.insert(b, at, rng.integers(0, 40)) if rng.random() < 0.5 else np.delete(b, min(at, len(b) - 1)) if len(b) else b
        n = lcs(a.tolist(), b.tolist())
        want = n / max(1, len(a) + len(b) - n)
        got = aligned(a, b, 0.8)
        assert abs(got - want) < 1e-12 if want >= 0.8 and len(a) and len(b) else got == 0


def edited(text, rng, words, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(words)
    return " ".join(w)


def near_rows(words):
    rng = random.Random(6)
    rows = []
    for g in range(12):
        base = " ".join(rng.choice(words) for _ in range(rng.randint(40, 200)))
        rows += [base] + [edited(base, rng, words, rng.randint(0, 2)) for _ in range(rng.randint(0, 6))]
    shared = " ".join(rng.choice(words) for _ in range(60))
    rows += [f"{' '.join(rng.choice(words) for _ in range(70))} {shared}" for _ in range(15)]  # a passage in common is no copy
    rows += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(30)]
    hot = " ".join(rng.choice(words) for _ in range(300))
    rows += [edited(hot, rng, words, 2) for _ in range(80)] + [hot] * 10
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_classes_against_all_pairs(make, words):
    rows = near_rows(words)
    seqs = [kmers([t.encode()])[0] for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if aligned(seqs[i], seqs[j]) > 0]
    want = union(len(rows), pairs)
    got = {r.doc_id: r for r in near_classes(make(*rows).repartition(3)).collect()}
    assert [got[i].class_id for i in range(len(rows))] == want
    size = Counter(want)
    assert all(got[i].class_size == size[want[i]] and got[i].kept == (want[i] == i) for i in range(len(rows)))
    assert drop_near_copies(make(*rows)).count() == len(size)


def test_order_matters(words):
    half = [" ".join(words[i : i + 80]) for i in (0, 80)]
    a, b = f"{half[0]} {half[1]}".encode(), f"{half[1]} {half[0]}".encode()
    assert aligned(kmers([a])[0], kmers([b])[0]) == 0
    assert (sketches([a]) == sketches([a + b" more"])).sum() > 10


def test_near_odd(odd, empty):
    got = near_classes(odd).collect()
    assert len(got) == 12 and sum(r.kept for r in got) == 9
    assert near_classes(empty).count() == 0
    out = drop_near_copies(odd)
    assert out.columns == odd.columns and out.count() == 9


def test_lines_against_all_pairs(make, words):
    rng = random.Random(8)
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(4, 20))).capitalize() for _ in range(60)]
    near = [x[: len(x) // 2] + rng.choice("xyz") + x[len(x) // 2 :] for x in base[:30]]
    lines = base + near + ["Hot line that is everywhere in this corpus"] * 40 + ["ab", "AB", "é", " "]
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 7 : i * 7 + 7])) for i in range(-(-len(lines) // 7))]
    places = [(d, n, line) for d, t in rows for n, line in enumerate(t.split("\n")) if line.strip()]
    sets = [shingle_set(line) for _, _, line in places]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    want = union(len(places), pairs)
    got = {(r.doc_id, r.line_no): r for r in line_classes(make(*rows).repartition(3)).collect()}
    assert set(got) == {(d, n) for d, n, _ in places}
    for i, (d, n, _) in enumerate(places):
        first = places[want[i]]
        assert (got[d, n].keep_doc_id, got[d, n].keep_line_no) == first[:2] and got[d, n].kept == (first[:2] == (d, n))


def test_lines_of_templates_against_all_pairs(make, words, monkeypatch):
    """Families whose lines resemble a leader without being its copies, over several partitions and blocks."""
    rng = random.Random(21)
    lines = set()
    for g in range(8):
        frame = [rng.choice(words) for _ in range(12)]
        for _ in range(60):
            w = list(frame)
            for k in rng.sample(range(12), rng.randint(1, 3)):
                w[k] = rng.choice(words[g * 6 : g * 6 + 6])
            lines.add(" ".join(w))
    lines = sorted(lines)
    rng.shuffle(lines)
    sets = [shingle_set(x) for x in lines]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    want = union(len(lines), pairs)
    for block, parts in ((512, 5), (8, 3)):
        monkeypatch.setattr("kestrace.llm.line_dedup.BLOCK", block, raising=False)
        got = {r.doc_id: r.keep_doc_id for r in line_classes(make(*enumerate(lines)).repartition(parts)).collect()}
        assert [got[i] for i in range(len(lines))] == want


def test_lines_odd(odd, empty):
    got = line_classes(odd).collect()
    assert {r.doc_id for r in got} == {4, 5, 6, 7, None, 10} and len(got) == 7 and sum(r.kept for r in got) == 6
    assert line_classes(empty).count() == 0


BENCH = "item_id long, text string"


def bench_rows(words):
    rng = random.Random(12)
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(15, 60))) + (f"? {rng.choice(words)} {rng.choice(words)}" if i % 2 else ".")) for i in range(40)]


def test_passages_and_paraphrases(spark, make, words):
    rng = random.Random(13)
    items, rows, want = bench_rows(words), [], {}
    for i in range(120):
        body = [rng.choice(words) for _ in range(rng.randint(20, 300))]
        if i % 3 == 0:
            item = items[i % 40]
            passage = item[1].split()
            if i % 6 == 0:  # a paraphrase: every sixth word another
                passage = [rng.choice(words) if k % 6 == 5 and k < len(passage) - 4 else w for k, w in enumerate(passage)]
            at = rng.randrange(len(body))
            body = body[:at] + passage + body[at:]
            want[i] = item[0]
        rows.append((i, " ".join(body)))
    got = contaminated(make(*rows), spark.createDataFrame(items, BENCH)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(want.items())
    for r in got:
        span = rows[r.doc_id][1].split()[r.start_word : r.end_word]
        assert r.lcs >= 0.6 and len(set(span) & set(items[r.item_id][1].split())) > 5
    kept = drop_contaminated(make(*rows), spark.createDataFrame(items, BENCH))
    assert {r.doc_id for r in kept.collect()} == set(range(120)) - set(want)


def test_latent_space_keeps_few_items_whole(spark, words):
    items = bench_rows(words)[:20]
    idf = np.ones(1 << 15)
    v = latent_space(spark.createDataFrame([(t,) for _, t in items], "text string").repartition(3), idf)
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-4)
    from kestrace.llm.decontam import _weighed

    for _, t in items:
        d, w = _weighed([t.encode()], idf)[0]
        assert abs(np.linalg.norm(w @ v[d]) / np.linalg.norm(w) - 1) < 1e-3


def test_confirm_needs_the_answer():
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa? lambda mu"
    h = words_of([text.encode()])[0].tolist()
    item = Item(1, h, frozenset(words_of([answer_of(text).encode()])[0].tolist()))
    assert answer_of(text) == "lambda mu"
    assert confirm(item, h) and confirm(item, h[:-2]) is None


def test_decontam_odd(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (None, "same text here"), (3, "zz yy xx")], BENCH)
    got = contaminated(odd, items).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(7, None)] * 2
    assert contaminated(empty, items).count() == 0 and contaminated(odd, spark.createDataFrame([], BENCH)).count() == 0
    out = drop_contaminated(odd, items)
    assert out.columns == odd.columns and out.count() == 10


def test_recall_of_line_pairs(make, words):
    """Families of template lines: the share of all pairs at the threshold that end in one class."""
    rng = random.Random(31)
    lines = set()
    for g in range(5):
        frame = [rng.choice(words) for _ in range(14)]
        for _ in range(110):
            w = list(frame)
            for k in rng.sample(range(14), rng.randint(1, 4)):
                w[k] = rng.choice(words[g * 9 : g * 9 + 9])
            lines.add(" ".join(w))
    lines = sorted(lines)
    rng.shuffle(lines)
    sets = [shingle_set(x) for x in lines]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    got = {r.doc_id: r.keep_doc_id for r in line_classes(make(*enumerate(lines)).repartition(4)).collect()}
    assert len(pairs) > 100 and np.mean([got[i] == got[j] for i, j in pairs]) >= 0.98
    want = union(len(lines), pairs)
    assert all(want[i] == want[got[i]] for i in got)  # nothing is joined that the pairs don't join


def test_near_copies_inside_a_hot_bucket(make, words, monkeypatch):
    """Many texts on one long passage, whose few near copies share only buckets that all of them share, over small blocks."""
    monkeypatch.setattr("kestrace.llm.near_dedup.BLOCK", 6)
    rng = random.Random(17)
    shared = " ".join(rng.choice(words) for _ in range(150))
    own = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(60)]
    texts = [f"{shared} {x}" for x in own]
    texts += [edited(t, rng, words, 3) for t in texts[:25]]
    rng.shuffle(texts)
    seqs = [kmers([t.encode()])[0] for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if aligned(seqs[i], seqs[j]) > 0]
    got = {r.doc_id: r.class_id for r in near_classes(make(*enumerate(texts)).repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == union(len(texts), pairs) and len(pairs) > 10


def test_components_after_local_joins(spark, monkeypatch):
    """With tasks that join few nodes, the rounds have to do the rest."""
    monkeypatch.setattr("kestrace.llm.graph.LOCAL", 20)
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(150)] + [(300, x) for x in range(301, 380)] + [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(150)]
    rng.shuffle(pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(9)).collect()}
    want = union(700, pairs)
    assert all(got[i] == want[i] for i in got)


def test_long_and_short_items(spark, make, words):
    """An item of 2500 words and items of one to seven words, against all documents by brute force."""
    rng = random.Random(41)
    say = lambda n: [rng.choice(words) for _ in range(n)]
    long = say(2500)
    items = [(0, " ".join(long)), (1, "Zyx"), (2, "qaa qbb"), (3, "qcc qdd qee qff qgg qhh qii"), *[(i, " ".join(say(30))) for i in range(4, 20)]]
    reworded = [w if rng.random() < 0.72 else rng.choice(words) for w in long]
    reworded[-40:] = long[-40:]  # the answer stays
    docs = [say(200) + long + say(100), say(50) + reworded + say(20), say(31) + ["zyX"] + say(90), say(63) + ["qaa", "qbb"] + say(5), say(10) + ["qbb", "qaa"] + say(10), say(33) + "qcc qdd qee qff qgg qhh qii".split(), say(300), ["qcc", "qdd", "qee"], long[:900]]
    got = {(r.doc_id, r.item_id) for r in contaminated(make(*[(i, " ".join(d)) for i, d in enumerate(docs)]), spark.createDataFrame(items, BENCH)).collect()}
    assert got == {(0, 0), (1, 0), (2, 1), (3, 2), (5, 3)}


def test_best_span_that_has_the_answer():
    words = [f"w{i}" for i in range(24)]
    item = Item(1, words_of([" ".join(words).encode()])[0].tolist(), frozenset(words_of([b"w22 w23"])[0].tolist()))
    part = words[:20]  # the longer copy, but without the answer
    with_answer = [w for i, w in enumerate(words) if i not in (3, 8, 13, 17)]
    region = words_of([" ".join(part + ["x"] * 40 + with_answer).encode()])[0].tolist()
    got = confirm(item, region)
    assert got and got[2] >= 20 and got[1] == 1.0


def test_rare_signs_fall_back_to_strings(make):
    """Lines with more different signs than can be packed."""
    rng = random.Random(5)
    base = ["".join(chr(0x4E00 + rng.randrange(15000)) for _ in range(200)) for _ in range(40)]
    lines = base + [x[:190] + "ab" + x[192:] for x in base[:20]]
    sets = [shingle_set(x) for x in lines]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    got = {r.doc_id: r.keep_doc_id for r in line_classes(make(*enumerate(lines))).collect()}
    assert [got[i] for i in range(len(lines))] == union(len(lines), pairs) and len(pairs) == 20


def _shuffled(spark):
    """Bytes that all stages so far wrote to shuffles."""
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_of_lines_are_shuffled_once_for_all_pairs(spark, make):
    """Joins by shuffle, as at size: a line's text is sent to be made one with its repeats, and to its pairs."""
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789 ") for _ in range(n))
    base = [say(20_000) for _ in range(60)]
    lines = [x for b in base for x in (b, b + " and more")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        start = _shuffled(spark)
        got = {r.doc_id: r.keep_doc_id for r in line_classes(make(*enumerate(lines)).repartition(4)).collect()}
        sent = _shuffled(spark) - start
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {i: i // 2 * 2 for i in range(len(lines))}
    assert sent < 4.5 * sum(map(len, lines))  # twice by the repartition of this test


def test_rows_of_buckets_are_shuffled_packed(spark, make, tmp_path):
    """Unlike lines: a row for each of ten bands, and what brings classes to their lines."""
    rng = random.Random(9)
    lines = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(40)) for _ in range(6000)]
    make(*((i, "\n".join(lines[i * 60 : i * 60 + 60])) for i in range(100))).coalesce(1).write.parquet(f"{tmp_path}/documents")
    start = _shuffled(spark)
    got = line_classes(spark.read.parquet(f"{tmp_path}/documents")).collect()
    sent = _shuffled(spark) - start
    assert len(got) == 6000 and all(r.kept and r.class_size == 1 for r in got)
    assert sent < 300 * len(lines)


def _found(batches):
    """Pairs and members (bucket, node) in batches of _candidates."""
    rows = [tuple(x) for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("bucket", "node", "kind")), strict=True)]
    return {(a, b) for a, b, k in rows if k == line_dedup.PAIR}, {(a, b) for a, b, k in rows if k == line_dedup.OTHER}


def test_pieces_of_slices_against_all_lines(words, monkeypatch):
    """Several tasks' pieces, held as a whole or reduced on the way, link what resembles each other in a bucket."""
    rng, bits = random.Random(10), 7
    frame = [rng.choice(words) for _ in range(14)]
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(50)) for _ in range(300)]
    for _ in range(240):
        w = list(frame)
        w[rng.randrange(14)] = rng.choice(words)
        lines.append(" ".join(w))
    lines = list(dict.fromkeys(lines))
    rng.shuffle(lines)
    sent = [b for at in range(0, len(lines), 60) for b in line_dedup._buckets(bits)(iter([pa.RecordBatch.from_pydict({"text": lines[at : at + 60]})]))]
    table = pa.Table.from_batches(sent).combine_chunks().sort_by("slice")
    whole = _found(line_dedup._candidates(iter(table.to_batches())))
    read = line_dedup.Lines([x.encode() for x in lines])
    keys, sketch = line_dedup.bands(read.minima(np.arange(len(lines))))
    of = {int(n): i for i, n in enumerate(read.node)}
    want = {(i, j) for row in keys for k in Counter(row.tolist()) for at in [np.flatnonzero(row == np.uint64(k))] for i in at for j in at if i < j and line_dedup.unlike(sketch[i], sketch[j]) <= 12 and read.node[i] != read.node[j]}
    assert len(want) > 1000
    monkeypatch.setattr(line_dedup, "SLICE_ROWS", 40)
    for pairs, members in (whole, _found(line_dedup._candidates(iter(table.to_batches(max_chunksize=3))))):
        met = {tuple(sorted((of[a], of[b]))) for a, b in pairs}
        by = {}
        for bucket, node in members:
            by.setdefault(bucket, []).append(of[node])
        met |= {(i, j) for who in by.values() for i in who for j in who if i < j}
        assert want <= met


def test_lines_like_no_other_of_a_large_bucket_are_left_out():
    rng = np.random.default_rng(3)
    sketch = rng.integers(0, 1 << 62, 40)
    sketch[7] = sketch[3]
    rows = (np.full(40, 5), np.arange(40), sketch, np.zeros(40, np.int32))
    pairs, members = _found([line_dedup._rows(*line_dedup._met(rows, True)[0])])
    assert pairs == {(7, 3)} and not members


def used_alike(n=40):
    """Documents of n topics with a pair of words each that never meet but share their company, an item of n of the first words, and one of their partners."""
    rng = random.Random(6)
    common = [f"the{i}" for i in range(12)]
    company = [[f"c{t}x{k}" for k in range(8)] for t in range(n)]
    pairs = [(f"one{t}", f"two{t}") for t in range(n)]
    docs = []
    for i in range(n * 40):
        body = [rng.choice(company[i % n]) for _ in range(24)] + [pairs[i % n][i // n % 2]] + common + [":"]
        rng.shuffle(body)
        docs.append(" ".join(body))
    say = lambda side: " ".join(w for t in range(12) for w in (common[t], common[(5 * t + 1) % 12], pairs[t][side])) + " : " + " ".join(common[:6])
    return docs, say(0), say(1)


def test_words_used_alike_count_as_one_another(spark, make, monkeypatch):
    """A passage whose telling words are replaced by others of the same use: found by the latent space, not without it."""
    docs, item, reworded = used_alike()
    assert not {w for w in item.split() if w.startswith("one")} & set(reworded.split())
    table = make(*enumerate([*docs, reworded]))
    bench = spark.createDataFrame([(7, item)], BENCH)
    got = contaminated(table, bench).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(len(docs), 7)] and got[0].lcs >= 0.6
    monkeypatch.setattr("kestrace.llm.decontam.ALIKE", 1.01)
    assert contaminated(table, bench).count() == 0
