"""Exact copies against grouping in Python; the mix against its targets and exhaustive search."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from kestrace.llm.exact_dedup import decode, drop_exact_copies, encode, exact_groups
from kestrace.llm.mixing import mix, route, select_mix, targets


@given(st.sets(st.integers(0, 2**40 - 1), max_size=200))
def test_code_round_trip(found):
    values = np.array(sorted(found), np.int64)
    assert decode(encode(values)).tolist() == values.tolist()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_groups_against_python(make):
    rows = [(i, ["Same Text", "same text", "SAME  text", None, "", "É", "é", f"own {i}"][i % 8]) for i in range(200)]
    rows += [(500, "hot copy")] * 2 + [(600 + i, "HOT copy") for i in range(90)]
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(make(*rows).repartition(5)).collect())
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    want = Counter((i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert got == want


def test_repeated_rows_keep_one(make):
    got = exact_groups(make((1, "a"), (1, "a"), (0, "A"))).collect()
    assert sorted(r.kept for r in got) == [False, False, True] and {r.keep_id for r in got} == {1}
    assert drop_exact_copies(make((1, "a"), (1, "a"), (0, "A"), (2, "b"))).count() == 2


def test_odd_inputs(odd, empty):
    got = exact_groups(odd).collect()
    assert len(got) == 12 and sum(r.group_size == 3 for r in got) == 3  # two nulls and one empty text
    assert exact_groups(empty).count() == 0
    out = drop_exact_copies(odd)
    assert out.columns == odd.columns and out.count() == 9


def brute_targets(sizes, share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        left = total - sum(fixed.values())
        part = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if part[s] > most * sizes[s]]
        if not over:
            return fixed | part
        fixed |= {s: most * sizes[s] for s in over}


def test_mix_meets_targets(make, words):
    rows = [(i, " ".join(words[: 5 + i * 7 % 60]), "en", [f"s{i % 4}", "big", None][0 if i % 3 else 1 + i % 2]) for i in range(900)]
    got = mix(make(*rows)).collect()
    source = {r[0]: r[3] for r in rows}
    sizes = defaultdict(int)
    for r in got:
        sizes[source[r.doc_id]] += r.size
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", rows[r.doc_id][1])) and 0 <= r.taken <= 2 * r.size
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 and r.source_size == sizes[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 40, (s, taken[s], t)
    again = {(r.doc_id, r.taken) for r in mix(make(*rows).repartition(3)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_targets_order():
    got = targets([("b", 100), (None, 100), ("a", 100)])
    assert got == {"a": 200.0, "b": pytest.approx(500 / 3), None: pytest.approx(250 / 3)}
    assert targets([("a", 0)]) == {"a": 0.0} and targets([]) == {}


def test_flow_is_cheapest():
    """Against all splits of small whole capacities."""
    capacity, want = {("a",): 3.0, ("a", "b"): 4.0, ("b",): 1.0}, {"a": 5.0, "b": 4.0}
    sent = route(capacity, want)
    assert sum(v for (_, s, _), v in sent.items() if s == "a") == 5 and sum(v for (_, s, _), v in sent.items() if s == "b") == 4
    cost = sum(v * c for (_, _, c), v in sent.items())
    best = None
    for x, y, z in itertools.product(range(7), range(9), range(3)):  # a alone, shared to a, b alone
        to_b = 4 - z
        if x + y == 5 and 0 <= to_b and y + to_b <= 8:
            c = max(0, x - 3) + max(0, y + to_b - 4) + max(0, z - 1)
            best = c if best is None else min(best, c)
    assert cost == best


def test_overlapping_members(spark, make):
    from pyspark.sql import functions as F

    docs = make(*[(i, "w " * 10) for i in range(60)]).withColumn("m", F.when(F.col("doc_id") < 20, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))))
    got = mix(docs, "m").collect()
    assert {tuple(r.pattern) for r in got} == {("a", "b"), ("b",)} and all(r.repeats <= 2 for r in got)


def test_mix_odd_inputs(odd, empty):
    got = mix(odd).collect()
    assert len(got) == 12 and all(r.taken == 0 for r in got if r.size == 0)
    assert mix(empty).count() == 0 and select_mix(empty).count() == 0
    assert set(odd.columns) <= set(select_mix(odd).columns)


@pytest.mark.parametrize("key_bytes", [0, 1])
def test_bytes_decide_where_keys_clash(make, key_bytes):
    """With keys of one byte or none, different texts share them; groups are still those of the bytes."""
    rows = [(i, f"Text {i % 40}" if i % 3 else f"own {i}") for i in range(150)] + [(500, "hot")] * 3 + [(600 + i, "HOT") for i in range(30)] + [(7, "another text of an id that repeats"), (None, None), (None, "")]
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(make(*rows).repartition(4), key_bytes).collect())
    want = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(make(*rows).repartition(3)).collect())
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    assert got == want and sum(k[3] * n for k, n in got.items()) == len(groups)
    assert Counter((i, d) for (i, _, _, _, d), n in got.items() for _ in range(n)) == Counter((i, hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)


def test_mix_of_repeated_ids_meets_targets(make):
    """Ids that repeat have repeats of their own, also where one id and text is a third of the rows."""
    rows = [(i % 50, "w " * (5 + i % 7), "en", f"s{i % 3}") for i in range(900)] + [(77, "w w w", "en", "s2")] * 450
    docs = make(*rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    want = brute_targets(sizes)
    got = select_mix(docs.repartition(3)).collect()
    for r in got:
        assert r.taken == r.repeats * len(r.text.split()) and 1 <= r.repeats <= 2
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 12, (s, taken[s], t)  # within one document


def test_places_are_split_until_few_rows_are_left(make, monkeypatch):
    """A digit's rows that are too many are split by the next digit; the words taken stay near the targets."""
    monkeypatch.setattr("kestrace.llm.mixing.TRIED", 3)
    monkeypatch.setattr("kestrace.llm.mixing.DIGIT", 2)
    monkeypatch.setattr("kestrace.llm.mixing.LEVELS", 3)
    monkeypatch.setattr("kestrace.llm.mixing._END", (1 << 6) - 1)
    rows = [(i, "w " * (3 + i % 5), "en", f"s{i % 2}") for i in range(400)]
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    for r in select_mix(make(*rows)).collect():
        taken[r.source] += r.taken
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= 14, (s, taken[s], t)


def test_mix_keeps_columns_of_its_names(make):
    from pyspark.sql import functions as F

    docs = make((1, "a b c"), (2, "d e")).withColumn("repeats", F.lit("mine")).withColumn("mixed", F.lit(1))
    got = select_mix(docs)
    assert {r.repeats for r in got.collect()} == {"mine"} and "repeats_" in got.columns and "mixed" in got.columns
