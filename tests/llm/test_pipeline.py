"""The pipeline against brute force on a small corpus, and the registration."""

import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np

import __spark_entry__
import corpus_pipeline
from kestrace.llm.near_dedup import aligned, kmers

ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, make, words, tmp_path):
    rng = random.Random(21)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [say(rng.randint(40, 90)) for _ in range(50)]
    bench = [(i, say(25)) for i in range(4)]
    texts = base + [b.upper() for b in base[:6]] + [b + " tail" for b in base[10:14]] + [say(30) + " " + bench[i][1] + " " + say(20) for i in range(4)] + [None, "12 34", ""]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    make(*rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / f"stage{len(kept)}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append({r.doc_id for r in docs.collect()})
        assert set(docs.columns) >= {"doc_id", "text", "lang", "source", "n_chars"}
    want = {i for i, t, *_ in rows if t and re.search(r"[^\W\d_]", t)}
    assert kept[0] == want
    low: dict = {}
    for i in sorted(want):
        low[texts[i].lower()] = i
    want = set(low.values())
    assert kept[1] == want
    seqs, first = {i: kmers([texts[i].encode()])[0] for i in want}, []
    for i in sorted(want):
        if not any(aligned(seqs[i], seqs[j]) for j in first):
            first.append(i)
    assert kept[2] == set(first)
    want = {i for i in first if not any(t in texts[i] for _, t in bench)}
    assert kept[3] == want
    sizes: dict = {}
    for i in want:
        sizes[f"s{i % 3}"] = sizes.get(f"s{i % 3}", 0) + len(texts[i].split())
    assert kept[4] <= want
    taken = docs.groupBy("source").sum("taken").collect()
    assert abs(sum(r[1] for r in taken) - 1.5 * sum(sizes.values())) < 120 * 3
    assert all(r[1] <= 2 * sizes[r[0]] for r in taken)
    ran = {(r.doc_id, r.repeats) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ran == {(r.doc_id, r.repeats) for r in docs.collect()}


def test_stages_on_empty_and_odd_tables(spark, empty, odd, tmp_path):
    """No table, repeated rows, nulls and clashing names: no stage fails, loses a column or makes a row."""
    spark.createDataFrame([(1, "same text here"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, empty, str(tmp_path))
        assert got.count() == 0 and set(got.columns) >= set(empty.columns), name
        got = stage(spark, odd, str(tmp_path))
        assert set(got.columns) >= set(odd.columns) and got.count() <= odd.count(), name
        assert {r.kept for r in got.select("kept").collect()} <= {"mine"} and {r.bucket for r in got.select("bucket").collect()} <= {1}, name


def test_registered_once():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(bool(re.match(rf"op{n}_", x)) for x in names) == 1
    assert "pipeline" in names and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_rest_imports_without_this_package(tmp_path):
    code = "import sys; sys.modules['kestrace.llm'] = None\nimport __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q"
    block = "import importlib.abc, sys\nclass No(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, *a):\n        if name.startswith('kestrace.llm') or name == 'corpus_pipeline':\n            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())\n"
    subprocess.run([sys.executable, "-c", block + code.split("\n")[1]], cwd=ROOT, check=True)


def test_results_are_numbers(spark):
    assert np.isfinite(__spark_entry__.queries()["op2_quality_grade"](spark, "/root/testdata/sf0.001").agg({"p_top": "avg"}).first()[0])
