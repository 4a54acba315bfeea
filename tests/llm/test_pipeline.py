"""Each stage of the pipeline against brute force on its own input, and run() against the stages."""

import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F

from rasterlake.llm import bpe
from test_operators import brute_components, brute_repeats

BASE = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{BASE}/documents.parquet").withColumn("id", F.lit("clash"))
    kept = {}
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        f(spark, docs, BASE).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept[i] = (before, docs.collect())
        if i < 4:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS

    before, after = kept[0]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{BASE}/labels.parquet").collect()}
    ids = {r.doc_id for r in after}
    assert all((d in ids) == (labels[d].quality == 1) for d in labels)
    assert {r.doc_id: r.text for r in before if r.doc_id in ids} == {r.doc_id: r.text for r in after}

    before, after = kept[1]
    same = {d: c for d, _, c in brute_components([(r.doc_id, r.text) for r in before], 5, 80, 100)}
    assert sorted(r.doc_id for r in after) == sorted(d for d, c in same.items() if d == c)

    before, after = kept[2]
    expected = brute_repeats([(r.doc_id, r.text.encode()) for r in before], 100)
    assert {r.doc_id: r.text for r in after} == {d: raw.decode("utf-8", "ignore") for d, raw in expected.items()}
    assert all(r.n_chars == len(r.text) for r in after)

    before, after = kept[3]
    size = lambda t: len([w for w in (t or "").replace("\n", " ").split(" ") if w])
    of, copies = {r.doc_id: r for r in before}, {}
    for r in after:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        assert r.text == of[r.doc_id].text
    assert max(copies.values()) <= 3
    total = sum(size(r.text) for r in before)
    assert abs(sum(n * size(of[d].text) for d, n in copies.items()) - total) < 0.05 * total

    before, after = kept[4]
    library = bpe.loaded(corpus_pipeline.TOKENIZER).library
    assert sorted((r.doc_id, tuple(r.ids)) for r in after) == sorted((r.doc_id, tuple(library.encode(r.text, add_special_tokens=False).ids)) for r in before)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in after)

    again = corpus_pipeline.run(spark, BASE).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in again) == sorted((r.doc_id, tuple(r.ids)) for r in after)


def test_odd_rows_and_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{BASE}/documents.parquet").limit(20)
    odd = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, "a b c d e f g", None, None, None), (None, None, None, None, None), (900, "", "x", "y", 0), (901, None, "x", None, None)], docs.schema))
    for start in (odd, docs.limit(0)):
        at = start
        for i, (name, f) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{start is odd}{i}")
            f(spark, at, BASE).write.parquet(path)
            at = spark.read.parquet(path)
        assert (at.count() > 0) == (start is odd)


def test_near_duplicates_by_row(spark):
    a, b, c = ("".join(f"{w}{i} " for i in range(40)) for w in "abc")
    rows = [(3, a), (5, a), (5, b), (None, c), (None, c + "more"), (None, c), (7, b + "more"), (8, ""), (None, None), (None, None), (9, "x y"), (9, "x y"), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, BASE).collect()]
    text = [(i, t) for i, t in got if t]
    assert [t for i, t in text if i is None] in ([c], [c + "more"])
    assert sorted((i, t) for i, t in text if i is not None) == [(3, a), (5, b), (9, "x y")]
    assert sorted((i is None, i or 0, t is None) for i, t in got if not t) == [(False, 6, True), (False, 8, False), (True, 0, True), (True, 0, True)]


def test_entry_without_the_subpackage():
    code = "import sys; sys.modules['rasterlake.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'slope_horn' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'op1_ngram_jaccard_join' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_registered_queries_run_on_whole_tables(spark):
    import __spark_entry__ as e

    tables = {"op6": "pages", "op9": "pages", "op10": "embeddings"}
    found = {k: f for k, f in e.queries().items() if k.startswith("op")}
    assert sorted(int(k[2:].split("_")[0]) for k in found) == list(range(1, 11))
    for k, f in found.items():
        n, op = f(spark, BASE).count(), k.split("_")[0]
        table = spark.read.parquet(f"{BASE}/{tables.get(op, 'documents')}.parquet")
        assert n == (10 * table.where("vec_id % 100 = 0").count() if op == "op10" else table.count())
