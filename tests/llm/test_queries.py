"""The queries opN_* column by column: against SQL where there is some, else against plain Python over whole tables."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from rasterlake.llm import media, queries
from test_operators import brute_posteriors

BASE = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{BASE}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    found.no_truncation()
    found.no_padding()
    return found


def result(spark, name):
    rows = queries.queries()[name](spark, BASE).collect()
    key = rows[0].__fields__[0] if rows else None
    assert len({r[key] for r in rows}) == len(rows)
    return {r[key]: r for r in rows}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{BASE}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    df = queries.queries()[name](spark, BASE)
    assert sorted(df.columns) == sorted(cols)
    order = lambda rows: sorted(rows, key=lambda t: tuple((x is not None, str(x)) for x in t))
    assert order([tuple(r[c] for c in cols) for r in df.collect()]) == order(cur.fetchall())


def test_op2(spark, documents):
    got = result(spark, "op2_media_columns")
    assert set(got) == set(documents)
    for i, text in documents.items():
        raw, r = text.encode(), got[i]
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        stored = media.encode_image(payload, len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest())
        pixels, notes = media.decode_image(stored)
        assert pixels.tobytes() == payload and int(notes["n_bytes"]) == len(raw) and r.feature == media.feature_of(pixels)


def test_op3_and_op5(spark, documents, library):
    counts, coded = result(spark, "op3_token_counts"), result(spark, "op5_bpe_encode_decode")
    assert set(counts) == set(coded) == set(documents)
    for i, text in documents.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len(text.encode()), len(ids), len(ids) > 512)
        back = library.decode(ids, skip_special_tokens=False)
        assert (coded[i].n_tokens, coded[i].ids_sha256, coded[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_op4(spark, documents):
    got, seen = result(spark, "op4_suffix_dedup"), set()
    for i in sorted(documents):
        raw = documents[i].encode()
        marks = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                marks[k : k + 100] = True
            seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[~marks[:-1]])
        spans = int((marks[:-1] & ~np.concatenate([[False], marks[:-1]])[: len(raw)]).sum()) if raw else 0
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())


def test_op7(spark):
    got = result(spark, "op7_quality_classifier")
    docs = spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id", "source", "lang").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{BASE}/labels.parquet").collect()}
    prior, hosts, paths = brute_posteriors([(r.doc_id, r.source, r.lang) for r in docs], labels)
    for r in docs:
        g, p = got[r.doc_id], paths[r.source, r.lang]
        odds = g.evidence + np.log(p / (1 - p)) - np.log(prior / (1 - prior))
        assert (g.host_posterior, g.path_posterior) == (pytest.approx(hosts[r.source]), pytest.approx(p)) and g.quality == pytest.approx(1 / (1 + np.exp(-odds))) and g.keep == (g.quality >= 0.5)


def test_op8(spark):
    got = result(spark, "op8_source_mixing")
    docs = spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id", "source", "text").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    of = {r.doc_id: r.source for r in docs}
    order = sorted({r.source for r in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for i, n in size.items() if of[i] == s) for s in order}
    weight, target, free = {s: 1 + k % 3 for k, s in enumerate(order)}, {}, set(order)
    while free:
        left = sum(size.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * total[s] for s in over}
        free -= over
    taken = dict.fromkeys(order, 0)
    for i, r in got.items():
        s = of[i]
        assert (r.size, r.source_size, r.target) == (size[i], total[s], pytest.approx(target[s])) and 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[s] += r.taken
    largest = {s: max(n for i, n in size.items() if of[i] == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= max(0.5 * largest[s], 1) for s in order)


def test_op10(spark):
    rows = queries.queries()["op10_nearest_neighbours"](spark, BASE).collect()
    x = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{BASE}/embeddings.parquet").collect() if r.embedding}
    ids, m = np.array(sorted(x)), np.array([x[i] for i in sorted(x)])
    found, hits, asked = {}, 0, 0
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == {i for i in x if i % 100 == 0}
    for q, got in found.items():
        d = np.sqrt(((m - x[q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        assert [r.rank for r in got] == list(range(1, 11)) and [(r.score, r.vec_id) for r in got] == sorted((r.score, r.vec_id) for r in got)
        assert all(r.score == pytest.approx(float(np.sqrt(((x[r.vec_id] - x[q]) ** 2).sum())), rel=1e-12) for r in got)
        hits, asked = hits + len(best & {r.vec_id for r in got}), asked + 10
    assert hits / asked >= 0.9
