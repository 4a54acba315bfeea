"""Small fixtures against brute force, with the odd rows that every operator must stand."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from rasterlake.llm import ann, bpe, common, media, mixing, ngram_join, quality, suffix_dedup, url_filters, warc

TOKENIZER = "byte_bpe_50k.json"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("id", T.StringType()), T.StructField("key", T.StringType()), T.StructField("h", T.StringType()), T.StructField("size", T.StringType())])


def corpus(seed=3, n=60):
    """Texts with copies, near copies, shared passages, none, blanks, odd characters and a very long one."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    passage = " ".join(rnd.choice(words) for _ in range(40))
    out = []
    for i in range(n):
        kind = i % 6
        own = [rnd.choice(words) for _ in range(rnd.randint(1, 80))]
        if kind == 1 and out:
            own = (out[rnd.randrange(len(out))] or "").split(" ")
        if kind == 2 and out:
            own = (out[rnd.randrange(len(out))] or "x").split(" ")
            own[rnd.randrange(len(own))] = "Edited"
        text = " ".join(own)
        out.append(text[: len(text) // 2] + " " + passage + " " + text[len(text) // 2 :] if kind == 3 else text)
    out += [None, "", "  \n\t ", "one", "ONE", "one two", "naïve Ünïcode \U0001f600   x", "ab " * 400, "ab " * 400, " ".join(rnd.choice(words) for _ in range(6000)), "<|endoftext|> a<|endoftext|>", "'s 't  x\n\n y"]
    return out


def frame(spark, texts, ids=None):
    rnd = random.Random(5)
    return spark.createDataFrame([((ids or range(len(texts)))[i], t, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "c", None, "Z"]), 1, "x", "y", "z", "w") for i, t in enumerate(texts)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, rows that share an id, and rows without one."""
    texts = corpus(4, 30)
    return frame(spark, texts + texts[:3] + [texts[7], texts[8], None], [*range(len(texts)), 0, 1, 2, 5, None, None]).cache()


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


# ---------------------------------------------------------------- shared


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3), (3, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = common.connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r.node: r.component for r in got.collect()} == {x: find(x) for x in list(parent)}
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# ---------------------------------------------------------------- 1


def shingles(text, k):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(data, k, num, den):
    sets = [shingles(t, k) for _, t in data]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(data)]


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80), (1, 50), (2, 30)])
def test_jaccard_join(spark, docs, odd, k, num):
    for df in (docs, odd):
        data = [(r.doc_id, r.text) for r in df.collect()]
        got = rows(ngram_join.jaccard_components(df, k, num, 100), "id", "n_shingles", "component_id")
        assert got == sorted(brute_components(data, k, num, 100), key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def thue_morse(bits):
    s = "a"
    for _ in range(bits):
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_jaccard_join_chosen_words(spark):
    """Words on which sums of powers modulo 2**64 collide whatever the base, alone and among others."""
    flip = str.maketrans("ab", "ba")
    texts = []
    for bits in (10, 11):
        w = thue_morse(bits)
        texts += [w, w.translate(flip), f"{w} {w.translate(flip)}", f"x y {w} z", f"x y {w.translate(flip)} z"]
    data = list(enumerate(texts))
    df = spark.createDataFrame(data, "doc_id long, text string")
    for k in (1, 3):
        got = rows(ngram_join.jaccard_components(df, k, 90, 100), "id", "n_shingles", "component_id")
        assert got == sorted(brute_components(data, k, 90, 100))


@pytest.mark.parametrize("num", [30, 50, 67])
def test_jaccard_join_low_thresholds(spark, monkeypatch, num):
    """Small sets of frequent shingles, and partners several size bands apart; buckets in parts."""
    monkeypatch.setattr(ngram_join, "PART", 16)
    monkeypatch.setattr(ngram_join, "BUCKET", 16)
    rnd = random.Random(num)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rnd.sample(words[:4], rnd.randint(1, 3))) for _ in range(150)]
    for _ in range(6):
        base = rnd.sample(words, 100)
        texts += [" ".join(base[:n]) for n in (31, 34, 60, 90, 100)]
    data = list(enumerate(texts))
    got = rows(ngram_join.jaccard_components(spark.createDataFrame(data, "doc_id long, text string"), 1, num, 100), "id", "n_shingles", "component_id")
    assert got == sorted(brute_components(data, 1, num, 100))


def test_jaccard_join_near_copies(spark, monkeypatch):
    """A group of near copies around the threshold, compared in parts and with its buckets taken as one."""
    monkeypatch.setattr(ngram_join, "PART", 16)
    monkeypatch.setattr(ngram_join, "BUCKET", 16)
    rnd = random.Random(9)
    base = [f"v{i}" for i in range(120)]
    data = []
    for i in range(150):
        own = list(base)
        for _ in range(rnd.randint(0, 4)):
            own[rnd.randrange(len(own))] = f"e{rnd.randrange(10**6)}"
        data.append((i, " ".join(own)))
    got = rows(ngram_join.jaccard_components(spark.createDataFrame(data, "doc_id long, text string"), 3, 90, 100), "id", "n_shingles", "component_id")
    assert got == sorted(brute_components(data, 3, 90, 100))
    assert len({r[2] for r in got}) > 3


def test_jaccard_join_equal_half_keys(spark, monkeypatch):
    """Sets that share the first half of their key are kept apart by the second."""
    sets = spark.createDataFrame([(1, 3, 7, 1, [1]), (2, 3, 7, 2, [2]), (3, 3, 8, 1, [3]), (4, 3, 7, 1, [1])], "id long, n long, key long, key2 long, tokens array<long>")
    got = {r.id: r.key for r in ngram_join._told_apart(sets, spark.createDataFrame([(7,)], "key long")).collect()}
    assert got[1] == got[4] != got[2] and got[3] == 8 and got[1] != 7


def test_jaccard_join_frequent_classes(spark, monkeypatch):
    """Pairs and triples of frequent shingles find what single rare ones find, and cut buckets lose nothing."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(120):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 8])):
            w[rnd.randrange(120)] = f"x{rnd.randrange(30)}"
        texts.append(" ".join(w))
    data = list(enumerate(texts))
    monkeypatch.setattr(ngram_join, "RARE", 3)
    monkeypatch.setattr(ngram_join, "BUCKET", 16)
    got = rows(ngram_join.jaccard_components(spark.createDataFrame(data, "doc_id long, text string"), 3, 90, 100), "id", "n_shingles", "component_id")
    assert got == sorted(brute_components(data, 3, 90, 100))


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert ngram_join.jaccard_components(none).count() == 0
    assert media.media_columns(none).count() == 0
    assert bpe.token_counts(none, TOKENIZER).count() == 0
    assert suffix_dedup.repeated_substrings(none).count() == 0
    assert bpe.bpe_decode(bpe.bpe_encode(none, TOKENIZER), TOKENIZER).count() == 0
    assert mixing.mix_sources(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify_quality(none, quality.train(none, labels)).count() == 0
    assert ann.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.pages_through_archives(pages).count() == 0
    rules = spark.createDataFrame([("block", "a.com", "/")], "verdict string, host string, path string")
    assert url_filters.url_verdicts(pages, rules, url_filters.page_links(pages)).count() == 0


# ---------------------------------------------------------------- 2


def test_media_round_trip(spark, docs, odd):
    for df in (docs, odd):
        expected = []
        for r in df.collect():
            raw = (r.text or "").encode()
            padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
            expected.append((r.doc_id, len(raw), hashlib.sha256(padded).hexdigest()))
        got = media.media_columns(df).withColumn("sha", F.sha2("payload", 256))
        assert rows(got, "id", "n_bytes", "sha") == sorted(expected, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))
    by = {}
    for r in media.media_columns(docs).collect():
        by.setdefault(bytes(r.payload), set()).add((bytes(r.media), r.feature))
    assert all(len(v) == 1 for v in by.values())


def test_media_ranges_retry_and_damage(spark, docs, tmp_path, monkeypatch):
    folder, manifest = media.write_media(docs)
    spark.dataSource.register(media.ArchiveSource)
    small = spark.read.format("archive").option("path", folder).option("manifest", manifest).option("rangeBytes", 700).load()
    assert small.rdd.getNumPartitions() > 10 and small.count() == docs.count() and small.select("archive", "offset").distinct().count() == docs.count()
    assert spark.read.format("archive").option("path", folder).load().count() == docs.count()
    reader = media.ArchiveReader({"path": folder, "manifest": manifest, "tries": "3"})
    part, calls, real = reader.partitions()[0], [], media.ArchiveReader._member

    def flaky(file, m):
        calls.append(m.header_offset)
        if calls.count(m.header_offset) == 1:
            raise OSError("lost")
        return real(file, m)

    monkeypatch.setattr(media.ArchiveReader, "_member", staticmethod(flaky))
    got = [r for b in reader.read(part) for r in b.to_pylist()]
    assert got and all(r["attempts"] == 2 for r in got) and all(calls.count(r["offset"]) == 2 for r in got)
    monkeypatch.setattr(media.ArchiveReader, "_member", staticmethod(real))
    path = (folder + "/" + reader._names()[0]).removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[200] ^= 255
    open(path, "wb").write(bytes(data))
    with pytest.raises((OSError, ValueError)):
        list(reader.read(part))
    with pytest.raises(ValueError):
        media.decode_image(media.encode_image(b"a" * 576, 3)[:-20] + b"0" * 20)


# ---------------------------------------------------------------- 3 and 5


def test_tokens_match_the_library(spark, docs, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path(TOKENIZER))
    for df in (docs, odd):
        data = [(r.doc_id, r.text) for r in df.collect()]
        coded = library.encode_batch([t or "" for _, t in data], add_special_tokens=False)
        key = lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t)
        got = rows(bpe.token_counts(df, TOKENIZER), "id", "n_bytes", "n_tokens")
        assert got == sorted([(d, len((t or "").encode()), len(e.ids)) for (d, t), e in zip(data, coded)], key=key)
        both = bpe.bpe_decode(bpe.bpe_encode(df, TOKENIZER), TOKENIZER)
        got = sorted(((r.doc_id, tuple(r.ids), r.decoded) for r in both.collect()), key=lambda t: (t[0] is None, t[0] or 0, t[1]))
        assert got == sorted([(d, tuple(e.ids), library.decode(e.ids, skip_special_tokens=False)) for (d, _), e in zip(data, coded)], key=lambda t: (t[0] is None, t[0] or 0, t[1]))
        assert {"lang", "key", "size"} <= set(both.columns)


def test_pre_tokens_of_odd_characters():
    b, rnd = bpe.loaded(TOKENIZER), random.Random(2)
    for _ in range(300):
        t = "".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x80, 0x3000), rnd.randrange(0xA000, 0xD7FF), rnd.randrange(0x10000, 0x1FFFF), 32, 10])) for _ in range(40))
        assert list(b.encode(t)) == b.library.encode(t, add_special_tokens=False).ids


def test_chunks_do_not_change_counts(spark, docs, monkeypatch):
    whole = rows(bpe.token_counts(docs, TOKENIZER), "id", "n_tokens")
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 500)
    assert rows(bpe.token_counts(docs, TOKENIZER), "id", "n_tokens") == whole


# ---------------------------------------------------------------- 4


def brute_repeats(data, length):
    seen, out = set(), {}
    for d, raw in sorted(data):
        marks = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                marks[i : i + length] = True
            seen.add(w)
        out[d] = bytes(np.frombuffer(raw, np.uint8)[~marks])
    return out


@pytest.mark.parametrize("length", [10, 40, 100])
def test_suffix_dedup(spark, docs, length, monkeypatch):
    expected = brute_repeats([(r.doc_id, (r.text or "").encode()) for r in docs.collect()], length)
    for most in (4096, 3):
        monkeypatch.setattr(suffix_dedup, "MOST", most)
        got = suffix_dedup.repeated_substrings(docs, length, carry=("lang", "id", "h"))
        found = {r[0]: r for r in got.collect()}
        assert {d: bytes(r.kept) for d, r in found.items()} == expected
        assert all(r.n_removed == r.n_bytes - len(r.kept) == sum(s.end - s.start for s in r.spans) for r in found.values())


def test_suffix_dedup_odd_rows(spark, odd):
    got = suffix_dedup.repeated_substrings(odd, 30, as_text=True).collect()
    assert len(got) == odd.count() and sum(r.id is None for r in got) == 2
    assert len({(r.id, r.kept) for r in got if r.id in (0, 1, 2)}) == 3


def test_equal_windows_against_a_dictionary():
    rnd = random.Random(4)
    for _ in range(20):
        parts = [bytes(rnd.choice(b"ab\x00\xff") for _ in range(rnd.randint(1, 60))) for _ in range(rnd.randint(1, 12))]
        for length in (1, 3, 9):
            seg, off, kind = suffix_dedup.equal_windows(parts, length)
            text = [parts[s][o : o + length] for s, o in zip(seg, off)]
            assert len(text) == sum(max(0, len(p) - length + 1) for p in parts)
            pairs = set(zip(text, kind.tolist()))
            assert len(pairs) == len(set(text)) == len(set(kind.tolist()))


# ---------------------------------------------------------------- 6


def test_url_filters(spark):
    pages = spark.createDataFrame(
        [(1, "http://A.example.com/en/x?q"), (2, "https://www.example.com/en/"), (3, "nope"), (4, None), (5, "http://b.org/1"), (6, "http://b.org/2"), (7, "http://c.org/3"), (8, "http://d.org#f"), (9, "http://e.org/"), (None, "http://b.org/1"), (5, "http://b.org/1"), (10, "http://notexample.com/en/")],
        "page_id long, url string",
    ).withColumn("verdict", F.lit("clash"))
    rules = spark.createDataFrame([("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "b.org", "/2"), ("allow", "e.org", "/"), (None, None, "/")], "verdict string, host string, path string")
    links = spark.createDataFrame([("http://b.org/1", "http://c.org/3"), ("http://b.org/2", "http://c.org/3"), ("http://e.org/", "http://d.org#f"), (None, "x"), ("http://b.org/2", "http://d.org#f2")], "src string, dst string")
    got = {(r.id, r.host): (r.path, r.rule, r.verdict) for r in url_filters.url_verdicts(pages, rules, links).collect()}
    assert got[1, "a.example.com"] == ("/en/x", "example.com/en/", "block") and got[2, "www.example.com"] == ("/en/", "www.example.com/en/", "allow")
    assert got[3, ""] == got[4, ""] == ("", None, "allow") and got[6, "b.org"] == ("/2", "b.org/2", "block")
    assert got[5, "b.org"] == ("/1", None, "block") and got[7, "c.org"] == ("/3", None, "block") and got[None, "b.org"][2] == "block"
    assert got[8, "d.org"] == ("", None, "allow") and got[10, "notexample.com"][2] == "allow"
    assert url_filters.url_verdicts(pages, rules, links).count() == 12


def test_page_links(spark):
    html = ['<LINK href="/new" rel="canonical">', "<link rel=canonical href='https://o.org/z'>", '<meta http-equiv="Refresh" content="0; URL=//p.org/q">', "<p>canonical refresh</p>", None]
    pages = spark.createDataFrame([(f"http://a.org/{i}", h) for i, h in enumerate(html)], "url string, html string")
    got = {(r.src, r.dst) for r in url_filters.page_links(pages).collect()}
    assert got == {("http://a.org/0", "http://a.org/new"), ("http://a.org/1", "https://o.org/z"), ("http://a.org/2", "http://p.org/q")}


# ---------------------------------------------------------------- 7


def test_quality_on_held_out_labels(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    half = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    rest = labels.join(half.select("doc_id"), "doc_id", "left_anti")
    got = quality.classify_quality(docs, quality.train(docs, half)).withColumnRenamed("id", "doc_id").join(rest, "doc_id")
    right = got.agg(F.avg((F.col("keep").cast("int") == rest["quality"]).cast("int"))).first()[0]
    kept = got.where(rest["quality"] == 1).agg(F.avg(F.col("keep").cast("int"))).first()[0]
    assert right > 0.97 and kept > 0.98


def test_quality_shrinks_sparse_hosts(spark, odd):
    w = np.zeros(len(quality.NAMES))
    w[quality.NAMES.index("words")] = 1.0
    data = [(i, "word " * (1 if i < 30 else 60), "bad" if i < 30 else "good", "p") for i in range(90)] + [(90, "word", "rare", "p"), (91, "word", None, None)]
    got = {r.id: r for r in quality.classify_quality(spark.createDataFrame(data, "doc_id long, text string, source string, lang string"), w).collect()}
    mean = np.mean([1 / (1 + np.exp(-r.evidence)) for r in got.values()])
    assert got[0].host_posterior < mean < got[40].host_posterior
    assert abs(got[90].host_posterior - mean) < abs(got[0].host_posterior - mean)
    assert quality.classify_quality(odd, w).count() == odd.count()


# ---------------------------------------------------------------- 8


def test_targets_against_resharing(spark):
    rnd = random.Random(6)
    for case in range(4):
        sizes = {s: rnd.choice([0, 1, 5, 200, 1000]) for s in ["a", "B", "z", None, "\U0001f600", "é"][: case + 3]}
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
        total, target, free = sum(sizes.values()), {}, set(order)
        while free:
            left = total - sum(target.values())
            share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            over = {s for s in free if share[s] > 3 * sizes[s]}
            if not over:
                target |= share
                break
            target |= {s: 3.0 * sizes[s] for s in over}
            free -= over
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == pytest.approx(target)


def test_mixing(spark, odd, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 40)
    rnd = random.Random(8)
    data = [(i, " ".join("w" * rnd.choice([3, 7, 20, 150])), rnd.choice(["a", "b", "b", "b", None])) for i in range(600)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix_sources(df).collect()
    assert len(got) == 600 and all(0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 75  # half the largest document
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted((r.id, r.taken) for r in got) == sorted((r.id, r.taken) for r in again)
    assert mixing.mix_sources(odd).count() == odd.count()


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    p, size = rng.random(500), rng.integers(1, 1000, 500)
    q = mixing.flight(p, size, rng)
    left = (q > 0) & (q < 1)
    assert left.sum() <= 2 and q.sum() == pytest.approx(p.sum()) and (q * size).sum() == pytest.approx((p * size).sum())
    assert set(np.unique(mixing.landing(q, size))) <= {0.0, 1.0}


# ---------------------------------------------------------------- 9


@pytest.mark.parametrize("version", [1, 2])
def test_pages_through_archives(spark, version, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 300)
    data = [(1, "http://a b/é", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n"), (6, "u", "y" * 5000), (None, "n", "x"), (6, "u", "y" * 5000), (7, "u", "HTTP/1.1 200 OK\r\n\r\nz")]
    got = warc.pages_through_archives(spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(2), version).collect()
    assert len(got) == len(data)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for i, _, html in data:
        for r in by[i]:
            assert (r.payload_digest, r.payload_bytes) == (digest(html), len((html or "").encode()))
    kinds = {i: sorted((r.record_type, r.refers_to_page) for r in v) for i, v in by.items()}
    assert kinds[2] == [("response", None)] and kinds[1] == kinds[None] == [("revisit", 2)]
    assert kinds[3] == [("revisit", 4)] and kinds[4] == [("response", None)] and kinds[6] == [("response", None), ("revisit", 6)]
    assert {bytes(r.payload) for r in got if r.page_id in (5, 7)} == {t.encode() for i, _, t in data if i in (5, 7)}
    assert len({r.record_id for r in got}) == len(got)


def test_arc_lines():
    v1 = warc.arc_version_block("n.arc", 1, "20010203040506") + warc.arc_record("http://a/", "1.2.3.4", "20010203", "text/html", b"HTTP/1.0 200\r\nA: b\r\n\r\nhello", 1) + warc.arc_record("http://b/", "1.2.3.4", "20010203040506", "text/plain", b"plain", 1)
    for data in (v1, zlib.compress(b"")[:0] + v1):
        one, two = warc.read_arc(data)
        assert (one.url, one.ip, one.content_type) == ("http://a/", "1.2.3.4", "text/html") and warc.split_http(one.body)[2] == b"hello"
        fields, block = next(warc.read_warc(warc.convert_record(one, "n.arc")))
        assert fields["warc-type"] == "response" and fields["warc-date"] == "2001-02-03T00:00:00Z" and block == one.body
        fields, block = next(warc.read_warc(warc.convert_record(two, "n.arc")))
        assert fields["warc-type"] == "resource" and block == b"plain" and fields["warc-payload-digest"] == "sha1:" + warc.sha1_base32(b"plain")
    with pytest.raises(ValueError):
        list(warc.read_arc(v1[:-3]))


# ---------------------------------------------------------------- 10


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 24)).astype(np.float32)
    x[50] = x[100]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2100, [0.0] * 24), (2200, [float("nan")] + [1.0] * 23), (2300, [None] + [1.0] * 23), (2400, [1.0]), (None, [1.0] * 24), (100, x[100].tolist()), (2500, [float("inf")] + [1.0] * 23)]
    monkeypatch.setattr(ann, "SHARD", 700)
    monkeypatch.setattr(ann, "QUERIES", 8)
    got = ann.nearest_neighbours(spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0)), 10, 100).collect()
    by, hits = {}, 0
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 2000, 100))
    for q, found in by.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in found] == sorted((d[r.vec_id], r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & set(np.lexsort((np.arange(2000), d))[:10].tolist()))
    assert hits / 200 >= 0.9 and by[100][0].vec_id == 50 and by[100][0].score == 0
    few = ann.nearest_neighbours(spark.createDataFrame(data[:4], "vec_id long, embedding array<float>"), 10, 2).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(0, 1), (0, 2), (0, 3), (2, 1), (2, 2), (2, 3)]


# ---------------------------------------------------------------- links between pages, hierarchies, names


def test_alias_targets():
    """References of every kind, attributes in any order, all tags of a page, what isn't markup left out."""
    at = "http://Ex.org/a/b.html?q=1"
    cases = {
        "<link rel=canonical href='2.html'>": ["http://Ex.org/a/2.html"],
        '<link href="../c/./d?x=1&amp;y=2#f" rel="nofollow Canonical">': ["http://Ex.org/c/d?x=1&y=2#f"],
        '<link rel="canonical" href="?p=1">': ["http://Ex.org/a/b.html?p=1"],
        '<meta content="0;url=/z" http-equiv="refresh">': ["http://Ex.org/z"],
        "<META HTTP-EQUIV=refresh CONTENT=\"5; URL='//p.org/q'\">": ["http://p.org/q"],
        '<link rel=canonical href=/one><link rel="canonical" href="/two"><link rel=canonical href=/one>': ["http://Ex.org/one", "http://Ex.org/two"],
        '<base href="http://o.org/x/"><link rel=canonical href=y>': ["http://o.org/x/y"],
        "<!-- <link rel=canonical href=/no> --><script>'<link rel=canonical href=/no>'</script><p title='<link rel=canonical href=/no>'>": [],
        '<link rel="alternate canonicals" href="/no"><meta http-equiv="refresh" content="30">': [],
        '<link rel=canonical href="mailto:a@b"><link rel=canonical href="http://[x"><link rel=canonical>': [],
        '<link data-x="a>b" rel=canonical href=/yes>': ["http://Ex.org/yes"],
    }
    for page, expected in cases.items():
        assert url_filters.alias_targets(at, page) == expected, page


def test_aliases_through_pages(spark):
    """Chains and conflicts over relative links, other spellings of a host and fragments, against a walk in Python."""
    rules = spark.createDataFrame([("block", "bad.org", "/"), ("allow", "good.org", "/")], "verdict string, host string, path string")
    pages = [
        (1, "http://a.org/1.html", "<link rel=canonical href='2.html'>"), (2, "http://A.org/2.html#top", '<meta content="0;url=/3" http-equiv="refresh">'), (3, "http://a.org:80/3", "<link rel=canonical href=//bad.org/x>"),
        (4, "http://b.org", "<link href='http://bad.org/y' rel=canonical><link href='http://good.org/' rel=canonical>"), (5, "http://b.org/#f", None), (6, "http://c.org/", ""), (7, "http://bad.org/x", ""), (8, None, "<link rel=canonical href=/q>"),
        (9, "http://d.org/", "<link rel=canonical href='http://c.org/?#'>"), (9, "http://d.org/", "<link rel=canonical href='http://c.org/?#'>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = rows(url_filters.url_verdicts(df, rules, url_filters.page_links(df)), "id", "verdict", "rule")
    block, allow = "block", "allow"
    assert got == [(1, block, None), (2, block, None), (3, block, None), (4, allow, None), (5, allow, None), (6, allow, None), (7, block, "bad.org/"), (8, allow, None), (9, allow, None), (9, allow, None)]


def brute_posteriors(data, labels):
    """data: (id, host, path); labels: id -> 0 or 1. The posteriors of each host and path by plain sums."""
    share = lambda s, n, k, p: (s + k * p) / (n + k)

    def worth(groups):  # (s, n, prior)
        n = sum(g[1] for g in groups)
        if not n:
            return 10000.0
        spread = sum(g[1] * (g[0] / g[1] - g[2]) ** 2 for g in groups if g[1]) / n
        chance = sum(g[2] * (1 - g[2]) for g in groups if g[1]) / n
        base = sum(g[1] * g[2] * (1 - g[2]) for g in groups) / n
        return min(max(base / max(spread - chance, 1e-9) - 1, 2.0), 10000.0)

    sums = {}
    for i, host, path in data:
        s, n = sums.get((host, path), (0, 0))
        sums[host, path] = (s + labels.get(i, 0), n + (i in labels))
    total = sum(n for _, n in sums.values())
    prior = sum(s for s, _ in sums.values()) / total if total else 0.5
    hosts = {}
    for (host, _), (s, n) in sums.items():
        a, b = hosts.get(host, (0, 0))
        hosts[host] = (a + s, b + n)
    k = worth([(s, n, prior) for s, n in hosts.values()])
    of_host = {h: share(s, n, k, prior) for h, (s, n) in hosts.items()}
    k = worth([(s, n, of_host[h]) for (h, _), (s, n) in sums.items()])
    return prior, of_host, {(h, p): share(s, n, k, of_host[h]) for (h, p), (s, n) in sums.items()}


def test_quality_posteriors_and_flips(spark):
    """Every posterior by plain sums, and one text that one host's labels let in and another's keep out."""
    rnd = random.Random(3)
    data = [(i, f"h{rnd.randrange(5)}", rnd.choice(["p", "q", None])) for i in range(400)] + [(400 + i, "bad", "p") for i in range(60)] + [(460 + i, "good", "p") for i in range(60)] + [(600, None, None), (601, "new", "p"), (None, "good", "p")]
    labels = {i: int(rnd.random() < 0.6) for i in range(0, 400, 3)} | {400 + i: int(i % 12 == 0) for i in range(40)} | {460 + i: int(i % 12 != 0) for i in range(40)}
    w = np.zeros(len(quality.NAMES))
    w[0] = 0.2
    docs = spark.createDataFrame([(i, "the same words", h, p) for i, h, p in data], "doc_id long, text string, source string, lang string")
    known = spark.createDataFrame([(i, y) for i, y in labels.items()] + [(5, None), (7, 3), (None, 1)], "doc_id long, quality int")
    got = quality.classify_quality(docs, w, labels=known).collect()
    prior, hosts, paths = brute_posteriors(data, labels)
    assert len(got) == len(data)
    by_id = {r.id: r for r in got}
    for i, h, p in data:
        r = by_id[i]
        assert r.evidence == pytest.approx(0.2) and r.host_posterior == pytest.approx(hosts[h]) and r.path_posterior == pytest.approx(paths[h, p])
        odds = 0.2 + np.log(paths[h, p] / (1 - paths[h, p])) - np.log(prior / (1 - prior))
        assert r.quality == pytest.approx(1 / (1 + np.exp(-odds))) and r.keep == (r.quality >= 0.5)
    assert not by_id[450].keep and by_id[510].keep and by_id[601].keep


def test_heavy_groups_meet_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(common, "HEAVY", 3)
    data = [(i, "hot" if i % 2 else f"k{i % 7}") for i in range(100)] + [(200, "none")]
    left = spark.createDataFrame(data, "i long, a string")
    counts = left.where("a <> 'none'").groupBy(F.col("a").alias("b")).count()
    got = common.grouped_join(left, counts, F.col("a") == F.col("b"), "count")
    assert rows(got, "i", "count") == rows(left.join(counts, F.col("a") == F.col("b")), "i", "count")


def test_carried_names(spark, odd):
    got = quality.classify_quality(odd.withColumn("quality", F.lit("c")).withColumn("host", F.lit("d")), np.zeros(len(quality.NAMES)), carry=("quality", "host", "id", "source"))
    assert got.columns == ["id", "carried_quality", "host", "carried_id", "source", "evidence", "host_posterior", "path_posterior", "quality", "keep"]
    assert {(r.carried_quality, r.host, r.carried_id) for r in got.collect()} == {("c", "d", "x")}
    got = suffix_dedup.repeated_substrings(odd, 40, carry=("id", "h"))
    assert got.columns[:3] == ["id", "carried_id", "h"] and {(r.carried_id, r.h) for r in got.collect()} == {("x", "z")}


def test_repeats_chosen_texts(spark):
    """Long texts on which sums of powers modulo 2**64 collide are no repeats of one another."""
    flip = str.maketrans("ab", "ba")
    w = thue_morse(11)
    texts = [f"{w} one", f"{w.translate(flip)} two"]
    got = {r.id: r.n_removed for r in suffix_dedup.repeated_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 1500).collect()}
    expected = {i: len(t.encode()) - len(raw) for (i, t), raw in zip(enumerate(texts), brute_repeats([(i, t.encode()) for i, t in enumerate(texts)], 1500).values())}
    assert got == expected
    with pytest.raises(ValueError):
        suffix_dedup.repeated_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 40_000)


def test_repeats_of_hot_anchors(spark, monkeypatch):
    """A line in most texts with other words around it, met in several batches of a task, with a short memory and a long one."""
    rnd = random.Random(21)
    line = "this line is in nearly all of the texts that there are here"
    texts = []
    for i in range(240):
        around = " ".join(rnd.choice(["aa", "bb"]) for _ in range(12))
        texts.append(f"{around} {line} {around}" if i % 3 else f"{i} {line} {rnd.random()}")
    data = list(enumerate(texts))
    expected = brute_repeats([(i, t.encode()) for i, t in data], 50)
    for small in (True, False):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
        monkeypatch.setattr(suffix_dedup, "prepare", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20") if small else common.prepare(s))
        got = suffix_dedup.repeated_substrings(spark.createDataFrame(data, "doc_id long, text string").repartition(3), 50)
        assert {r.id: bytes(r.kept) for r in got.collect()} == expected
