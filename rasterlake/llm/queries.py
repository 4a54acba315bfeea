"""The queries opN_<name> and pipeline, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(_read(spark, sf_dir, "documents"), k=3, num=90, den=100).withColumnRenamed("id", "doc_id")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    found = media_columns(_read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )  # fmt: skip


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import token_counts

    found = token_counts(_read(spark, sf_dir, "documents"), "byte_bpe_50k.json")
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_substrings

    found = repeated_substrings(_read(spark, sf_dir, "documents"), min_len=100)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_decode, bpe_encode

    name = "byte_bpe_50k.json"
    found = bpe_decode(bpe_encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), name).drop("text"), name)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: The rules of op6: verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import page_links, url_verdicts

    pages = _read(spark, sf_dir, "pages")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return url_verdicts(pages, rules, page_links(pages)).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify_quality, train

    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return classify_quality(docs, train(docs, labels), labels=labels).withColumnRenamed("id", "doc_id")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import pages_through_archives

    found = pages_through_archives(_read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest_neighbours

    return nearest_neighbours(_read(spark, sf_dir, "embeddings"), k=10, every=100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_HOST = r"translate(CASE WHEN contains({0}, '://') THEN regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1) ELSE '' END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"CASE WHEN contains({0}, '://') THEN regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END"
_Q = r"[\x22\x27]"

#: Links by the same tags, classes by the set of URLs that reach one another, rules by a join on suffix and prefix.
OP6_SQL = rf"""WITH RECURSIVE rules AS (SELECT * FROM (VALUES {", ".join(str(r) for r in RULES)}) t(own, rh, rp)),
tags AS (SELECT url, coalesce(
  nullif(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*{_Q}?canonical{_Q}?[^>]*\bhref\s*=\s*{_Q}?([^\x22\x27\s>]+)', 1), ''),
  nullif(regexp_extract(html, '(?is)<link\b[^>]*\bhref\s*=\s*{_Q}?([^\x22\x27\s>]+){_Q}?[^>]*\brel\s*=\s*{_Q}?canonical\b', 1), '')) AS to_ FROM pages WHERE contains(url, '://')
  UNION ALL SELECT url, nullif(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*{_Q}?refresh{_Q}?[^>]*\burl\s*=\s*{_Q}?([^\x22\x27\s>]+)', 1), '') FROM pages WHERE contains(url, '://')),
found AS (SELECT url AS src, CASE WHEN contains(to_, '://') THEN to_ WHEN starts_with(to_, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || to_ WHEN starts_with(to_, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || to_ END AS dst FROM tags WHERE to_ IS NOT NULL),
links AS (SELECT src, dst FROM found WHERE dst IS NOT NULL AND src <> dst),
both_ AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links),
reach AS (SELECT a, a AS b FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON e.a = r.b),
urls AS (SELECT DISTINCT url, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path FROM (SELECT url FROM pages UNION SELECT b FROM reach)),
decided AS (SELECT url, first(rh || rp ORDER BY length(rh || rp) DESC, own, rh || rp) AS rule, first(own ORDER BY length(rh || rp) DESC, own, rh || rp) AS own FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY url),
classes AS (SELECT r.a AS url, bool_or(d.own = 'allow') AS allowed, bool_or(d.own = 'block') AS blocked FROM reach r JOIN decided d ON d.url = r.b GROUP BY r.a)
SELECT p.page_id, {_HOST.format("coalesce(p.url, '')")} AS host, {_PATH.format("coalesce(p.url, '')")} AS path, d.rule, coalesce(d.own, CASE WHEN c.allowed THEN 'allow' WHEN c.blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p LEFT JOIN decided d ON d.url = p.url LEFT JOIN classes c ON c.url = p.url"""


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every two different sets that share a shingle and are near enough in size, counted; classes by the links both ways.
OP1_SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^ 	-]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w)),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM sh GROUP BY doc_id),
reps AS (SELECT k, n, min(doc_id) AS rep FROM sets GROUP BY k, n),
own AS (SELECT rep, n, s FROM reps JOIN sh ON doc_id = rep),
links AS (SELECT a.rep AS a, b.rep AS b FROM own a JOIN own b ON a.s = b.s AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT rep AS a, rep AS b FROM reps UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON e.a = r.b),
least_ AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(sets.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sets USING (doc_id) LEFT JOIN reps ON reps.k = sets.k AND reps.n = sets.n LEFT JOIN least_ ON a = rep"""

#: SHA-1 in base32: five bytes at a time as a number to base 32, whose digits are then named A to Z and 2 to 7.
_B32 = " || ".join(f"translate(to_base(CAST('0x' || substr(h, {i}, 10) AS BIGINT), 32, 8), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')" for i in (1, 11, 21, 31))
OP9_SQL = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_ FROM pages)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = first_ THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_ THEN first_ END AS refers_to FROM p"""


def oracle_sql() -> dict[str, str]:
    """SQL only where it says all and is quick on whole tables; the tests hold the others against brute force.

    Each is worked out as one table first, so that a LIMIT around it does not change how it is planned. That of op6 knows
    links with :// or a leading / and one tag of a kind, which is all that these tables could hold.
    """
    found = {"op1_ngram_jaccard_join": OP1_SQL, "op6_url_filters": OP6_SQL, "op9_warc": OP9_SQL}
    return {k: f"WITH whole AS MATERIALIZED ({sql}) SELECT * FROM whole" for k, sql in found.items()}
