"""From raw documents to token ids in five stages, each an operator of rasterlake.llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterlake.llm import common
from rasterlake.llm.bpe import bpe_decode, bpe_encode
from rasterlake.llm.common import keyed_join, shared_dir
from rasterlake.llm.mixing import mix_sources
from rasterlake.llm.ngram_join import jaccard_components
from rasterlake.llm.quality import classify_quality, train
from rasterlake.llm.suffix_dedup import repeated_substrings

TOKENIZER = "byte_bpe_50k.json"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_earlier: list[str] = []


def _stage(f):
    """A stage's result has been written before the next begins, so what the one before has left can go."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.drop_scratch(spark, _earlier)
        mark = len(common._scratch)
        out = f(spark, docs, sf_dir)
        _earlier.extend(common._scratch[mark:])
        return out

    run.__doc__, run.__name__ = f.__doc__, f.__name__
    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, rejects go.

    Null and empty texts are judged as texts without words, long ones whole; null hosts (source) and paths (lang) are
    groups of their own. Null ids and repeated rows keep or lose each row by itself; a quality at the threshold
    stays. Columns beyond those of documents are dropped. An empty table gives an empty result.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = classify_quality(docs, train(docs, labels), carry=COLUMNS[1:], labels=labels)
    return judged.where("keep").withColumnRenamed("id", "doc_id").select(*COLUMNS)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a Jaccard similarity of 0.8 over five-word shingles, the one with the least id stays.

    A row is known by its id and text, so texts that share an id, or have none, are judged apart; of rows without
    an id one stays only where its component has no id at all. Rows without words are linked with nothing: all stay.
    Long texts are read whole. Columns beyond those of documents are dropped. An empty table gives an empty result.
    """
    key = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text").alias("_key")
    found = common.written(jaccard_components(docs.select("doc_id", "text", key), k=5, num=80, den=100, id_col="_key").where("n_shingles > 0"), "near")
    members = found.select(F.col("id").alias("_key"), F.col("component_id").alias("_component")).distinct()
    names = docs.select(key, "doc_id").distinct().join(members, "_key")
    first = names.groupBy("_component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_key")).alias("first")).select("first._key")
    gone = common.written(members.select("_key").join(first, "_key", "left_anti"), "gone")
    kept = keyed_join(docs.select(*COLUMNS, key), gone, "_key", "left_anti")
    # exact copies under one id have one key: one of them stays
    repeated = common.written(found.groupBy(F.col("id").alias("_key")).count().where("count > 1").select("_key"), "repeated")
    if repeated.limit(1).count():
        same = keyed_join(kept, repeated, "_key", "left_semi").dropDuplicates(["_key"])
        kept = keyed_join(kept, repeated, "_key", "left_anti").unionByName(same)
    return kept.select(*COLUMNS)


@_stage
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that occurred before, in a smaller id or earlier in the text, are cut from the texts.

    What a cut leaves of a character goes too. A null text becomes an empty one; long ones are read whole. Null ids come
    last; rows that share an id are ordered by a hash of their texts, and rows equal in both are cut alike. No
    row goes. Columns beyond those of documents are dropped. An empty table gives an empty result.
    """
    cut = repeated_substrings(docs, min_len=100, carry=("lang", "source"), as_text=True)
    return cut.select(F.col("id").alias("doc_id"), F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of the sources takes it: not at all, or up to three times.

    Texts without words, null ones among them, have size 0 and are never taken. A null source is a source. Rows without
    an id are known by their text; rows that share an id are all taken as often as the one taken most. Long
    texts are counted whole. Columns beyond those of documents are dropped. An empty table gives an empty result.
    """
    known = docs.select(*COLUMNS).withColumn("_id", F.coalesce("doc_id", F.xxhash64("text")))
    copies = mix_sources(known, id_col="_id").groupBy(F.col("id").alias("_id")).agg(F.max("copies").cast("int").alias("copies")).where("copies > 0")
    taken = keyed_join(known, common.written(copies, "copies"), "_id", "inner")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens, ids, round_trip): the token ids, and whether they decode to the text.

    A null text is an empty one: no ids, and true. Long texts are encoded whole; null ids and repeated rows keep their
    rows. An empty table gives an empty result.
    """
    coded = bpe_decode(bpe_encode(docs.select(*COLUMNS), TOKENIZER), TOKENIZER)
    return coded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeats), ("mixing sources to target weights", mixture), ("BPE encoding and decoding", tokens)]

#: The quality model, the draws and the byte pairs have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again; the last is not yet read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{f.__name__}-{uuid.uuid4().hex}"
        f(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
