"""Byte-level BPE: encoding, decoding, and token counts from distinct pre-tokens."""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections import Counter
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import blocks, lean, lists, planned_bytes, prepare, text_column, written

# Fixed value: the published pre-token pattern of this family of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens whose ids a worker remembers; beyond, it starts anew.
CACHE = 250_000
#: Bytes of text that share one dictionary of pre-tokens in token_counts.
CHUNK_BYTES = 32 << 20
#: Bytes of input for each bucket of pre-tokens; from 20,000 buckets on they grow, which tasks that stream them can bear.
BUCKET_BYTES, BUCKETS = 32 << 20, 20_000

_loaded: dict[str, "Bpe"] = {}


def vocabulary_path(name: str) -> str:
    """The place of a public vocabulary file; a path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _later_characters() -> bytes:
    """1 at each character unassigned in the standard library's Unicode version, whose classes libraries disagree on."""
    return bytes(unicodedata.category(chr(c)) == "Cn" for c in range(0x110000))


class _Known(dict):
    """Ids of the pre-tokens met, as bytes of 32-bit integers; what was met lately outlives a clearing."""

    def __init__(self, bpe: "Bpe"):
        self.bpe, self.older = bpe, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = array("i", [self.bpe.special[word]] if word in self.bpe.special else self.bpe.merge(word)).tobytes()
        self[word] = found
        return found

    def trim(self) -> None:
        if len(self) > CACHE:
            self.older = dict(self)
            self.clear()


class Bpe:
    """A vocabulary, its merges, and the encoder over them."""

    def __init__(self, name: str):
        path = vocabulary_path(name)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"] or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or spec["normalizer"] or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path}: only byte-level BPE without normalizer and prefix space")
        if any(x.get(flag) for x in spec["added_tokens"] for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path}: no added tokens that take blanks with them or stand only as words")
        self.path = path
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find = regex.compile(PATTERN).findall
        self.later = _later_characters()
        self.unusual = re.compile("[^\0-\u036f]").search
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = dict(zip(plain, map(chr, plain)))
        for b in range(256):
            shown.setdefault(b, chr(256 + len(shown) - len(plain)))
        byte_of = {c: b for b, c in shown.items()}
        self.byte_ids = [vocab[shown[b]] for b in range(256)]
        self.bytes_of = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in [*vocab.items(), *self.special.items()]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.size = 1 + max(self.bytes_of)
        #: Rank of each pair, known by left id * size + right id, and the id that each rank makes.
        self.ranks = {vocab[a] * self.size + vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.makes = [vocab[a + b] for a, b in pairs]
        of_bytes = [[self.ranks.get(a * self.size + b, -1) for b in self.byte_ids] for a in self.byte_ids]
        self.first_rank = lambda a, b: of_bytes[a][b]
        self.known = _Known(self)

    @cached_property
    def library(self):
        """The library's own tokenizer, where its answer is asked for."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    def pre_tokens(self, text: str) -> tuple[list[str], Counter]:
        """Pre-tokens in order, with special strings among them, and the counts of these."""
        if self.split is None or not any(s in text for s in self.special):
            return self._plain(text), Counter()
        out, seen = [], Counter()
        for x in self.split.split(text):
            if x in self.special:
                out.append(x)
                seen[x] += 1
            elif x:
                out += self._plain(x)
        return out, seen

    def _plain(self, text: str) -> list[str]:
        if text.isascii() or not self.unusual(text) or not any(map(self.later.__getitem__, map(ord, set(text)))):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token: merges leave a heap by rank, then place; the symbols are a doubly linked list.

        now holds the rank that the pair beginning at a place has at present, which tells stale entries.
        """
        raw = word.encode()
        ids = list(map(self.byte_ids.__getitem__, raw))
        n = len(ids)
        if n < 2:
            return ids
        shift = 20 if n < 1 << 20 else n.bit_length()
        place, size, rank, makes = (1 << shift) - 1, self.size, self.ranks.get, self.makes
        now = list(map(self.first_rank, raw, raw[1:]))
        now.append(-1)
        heap = [r << shift | i for i, r in enumerate(now) if r >= 0]
        heapify(heap)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            e = heappop(heap)
            i, r = e & place, e >> shift
            if now[i] != r:
                continue  # stale: one of the two has been merged since
            j = right[i]
            ids[i] = new = makes[r]
            ids[j] = now[j] = -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                now[i] = r = rank(new * size + ids[k], -1)
                if r >= 0:
                    heappush(heap, r << shift | i)
            else:
                now[i] = -1
            h = left[i]
            if h >= 0:
                now[h] = r = rank(ids[h] * size + new, -1)
                if r >= 0:
                    heappush(heap, r << shift | h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> np.ndarray:
        """32-bit ids; every distinct pre-token is merged once as long as the worker remembers it."""
        self.known.trim()
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.pre_tokens(text)[0])), np.int32)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def loaded(name: str) -> Bpe:
    if name not in _loaded:
        _loaded[name] = Bpe(name)
    return _loaded[name]


def _encode(tokenizer: str, text_col: str):
    def run(batches):
        bpe = loaded(tokenizer)
        for batch in batches:
            texts = text_column(batch, text_col)
            off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            for i, j in blocks(off):
                ids = [bpe.encode(t) for t in texts.slice(i, j - i).to_pylist()]
                own = lists(np.concatenate(ids), np.array([len(x) for x in ids]), pa.int32())
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), own], names=[*batch.schema.names, "ids"])

    return lean(run)


def bpe_encode(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """docs and a column ids array<int>: the token ids of each whole text, without added special tokens.

    Null and empty texts have no ids. Rows stay as they are, repeated or not; an own column ids gives way.
    """
    prepare(docs.sparkSession)
    kept = docs.drop("ids")
    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return kept.mapInArrow(_encode(tokenizer, text_col), schema)


def bpe_decode(encoded: DataFrame, tokenizer: str, out_col: str = "decoded") -> DataFrame:
    """encoded and a column of the texts that its ids stand for; null ids decode to an empty text."""

    def run(batches):
        bpe = loaded(tokenizer)
        for batch in batches:
            ids = batch["ids"].fill_null([])
            off = ids.offsets.to_numpy()
            for i in range(0, len(ids), 200):
                edges = off[i : i + 201]
                flat = ids.values[edges[0] : edges[-1]].to_numpy().tolist()
                texts = [bpe.decode(flat[a - edges[0] : b - edges[0]]) for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, len(texts)) for c in batch.columns), pa.array(texts, pa.string())], names=[*batch.schema.names, out_col])

    prepare(encoded.sparkSession)
    kept = encoded.drop(out_col)
    return kept.mapInArrow(lean(run), T.StructType([*kept.schema.fields, T.StructField(out_col, T.StringType())]))


# ---------------------------------------------------------------- counts

_CHUNKS = "chunk long, bucket int, first int, words array<string>, ids array<long>, n_bytes array<long>, extra array<long>, n_words array<int>, codes binary, times binary"


def _chunks(tokenizer: str, buckets: int):
    """Per chunk of texts: one row with the documents' pre-token frequencies, and its dictionary by bucket."""

    def close(chunk, docs, words):
        names = list(words)
        by = np.array([zlib.crc32(w.encode()) % buckets for w in names], np.int64)
        order = np.argsort(by, kind="stable")
        code = np.empty(len(names), np.uint32)
        code[order] = np.arange(len(names), dtype=np.uint32)
        parts, times = [], []
        for _, _, _, c, t in docs:
            mine = code[c]
            o = np.argsort(mine)
            mine = mine[o]
            parts.append(np.diff(mine, prepend=np.uint32(0)).astype(np.uint32))
            times.append(t[o])
        empty = {k: None for k in ("first", "words", "ids", "n_bytes", "extra", "n_words", "codes", "times")}
        rows = [empty | {"chunk": chunk, "bucket": -1, "ids": [d[0] for d in docs], "n_bytes": [d[1] for d in docs], "extra": [d[2] for d in docs], "n_words": [len(d[3]) for d in docs], "codes": np.concatenate(parts).tobytes(), "times": np.concatenate(times).tobytes()}]
        edges = np.searchsorted(by[order], np.arange(buckets + 1))
        rows += [empty | {"chunk": chunk, "bucket": b, "first": int(i), "words": [names[x] for x in order[i:j]]} for b, (i, j) in enumerate(zip(edges, edges[1:])) if j > i]
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_pylist(rows[i : i + 64], _SCHEMA)

    def run(batches):
        bpe, chunk = loaded(tokenizer), TaskContext.get().partitionId() << 24
        docs, words, size = [], {}, 0
        for batch in batches:
            texts, ids = text_column(batch, "text"), batch["id"]
            for i in range(len(texts)):
                text = texts[i].as_py()
                found, special = bpe.pre_tokens(text)
                times = Counter(found)
                for s in special:
                    del times[s]
                codes = np.fromiter((words.setdefault(w, len(words)) for w in times), np.uint32, len(times))
                n = len(text.encode())
                docs.append((ids[i].as_py(), n, special.total(), codes, np.fromiter(times.values(), np.uint32, len(times))))
                size += n
                if size > CHUNK_BYTES:
                    yield from close(chunk, docs, words)
                    docs, words, size, chunk = [], {}, 0, chunk + 1
        if docs:
            yield from close(chunk, docs, words)

    return lean(run)


_SCHEMA = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("first", pa.int32()), ("words", pa.list_(pa.string())), ("ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("extra", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), ("codes", pa.binary()), ("times", pa.binary())])


def _pieces(tokenizer: str):
    """Pieces of each distinct pre-token of a bucket; a word that other chunks have too is not encoded again."""

    def run(batches):
        bpe, known = loaded(tokenizer), {}
        for batch in batches:
            for chunk, first, words in zip(batch["chunk"], batch["first"], batch["words"]):
                words = words.as_py()
                new = [w for w in words if w not in known]
                if len(known) + len(new) > 4 * CACHE:
                    known.clear()
                    new = words
                for i in range(0, len(new), 5000):
                    part = new[i : i + 5000]
                    known.update(zip(part, (len(e.ids) for e in bpe.library.encode_batch_fast(part, add_special_tokens=False))))
                pieces = np.fromiter(map(known.__getitem__, words), np.uint32, len(words)).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()]), pa.array([first.as_py()], pa.int32()), pa.array([pieces])], names=["chunk", "first", "pieces"])

    return lean(run)


@lean
def _sums(batches):
    for batch in batches:
        for row in range(len(batch)):
            x = {c: batch[c][row].as_py() for c in batch.schema.names if c != "codes"}
            parts = sorted(x["parts"] or [], key=lambda p: p["first"])
            pieces = np.concatenate([np.frombuffer(p["pieces"], np.uint32) for p in parts] or [np.zeros(0, np.uint32)])
            per = np.array(x["n_words"], np.int64)
            step = np.frombuffer(batch["codes"][row].as_py(), np.uint32).astype(np.int64)
            ends = np.cumsum(per)
            run = np.concatenate([[0], np.cumsum(step)])
            code = run[1:] - np.repeat(run[ends - per], per)
            sums = np.concatenate([[0], np.cumsum(np.frombuffer(x["times"], np.uint32).astype(np.int64) * pieces[code])])
            n = sums[ends] - sums[ends - per] + np.array(x["extra"])
            yield pa.RecordBatch.from_arrays([pa.array(x["ids"], pa.int64()), pa.array(x["n_bytes"], pa.int64()), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) for every row of docs, without any text's ids.

    A chunk of texts is stored as its dictionary of distinct pre-tokens and each document's frequencies
    of them. The dictionaries are dealt out by a hash of the pre-token, so that each distinct one is
    encoded in one place; what comes back is joined to the chunk and summed by document. A frequent
    pre-token costs one entry a chunk, so none is hot. Special strings count as one token each.
    Null and empty texts count 0; null ids and repeated rows keep their rows; other columns are not read. Long texts
    are read whole, each a chunk of its own if need be. Ties cannot arise. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-planned_bytes(docs) // BUCKET_BYTES), BUCKETS))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    table = written(src.mapInArrow(_chunks(tokenizer, buckets), _CHUNKS), "pre-tokens")
    words = table.where("bucket >= 0").select("chunk", "bucket", "first", "words").repartition(buckets, "bucket")
    pieces = words.mapInArrow(_pieces(tokenizer), "chunk long, first int, pieces binary")
    parts = pieces.groupBy("chunk").agg(F.collect_list(F.struct("first", "pieces")).alias("parts"))
    freqs = table.where("bucket < 0").select("chunk", "ids", "n_bytes", "extra", "n_words", "codes", "times")
    return freqs.join(parts, "chunk", "left").mapInArrow(_sums, "id long, n_bytes long, n_tokens long")
