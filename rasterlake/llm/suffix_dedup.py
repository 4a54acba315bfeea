"""Removal of long repeated substrings: anchors find where texts may agree, a Burrows-Wheeler transform decides.

The threshold-bounded interval expansion (after Beller, Gog, Ohlebusch and Schnattinger, 2013) runs on
blocks of short segments around sampled anchors, so that no task ever holds more than a block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import blocks, buffers, carried, keyed_join, lean, mix, powers, prefix_hash, prepare, release, text_column, written

#: Segments of one anchor that a block may hold together; an anchor with more is split by its context.
MOST = 4096
#: Repeats that a task remembers while it looks for anchors; what it does not know is found after the exchange.
COMMON = 100_000
#: Bytes of segments in a block, about.
BLOCK = 1 << 20
#: Bytes of packed places or spans that may be broadcast; more are joined by a shuffle of the texts.
BROADCAST_BYTES = 24 << 20
_NO_ID = (1 << 63) - 1


def anchor_length(min_len: int) -> int:
    """Every string of min_len bytes holds an anchor of this length, chosen by the string's content alone."""
    return max(1, min_len * 8 // 25)


def _slide(x: np.ndarray, span: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every span neighbours, by doubling."""
    size = 1
    while size * 2 <= span:
        x, size = pick(x[:-size], x[size:]), size * 2
    return pick(x[: -(span - size)], x[span - size :]) if span > size else x


def _anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int):
    """Of a block of texts, (place, first, last): the windows of length bytes that start from first to last have
    their least gram at place, which is the leftmost such place in each of them."""
    n, span = len(data), length - gram + 1
    if n < length:
        return None
    sums, down = prefix_hash(data), powers(n + 1)[1]
    grams = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    room = np.repeat(off[1:], np.diff(off))[: n - length + 1] - np.arange(n - length + 1)
    starts = np.flatnonzero(room >= length)
    if not len(starts):
        return None
    least = _slide(grams, span, np.minimum)[starts]
    new = np.flatnonzero((least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    begin, end = starts[np.concatenate([[0], new])], starts[np.concatenate([new - 1, [len(starts) - 1]])]
    value = least[np.concatenate([[0], new])]
    # where the runs' least grams lie: the places of each value, in order
    kinds, kind = np.unique(value, return_inverse=True)
    most = np.zeros(len(grams) + span - 1, np.uint64)
    most[starts + span - 1] = least
    at = np.flatnonzero(_slide(most, span, np.maximum) == grams)
    near = np.searchsorted(kinds, grams[at])
    fits = (near < len(kinds)) & (kinds[np.minimum(near, len(kinds) - 1)] == grams[at])
    key = np.sort(near[fits].astype(np.int64) << 32 | at[fits])
    lo, hi = np.searchsorted(key, kind << 32 | begin), np.searchsorted(key, kind << 32 | end)
    each = hi - lo + 1
    run = np.repeat(np.arange(len(begin)), each)
    i = np.arange(len(run)) - np.repeat(np.cumsum(each) - each, each) + lo[run]
    place = key[i] & 0xFFFFFFFF
    first = np.where(i > lo[run], (key[i - 1] & 0xFFFFFFFF) + 1, begin[run])
    return place, first, np.minimum(place, end[run]), grams


def _rows(length: int, gram: int):
    """Anchors with their segments, and what the task knows of them: kind 0, nothing; 1, the segment is a repeat; 2, the
    anchor has other segments.

    Of equal segments of an anchor that the task meets, only the first needs to meet the rest of the corpus; and once it
    has sent two different segments of an anchor, others need not be told from one that occurs once. Both go by
    keys of their own, so that neither a segment nor an anchor common to many texts is a hot key.
    """

    def run(batches):
        common: dict[tuple[int, int], tuple[int, int, int]] = {}
        several = np.zeros(0, np.uint64)
        for batch in batches:
            col = text_column(batch, "text")
            ids, th = batch["id"].to_numpy(), batch["th"].to_numpy()
            data, off = buffers(col)
            raw = data.tobytes()
            parts = []
            for i, j in blocks(off):
                own = off[i : j + 1] - off[i]
                found = _anchors(data[off[i] : off[j]], own, length, gram)
                if found is None:
                    continue
                at, first, last, grams = found
                doc = np.searchsorted(own, at, "right") - 1
                hi = last + length
                seg = np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip((off[i] + first).tolist(), (off[i] + hi).tolist())), np.uint64)
                seg = mix(seg + mix((at - first).astype(np.uint64)))
                parts.append((mix(grams[at]), seg, i + doc, at - own[doc], at - first, hi - at))
            if not parts:
                continue
            h, seg, doc, pos, left, right = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((pos, th[doc], ids[doc], seg, h))
            later = np.zeros(len(h), bool)
            later[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (seg[order[1:]] == seg[order[:-1]])
            # What a batch has twice, the task remembers with its first place: later batches know it as a repeat at once.
            again = order[:-1][later[order[1:]] & ~later[order[:-1]]]
            for x in (again if len(common) < COMMON else ()):
                common.setdefault((int(h[x]), int(seg[x])), (int(ids[doc[x]]), int(th[doc[x]]), int(pos[x])))
            if common:
                for x in np.flatnonzero(~later & np.isin(h, np.fromiter((k[0] for k in common), np.uint64, len(common)))).tolist():
                    key, place = (int(h[x]), int(seg[x])), (int(ids[doc[x]]), int(th[doc[x]]), int(pos[x]))
                    least = common.get(key)
                    if least is not None and least < place:
                        later[x] = True
                    elif least is not None:
                        common[key] = place
            # How many segments of its anchor come before each, among those that are no repeats.
            first, of = ~later[order], h[order]
            new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            before = np.cumsum(first) - first
            before -= np.repeat(before[new], np.diff(np.append(new, len(of))))
            surplus = np.zeros(len(h), bool)
            surplus[order] = first & (before >= 2)
            surplus |= ~later & np.isin(h, several)
            if len(several) < COMMON:
                several = np.union1d(several, h[surplus])
            part = h.copy()
            own = later | surplus
            part[own] = mix((ids[doc[own]] ^ th[doc[own]]).view(np.uint64) + mix(pos[own].astype(np.uint64)))
            kind = (later + 2 * surplus).astype(np.int8)
            for x in range(0, len(h), 50_000):
                y = slice(x, x + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (part[y].view(np.int64), h[y].view(np.int64), seg[y].view(np.int64), ids[doc[y]], th[doc[y]], pos[y].astype(np.int32), left[y].astype(np.int16), right[y].astype(np.int16), kind[y])], names=["part", "h", "seg", "id", "th", "pos", "left", "right", "kind"])

    return lean(run)


_PLACE = np.dtype([("h", "<i8"), ("pos", "<i4"), ("left", "<i2"), ("right", "<i2")])


@lean
def _packed(batches):
    """A document's places as one binary value."""
    for batch in batches:
        lo, flat = batch["at"].offsets.to_numpy(), batch["at"].values
        x = np.zeros(len(flat), _PLACE)
        for c in _PLACE.names:
            x[c] = flat.field(c).to_numpy()
        yield pa.RecordBatch.from_arrays([batch["id"], batch["th"], pa.array([x[i:j].tobytes() for i, j in zip(lo, lo[1:])], pa.binary())], names=["id", "th", "at"])


@lean
def _segments(batches):
    for batch in batches:
        texts, ids, th = text_column(batch, "text"), batch["id"].to_numpy(), batch["th"].to_numpy()
        data, off = buffers(texts)
        raw = data.tobytes()
        own = [np.frombuffer(x, _PLACE) for x in batch["at"].to_pylist()]
        doc, x = np.repeat(np.arange(len(own)), [len(v) for v in own]), np.concatenate(own)
        start = x["pos"] - x["left"]
        a, b = off[doc] + start, off[doc] + x["pos"] + x["right"]
        for i in range(0, len(doc), 20_000):
            y = slice(i, i + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(x["h"][y]), pa.array(ids[doc[y]]), pa.array(th[doc[y]]), pa.array(start[y].astype(np.int32)), pa.array(x["left"][y].astype(np.int32)), pa.array([raw[p:q] for p, q in zip(a[y], b[y])], pa.binary())], names=["h", "id", "th", "start", "left", "seg"])


@lean
def _merged(batches):
    """A document's marks as disjoint spans, packed into one binary value of pairs of 32-bit integers."""
    for batch in batches:
        lo, flat = batch["marks"].offsets.to_numpy(), batch["marks"].values
        start, end, out = flat.field("start").to_numpy(), flat.field("end").to_numpy(), []
        for i, j in zip(lo, lo[1:]):
            o = np.argsort(start[i:j], kind="stable")
            a, b = start[i:j][o], np.maximum.accumulate(end[i:j][o])
            new = np.flatnonzero(a[1:] > b[:-1]) + 1
            out.append(np.stack([a[np.concatenate([[0], new])], b[np.concatenate([new - 1, [len(b) - 1]])]], 1).astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([batch["id"], batch["th"], pa.array(out, pa.binary())], names=["id", "th", "marks"])


def equal_windows(segments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, offset, class) of every window of length bytes: equal windows share a class, and only they.

    Suffixes are ordered by prefix doubling. Intervals of the transform are then extended backwards, breadth
    first: level l meets every interval of an l-byte string, and a boundary between two intervals that
    is met for the first time gets the common prefix l - 1. After level length, the boundaries
    not met have common prefixes of at least length, which is all that is asked; the rest is never expanded.
    """
    sizes = np.array([len(s) for s in segments])
    joined = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    used = np.zeros(257, np.int64)
    used[joined.astype(np.int64) + 1] = 1
    code = np.cumsum(used)[joined.astype(np.int64) + 1] + 1
    code[ends] = 1
    n, bits = len(code), int(code.max()).bit_length()
    per = 62 // bits
    key, depth = code.copy(), 1
    while depth * 2 <= per:
        key = (key << (bits * depth)) | np.concatenate([key[depth:], np.zeros(min(depth, n), np.int64)])[:n]
        depth *= 2
    slot = (n + 1).bit_length()
    packed = False
    while True:
        if packed:  # two ranks and the place share a word, which sorts faster than places alone
            key = np.sort(key << slot | np.arange(n))
            order, by = key & (1 << slot) - 1, key >> slot
        else:
            order = np.argsort(key)
            by = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], by[1:] != by[:-1]]))
        if depth > length:
            break
        packed = 3 * slot <= 63
        key = (rank + 1 << (slot if packed else 31)) | np.concatenate([rank[depth:] + 1, np.zeros(min(depth, n), np.int64)])[:n]
        depth *= 2

    last = code[order - 1].astype(np.uint16)  # the transform; the text's first symbol is preceded by its last
    by_symbol = np.argsort(last, kind="stable")
    step = np.empty(n, np.int32)
    step[by_symbol] = np.arange(n, dtype=np.int32)
    same = last[by_symbol[1:]] == last[by_symbol[:-1]]
    before, after = np.full(n, -1, np.int32), np.full(n, n, np.int32)
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]

    met = np.zeros(n + 1, bool)
    met[n] = True
    lo, hi = np.zeros(1, np.int32), np.full(1, n, np.int32)
    whole = True
    for _ in range(length):
        if not len(lo):
            break
        if whole:
            rows, a, b = np.arange(n, dtype=np.int32), np.int32(0), np.int32(n)
        else:
            size = hi - lo
            total = np.cumsum(size)
            rows = np.arange(total[-1], dtype=np.int32) + np.repeat((lo - (total - size)).astype(np.int32), size)
            a, b = np.repeat(lo, size), np.repeat(hi, size)
        lo = np.sort(step[rows[before[rows] < a]])
        hi = np.sort(step[rows[after[rows] >= b]]) + np.int32(1)
        fresh = ~met[hi]
        lo, hi = lo[fresh], hi[fresh]
        met[hi] = True
        whole = False
    kind = np.empty(n, np.int64)
    kind[order] = np.cumsum(np.concatenate([[False], met[1:n]]))

    starts = ends - sizes
    room = np.maximum(sizes - length + 1, 0)
    seg = np.repeat(np.arange(len(segments)), room)
    offset = np.arange(len(seg)) - np.repeat(np.cumsum(room) - room, room)
    return seg, offset, kind[starts[seg] + offset]


def _repeats(length: int):
    """Blocks of whole groups; marks every window that an earlier one equals."""

    def block(rows):
        cols = {c: np.concatenate([r[c] for r in rows]) for c in ("id", "th", "start")}
        segments = [s for r in rows for s in r["seg"]]
        seg, offset, kind = equal_windows(segments, length)
        order = np.lexsort((cols["th"], cols["id"]))
        doc = np.zeros(len(order), np.int64)
        doc[order[1:]] = np.cumsum((np.diff(cols["id"][order]) != 0) | (np.diff(cols["th"][order]) != 0))
        key = doc[seg] << 32 | (cols["start"][seg] + offset)
        first = np.full(int(kind.max(initial=0)) + 1, _NO_ID)
        np.minimum.at(first, kind, key)
        hit = np.flatnonzero(key > first[kind])
        if not len(hit):
            return None
        s, o = seg[hit], offset[hit]
        new = np.ones(len(hit), bool)
        new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(hit)) - 1
        s = s[begin]
        return pa.RecordBatch.from_arrays([pa.array(cols["id"][s]), pa.array(cols["th"][s]), pa.array((cols["start"][s] + o[begin]).astype(np.int32)), pa.array((cols["start"][s] + o[end] + length).astype(np.int32))], names=["id", "th", "start", "end"])

    def run(batches):
        held, size, at = [], 0, None
        for batch in batches:
            if not len(batch):
                continue
            g = batch["g"].to_numpy()
            cut = np.flatnonzero(np.diff(g)) + 1
            cols = {c: batch[c].to_numpy() for c in ("id", "th", "start")}
            segs = batch["seg"].to_pylist()
            size_of = np.cumsum([0, *map(len, segs)])
            i = 0
            for j in [*cut.tolist(), len(batch)]:
                if size > BLOCK and g[i] != at and (out := block(held)) is not None:
                    yield out
                if size > BLOCK and g[i] != at:
                    held, size = [], 0
                held.append({c: v[i:j] for c, v in cols.items()} | {"seg": segs[i:j]})
                size += int(size_of[j] - size_of[i])
                at, i = g[j - 1], j
        if held and (out := block(held)) is not None:
            yield out

    return lean(run)


def _split(segs: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame | None]:
    """Groups of MOST segments at most, and marks for the groups whose window is known to be equal.

    All segments of a group agree on their bytes [a, b). A shared window that holds these reaches at
    least half of what it lacks to the left or to the right, so a large group is split by either
    half's bytes without losing one. Where nothing is lacking the window itself is the class.
    """
    own = F.xxhash64("h", F.expr(f"substring(seg, left + 1, {gram})"))  # by the bytes themselves: the anchors' hash may be led astray
    part, marks, slack = segs.select("*", own.alias("g"), F.col("left").alias("a"), (F.col("left") + gram).alias("b")), None, length - gram
    done: DataFrame | None = None
    while True:
        counts = part.groupBy("g").agg(F.count("*").alias("c"))
        hot = written(counts.where(F.col("c") > MOST), "hot")
        n = hot.count()
        if not n:
            cold = part.join(counts.where("c > 1").select("g"), "g", "left_semi")
            return (cold if done is None else done.unionByName(cold)), marks
        cold = part.join(counts.where(f"c > 1 and c <= {MOST}").select("g"), "g", "left_semi")
        done = cold if done is None else done.unionByName(cold)
        large = keyed_join(part, hot.select("g"), "g", "left_semi", n)
        if not slack:
            first = large.groupBy("g").agg(F.min(F.struct("id", "th", (F.col("start") + F.col("a")).alias("p"))).alias("first"))
            own = F.struct("id", "th", (F.col("start") + F.col("a")).alias("p"))
            found = keyed_join(large, first, "g", "inner", n).where(own > F.col("first")).select("id", "th", (F.col("start") + F.col("a")).cast("int").alias("start"), (F.col("start") + F.col("b")).cast("int").alias("end"))
            return done, found if marks is None else marks.unionByName(found)
        half = (slack + 1) // 2
        sides = []
        for side, a, b in (("l", F.col("a") - half, F.col("b")), ("r", F.col("a"), F.col("b") + half)):
            text = F.expr(f"substring(seg, {'a - ' + str(half) if side == 'l' else 'b'} + 1, {half})")
            key = F.xxhash64("g", F.lit(side), text)
            sides.append(large.where(a >= 0 if side == "l" else b <= F.length("seg")).withColumn("g", key).withColumn("a", a).withColumn("b", b))
        part, slack = written(sides[0].unionByName(sides[1]), "split"), slack - half


def _cut(as_text: bool):
    """The bytes that stay; as text, what a cut has left of a character goes too."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            names = [c for c in batch.schema.names if c not in ("text", "marks")]
            texts = text_column(batch, "text").cast(pa.large_binary())
            off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            for i, j in blocks(off):
                spans, kept, removed = [], [], []
                for raw, marks in zip(texts.slice(i, j - i).to_pylist(), batch["marks"].slice(i, j - i).to_pylist()):
                    flat = np.frombuffer(marks or b"", "<i4").tolist()
                    edges = [0, *flat, len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) if flat else raw)
                    removed.append(len(raw) - len(kept[-1]))
                    spans.append([{"start": a, "end": b} for a, b in zip(flat[::2], flat[1::2])])
                left = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(i, j - i) for c in names), pa.array(np.diff(off[i : j + 1])), pa.array(removed, pa.int64()), pa.array(spans, kind), left], names=[*names, "n_bytes", "n_removed", "spans", "kept"])

    return lean(run)


def _beside(texts: DataFrame, packed: DataFrame, col: str, how: str) -> DataFrame:
    """texts with the packed values of their ids, which are broadcast only if their measured size is small."""
    n, size = packed.agg(F.count("*"), F.sum(F.length(col))).first()
    return keyed_join(texts, packed, ["id", "th"], how, n if (size or 0) <= BROADCAST_BYTES else 1 << 62)


def repeated_substrings(docs: DataFrame, min_len: int = 100, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """(id, carried columns, n_bytes, n_removed, spans, kept) for every row: bytes in repeats of min_len are cut.

    A byte goes if it lies in a string of min_len bytes that also starts earlier: in a smaller id, or
    in the same text before. Strings are judged on the texts as given and never cross them.

    1. Winnowing picks anchors so that equal strings of min_len bytes hold the same anchor at the same
       place. An anchor that occurs once is dropped.
    2. Around an anchor, the text as far as such a string may reach is its segment. Of equal segments of
       an anchor, all but the first are repeats throughout. The first ones of each go on if there are two.
    3. Their strings are compared by equal_windows in blocks of whole anchors; large anchors are split.

    kept is binary, since a cut may split a character; as_text gives a string without such remains.

    Null and empty texts: 0 bytes, nothing removed. Null ids come after all others. Rows that share an id
    are ordered by a hash of their texts; rows equal in both are one text and get the same result. Texts are read
    whole, however long. An empty table gives an empty result. A carried column whose name the result has itself
    comes out with carried_ before it; other columns are not read.
    """
    if not 1 <= min_len <= 32_767:
        raise ValueError("min_len must be from 1 to 32767")
    prepare(docs.sparkSession)
    length, gram = min_len, anchor_length(min_len)
    own: list[Column] = [F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text_col).alias("text")]
    extra = carried(carry, ("id", "n_bytes", "n_removed", "spans", "kept"))
    src = docs.select(*own, F.col(id_col).cast("long").isNull().alias("no_id"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(extra)])
    several = written(src.groupBy("id").agg(F.count("*").alias("c")).where(f"c > 1 or id = {_NO_ID}").select("id", F.lit(1).alias("more")), "ids")
    n_several = several.count()
    src = (keyed_join(src, several, "id", "left", n_several) if n_several else src.withColumn("more", F.lit(None).cast("int"))).withColumn("th", F.when(F.col("more") == 1, F.xxhash64("text")).otherwise(F.lit(0)).cast("long")).drop("more")
    once = src.select("id", "th", "text").dropDuplicates(["id", "th"]) if n_several else src.select("id", "th", "text")

    rows = once.mapInArrow(_rows(length, gram), "part long, h long, seg long, id long, th long, pos int, left smallint, right smallint, kind tinyint")
    in_seg = Window.partitionBy("part", "seg").orderBy("id", "th", "pos")
    in_part = Window.partitionBy("part")
    found = rows.withColumn("rn", F.row_number().over(in_seg)).withColumns({"x": F.min("seg").over(in_part), "y": F.max("seg").over(in_part)}).where("kind > 0 or rn > 1 or x <> y")
    found = written(found.select("h", "id", "th", "pos", "left", "right", ((F.col("kind") == 1) | (F.col("rn") > 1)).alias("later")), "anchors")
    whole = found.where("later").select("id", "th", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("end")).where(f"end - start >= {length}")

    places = found.where("not later").groupBy("id", "th").agg(F.collect_list(F.struct("h", "pos", "left", "right")).alias("at"))
    places = written(places.mapInArrow(_packed, "id long, th long, at binary"), "places")
    segs = _beside(once, places, "at", "inner").select("id", "th", "text", "at").mapInArrow(_segments, "h long, id long, th long, start int, left int, seg binary")
    segs = written(segs.where(F.length("seg") >= length), "segments")
    groups, more = _split(segs, length, gram)
    within = groups.select("g", "id", "th", "start", "seg").repartition("g").sortWithinPartitions("g").mapInArrow(_repeats(length), "id long, th long, start int, end int")
    marks = whole.unionByName(within)
    marks = marks if more is None else marks.unionByName(more)
    marks = marks.groupBy("id", "th").agg(F.collect_list(F.struct("start", "end")).alias("marks"))
    marks = written(marks.mapInArrow(_merged, "id long, th long, marks binary"), "marks")
    release(found, places, segs)
    out = _beside(src, marks, "marks", "left")
    of = {c.lower(): t for c, t in docs.dtypes}
    kinds = ", ".join(f"_c{i} {of[c.lower()]}" for i, c in enumerate(extra))
    out = out.select("id", "no_id", *[f"_c{i}" for i in range(len(extra))], "text", "marks").mapInArrow(_cut(as_text), f"id long, no_id boolean, {kinds + ', ' if kinds else ''}n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept {'string' if as_text else 'binary'}")
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias("id"), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(extra.values())], "n_bytes", "n_removed", "spans", "kept")
