"""Media columns: byte payloads kept as images in archives, read back by a custom data source."""

from __future__ import annotations

import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import lean, prepare, scratch_path, text_column

#: Pixels in a row of the images, and so the unit of a payload.
WIDTH = 576
#: Bytes after which a writer begins another archive, and bytes that one read task covers.
ARCHIVE_BYTES, RANGE_BYTES = 32 << 20, 8 << 20
#: Partitions of a read at most; beyond, their ranges grow.
PARTITIONS = 100_000
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


# ---------------------------------------------------------------- the stored form


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_image(payload: bytes, n_bytes: int, width: int = WIDTH) -> bytes:
    """An 8-bit grey PNG of the payload, whose length is a multiple of width; n_bytes goes along as text."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(pixels), width + 1), np.uint8)
    lines[:, 1:] = pixels
    head = struct.pack(">IIBBBBB", width, len(pixels), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_image(media: bytes) -> tuple[np.ndarray, dict[str, str]]:
    """Pixels and text entries of an 8-bit grey PNG without interlacing; every checksum is tested."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, body, notes, head = 8, [], {}, None
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + size]
        if len(data) < size or zlib.crc32(kind + data) != int.from_bytes(media[at + 8 + size : at + 12 + size], "big"):
            raise ValueError(f"damaged PNG chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        elif kind == b"tEXt":
            key, _, value = data.partition(b"\0")
            notes[key.decode("latin-1")] = value.decode("latin-1")
        at += 12 + size
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey images without interlacing")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(head[1], head[0] + 1)
    if lines[:, 0].any():
        raise ValueError("only lines without a filter")
    return lines[:, 1:], notes


def feature_of(pixels: np.ndarray) -> str:
    """Size, mean, deviation and entropy of the grey values, and the mean change between neighbours."""
    counts = np.bincount(pixels.reshape(-1), minlength=256)
    share = counts[counts > 0] / pixels.size
    levels = np.arange(256)
    mean = float(counts @ levels) / pixels.size
    deviation = max(0.0, float(counts @ levels**2) / pixels.size - mean * mean) ** 0.5
    change = float(np.abs(np.diff(pixels.astype(np.int16), axis=1)).mean()) if pixels.shape[1] > 1 else 0.0
    return f"{pixels.shape[1]}x{pixels.shape[0]};mean={mean:.6f};deviation={deviation:.6f};entropy={float(-(share * np.log2(share)).sum()):.6f};change={change:.6f}"


# ---------------------------------------------------------------- archives


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _archives(folder: str):
    """Writes each row as a member of a zip archive, stored as it is; returns a row for each archive closed."""

    def run(batches):
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        name, out, members, size = None, None, 0, 0

        def close():
            out[1].close()
            size = out[0].tell()
            out[0].close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([members], pa.int64()), pa.array([size], pa.int64())], names=["archive", "members", "bytes"])

        for batch in batches:
            ids = batch["id"].to_pylist()
            for key, raw in zip(ids, text_column(batch, "text").cast(pa.large_binary()).to_pylist()):
                if out is None:
                    name, members, size = f"{uuid.uuid4().hex}.zip", 0, 0
                    stream = store.open_output_stream(f"{root}/{name}")
                    out = (stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED))
                padded = raw + b"\xff" * (-len(raw) % WIDTH if raw else WIDTH)
                media = encode_image(padded, len(raw))
                out[1].writestr(zipfile.ZipInfo(f"{members:08d}_{'null' if key is None else key}.png"), media)
                members, size = members + 1, stream.tell()
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return lean(run)


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, str]:
    """Stores every text as an image in archives of the shared folder; returns that folder and the manifest.

    Only archives named in the manifest count: what a task that failed or ran twice has left is not read.
    """
    prepare(docs.sparkSession)
    folder = scratch_path(docs.sparkSession, "media")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    manifest = scratch_path(docs.sparkSession, "media-manifest")
    rows.mapInArrow(_archives(folder), "archive string, members long, bytes long").write.parquet(manifest)
    return folder, manifest


@dataclass
class ByteRange(InputPartition):
    """Pieces (archive, start, end) that one task reads."""

    pieces: tuple[tuple[str, int, int], ...]


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.manifest = options["path"].rstrip("/"), options.get("manifest", "")
        self.range_bytes, self.tries = int(options.get("rangebytes", RANGE_BYTES)), int(options.get("tries", 3))

    def _sizes(self) -> list[tuple[str, int]]:
        """Archives and their bytes, in order: as the manifest has them, or as the folder lists them."""
        if self.manifest:
            store, root = _open(self.manifest)
            files = [x.path for x in store.get_file_info(fs.FileSelector(root)) if x.path.endswith(".parquet")]
            found = ds.dataset(files, filesystem=store, format="parquet").to_table(["archive", "bytes"]) if files else None
            return sorted(zip(found["archive"].to_pylist(), found["bytes"].to_pylist())) if files else []
        store, root = _open(self.folder)
        return sorted((x.base_name, x.size) for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.base_name.endswith(".zip"))

    def _names(self) -> list[str]:
        return [name for name, _ in self._sizes()]

    def partitions(self) -> list[ByteRange]:
        """Byte ranges of the archives; a range has the members that start in it.

        Where there would be more than PARTITIONS, ranges are longer and go over the archives laid end to end.
        """
        sizes = self._sizes()
        many = sum(-(-size // self.range_bytes) for _, size in sizes) > PARTITIONS
        step = max(self.range_bytes, -(-sum(size for _, size in sizes) // PARTITIONS)) if many else self.range_bytes
        found, pieces, room = [], [], step
        for name, size in sizes:
            at = 0
            while at < max(size, 1):
                end = min(at + room, max(size, 1))
                pieces.append((name, at, end))
                room -= end - at
                at = end
                if room <= 0 or not many and at >= size:
                    found.append(ByteRange(tuple(pieces)))
                    pieces, room = [], step
        return [*found, ByteRange(tuple(pieces))] if pieces or not found else found

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        for name, start, end in part.pieces:
            yield from self._range(f"{self.folder}/{name}", start, end)

    def _range(self, archive: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
        store, path = _open(archive)
        file = store.open_input_file(path)
        members = sorted((m for m in zipfile.ZipFile(file).infolist() if start <= m.header_offset < end), key=lambda m: m.header_offset)
        rows, size = [], 0
        for m in members:
            for attempt in range(1, self.tries + 1):
                try:
                    content = self._member(file, m)
                    break
                except (OSError, ValueError):
                    if attempt == self.tries:
                        raise
                    file = store.open_input_file(path)  # only this member is read again, from its offset
            rows.append((archive, m.filename, m.header_offset, content, attempt))
            size += len(content)
            if size > 4 << 20:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _member(file, m: zipfile.ZipInfo) -> bytes:
        file.seek(m.header_offset)
        head = file.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{m.filename}: no member at {m.header_offset}")
        names, extra = struct.unpack("<HH", head[26:30])
        file.seek(m.header_offset + 30 + names + extra)
        content = file.read(m.compress_size)
        if m.compress_type == zipfile.ZIP_DEFLATED:
            content = zlib.decompress(content, -15)
        if len(content) != m.file_size or zlib.crc32(content) != m.CRC:
            raise ValueError(f"{m.filename}: damaged at {m.header_offset}")
        return content

    @staticmethod
    def _batch(rows) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["archive", "member", "offset", "content", "attempts"])


class ArchiveSource(DataSource):
    """format("archive"): members of the zip archives in a folder, by byte ranges of the archives.

    Options: path (a folder URI), manifest (Parquet with the columns archive and bytes; else every .zip of the folder),
    rangeBytes of a partition, at least, tries (of each member, before the task fails).
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "archive string, member string, offset long, content binary, attempts int"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_media(spark: SparkSession, folder: str, manifest: str = "") -> DataFrame:
    """(id, n_bytes, payload, media, feature) of every member; the payload is what the image holds."""

    def run(batches):
        for batch in batches:
            out = ([], [], [], [], [])
            for member, media in zip(batch["member"].to_pylist(), batch["content"].to_pylist()):
                pixels, notes = decode_image(media)
                key = member.partition("_")[2].removesuffix(".png")
                for c, v in zip(out, (None if key == "null" else int(key), int(notes["n_bytes"]), pixels.tobytes(), media, feature_of(pixels))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()))], names=["id", "n_bytes", "payload", "media", "feature"])

    prepare(spark)
    spark.dataSource.register(ArchiveSource)
    members = spark.read.format("archive").option("path", folder).option("manifest", manifest).load()
    return members.select("member", "content").mapInArrow(lean(run), "id long, n_bytes long, payload binary, media binary, feature string")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text stored as an image and read back: (id, n_bytes, payload, media, feature).

    A null text is empty; an empty one is one row of pixels of value 255. Null ids and repeated rows
    keep their rows; an empty table gives an empty result; other columns are not read.
    """
    return read_media(docs.sparkSession, *write_media(docs, id_col, text_col))
