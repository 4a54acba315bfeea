"""Legacy web archives (ARC) and their conversion to WARC."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import grouped_join, prepare, scratch_path, text_column, written

#: Bytes of payload after which a writer begins another archive.
ARCHIVE_BYTES = 48 << 20
# The field lists that a version block of ARC 1 and of ARC 2 declares.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes) -> bytes:
    """data as one gzip member, so that every record can be read alone."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member, or of the whole if it isn't compressed."""
    if data[:2] != b"\x1f\x8b":
        yield 0, data
        return
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        parts, end = [], at
        while not z.eof and end < len(data):
            parts.append(z.decompress(data[end : end + (1 << 16)]))
            end += 1 << 16
        yield at, b"".join(parts)
        at = min(end, len(data)) - len(z.unused_data)


# ---------------------------------------------------------------- ARC


@dataclass
class ArcRecord:
    offset: int
    url: str
    ip: str
    date: str
    content_type: str
    body: bytes
    fields: dict[str, str] = field(default_factory=dict)


def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 rasterlake\n{ARC_FIELDS[version]}\n\n".encode()
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {'' if version == 1 else '200 - - 0 ' + name + ' '}{len(body)}\n".encode() + body + b"\n"


def arc_record(url: str, ip: str, date: str, kind: str, body: bytes, version: int, offset: int = 0, name: str = "-") -> bytes:
    """One record; white space in the URL is escaped, since the header line is cut at blanks."""
    url = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) or "urn:none"
    more = f"200 {sha1_base32(body)} - {offset} {name} " if version == 2 else ""
    return f"{url} {ip} {date} {kind} {more}{len(body)}\n".encode() + body + b"\n"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an archive; lines are cut as its version block declares, bodies by declared length."""
    names: list[str] | None = None
    for base, content in members(data):
        at = 0
        while at < len(content):
            if content[at : at + 1] in b"\r\n":
                at += 1
                continue
            end = content.index(b"\n", at)
            parts = content[at:end].rstrip(b"\r").decode("utf-8", "replace").split(" ")
            length = int(parts[-1])
            body = content[end + 1 : end + 1 + length]
            if len(body) < length:
                raise ValueError(f"record at {base + at}: {len(body)} of {length} bytes")
            if parts[0].startswith("filedesc://"):
                lines = body.decode("utf-8", "replace").splitlines()
                names = lines[1].split() if len(lines) > 1 and lines[1].strip() else ARC_FIELDS[int(lines[0].split()[0])].split()
            else:
                names = names or ARC_FIELDS[1].split()
                if len(parts) < len(names):
                    raise ValueError(f"record at {base + at}: {len(parts)} fields of {len(names)}")
                tail = parts[len(parts) - len(names) + 1 :]
                own = dict(zip(names, [" ".join(parts[: len(parts) - len(names) + 1]), *tail]))
                yield ArcRecord(base + at if at else base, own["URL"], own["IP-address"], own["Archive-date"], own["Content-type"], body, own)
            at = end + 1 + length


# ---------------------------------------------------------------- HTTP and WARC


def split_http(body: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head with its blank line, lower-cased fields, and payload; a body without a status line is all payload."""
    if not body.startswith(b"HTTP/"):
        return b"", {}, body
    head, sep, payload = body.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return head + sep, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def warc_date(arc_date: str) -> str:
    """ISO 8601 of an ARC date of 8 to 14 digits; missing parts are the least possible."""
    d = (arc_date + "19700101000000"[len(arc_date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", "sha1:" + sha1_base32(block)), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def convert_record(record: ArcRecord, archive: str, original: str | None = None, original_key: str | None = None) -> bytes:
    """The WARC record of an ARC record: a response, or a revisit if original names an equal payload's record."""
    head, http, payload = split_http(record.body)
    fields = [("WARC-Record-ID", record_id(archive, record.offset)), ("WARC-Date", warc_date(record.date)), ("WARC-Target-URI", record.url), ("WARC-IP-Address", record.ip), ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload))]
    if "x-page-id" in http:
        fields.append(("X-Page-Id", http["x-page-id"]))
    kind = "response" if head else "resource"
    fields.append(("Content-Type", "application/http; msgtype=response" if head else record.content_type))
    if original is None:
        return warc_record(kind, fields, head + payload)
    fields += [("WARC-Refers-To", original), ("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-Id", original_key or "-")]
    return warc_record("revisit", fields, head)


def record_id(archive: str, offset: int) -> str:
    """The same for the same place in the same archive, whenever it is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-cased names, block) of each record."""
    for _, content in members(data):
        at = 0
        while at < len(content):
            if content[at : at + 1] in b"\r\n":
                at += 1
                continue
            end = content.index(b"\r\n\r\n", at)
            lines = content[at:end].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record at {at}")
            fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            length = int(fields["content-length"])
            yield fields, content[end + 4 : end + 4 + length]
            at = end + 4 + length


# ---------------------------------------------------------------- Spark


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _read(path: str) -> bytes:
    store, root = _open(path)
    with store.open_input_stream(root, compression=None) as f:
        return f.read()


class _Writer:
    """Archives of bounded size in one folder, named at random so that a task run twice does no harm."""

    def __init__(self, folder: str, suffix: str):
        self.store, self.root = _open(folder)
        self.store.create_dir(self.root, recursive=True)
        self.folder, self.suffix, self.out = folder, suffix, None

    def begin(self) -> str:
        self.name, self.size, self.count, self.at = uuid.uuid4().hex + self.suffix, 0, 0, 0
        self.out = self.store.open_output_stream(f"{self.root}/{self.name}", compression=None)
        return self.name

    def put(self, record: bytes) -> None:
        data = _member(record)
        self.out.write(data)
        self.at, self.size, self.count = self.at + len(data), self.size + len(record), self.count + 1

    def close(self) -> pa.RecordBatch:
        self.out.close()
        self.out = None
        return pa.RecordBatch.from_arrays([pa.array([f"{self.folder}/{self.name}"]), pa.array([self.count], pa.int64())], names=["archive", "records"])


def write_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", version: int = 1, date: str = "20240101000000") -> DataFrame:
    """Writes a record per row into ARC archives of the shared folder; returns (archive, records).

    A null payload is empty, a null URL is urn:none, a null id is written as -.
    """
    folder = scratch_path(pages.sparkSession, "arc")

    def run(batches):
        w = _Writer(folder, ".arc.gz")
        for batch in batches:
            rows = zip(batch["id"].to_pylist(), text_column(batch, "url").to_pylist(), text_column(batch, "payload").cast(pa.large_binary()).to_pylist())
            for key, url, payload in rows:
                if w.out is None:
                    w.put(arc_version_block(w.begin(), version, date))
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'-' if key is None else key}\r\n\r\n".encode()
                w.put(arc_record(url, "0.0.0.0", date, "text/html", head + payload, version, w.at, w.name))
                if w.size >= ARCHIVE_BYTES:
                    yield w.close()
        if w.out is not None:
            yield w.close()

    prepare(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("payload"))
    return written(rows.mapInArrow(run, "archive string, records long"), "arc-manifest")


def convert_arc(manifest: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Converts the ARC archives of (archive, ...) to WARC archives in the shared folder; returns (archive, records).

    Of records with equal payloads of at least min_revisit_bytes, the one with the largest page id
    (then the first by archive and offset; no id counts as least) becomes a response, the others revisits.
    """
    spark = manifest.sparkSession
    folder = scratch_path(spark, "warc")

    def index(batches):
        for batch in batches:
            for archive in batch["archive"].to_pylist():
                out = ([], [], [], [])
                for r in read_arc(_read(archive)):
                    _, http, payload = split_http(r.body)
                    key = http.get("x-page-id", "-")
                    for c, v in zip(out, (r.offset, None if key == "-" else int(key), sha1_base32(payload), len(payload))):
                        c.append(v)
                n = len(out[0])
                yield pa.RecordBatch.from_arrays([pa.array([archive] * n, pa.string()), *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.int64())))], names=["archive", "offset", "page_id", "digest", "length"])

    def convert(batches):
        for batch in batches:
            for archive, revisits in zip(batch["archive"].to_pylist(), batch["revisits"].to_pylist()):
                w, of = _Writer(folder, ".warc.gz"), {r["offset"]: r for r in revisits or ()}
                name = w.begin()
                w.put(warc_record("warcinfo", [("WARC-Record-ID", record_id(archive, -1)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], f"format: WARC File Format 1.1\r\nconverted-from: {archive.rsplit('/', 1)[-1]}\r\n".encode()))
                for r in read_arc(_read(archive)):
                    first = of.get(r.offset)
                    w.put(convert_record(r, archive, *((record_id(first["archive"], first["at"]), first["key"]) if first else ())))
                yield w.close()

    prepare(spark)
    n = max(1, manifest.count())
    records = written(manifest.select("archive").repartition(n).mapInArrow(index, "archive string, offset long, page_id long, digest string, length long"), "arc-index")
    order = F.struct((-F.coalesce(F.col("page_id"), F.lit(-(1 << 63) + 1))).alias("k"), F.col("archive").alias("a"), F.col("offset").alias("o"), F.col("page_id").alias("p"))
    firsts = written(records.where(F.col("length") >= min_revisit_bytes).groupBy(F.col("digest").alias("same")).agg(F.min(order).alias("first"), F.count("*").alias("c")).where("c > 1"), "first-records")
    later = grouped_join(records.where(F.col("length") >= min_revisit_bytes), firsts, F.col("digest") == F.col("same"), "c").where("archive <> first.a or offset <> first.o")
    revisit = F.struct("offset", F.col("first.a").alias("archive"), F.col("first.o").alias("at"), F.coalesce(F.col("first.p").cast("string"), F.lit("-")).alias("key"))
    jobs = manifest.select("archive").join(later.groupBy("archive").agg(F.collect_list(revisit).alias("revisits")), "archive", "left")
    return written(jobs.repartition(n, "archive").mapInArrow(convert, "archive string, records long"), "warc-manifest")


def read_warc_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(record_type, record_id, url, page_id, date, payload_digest, payload_bytes, payload, refers_to_page) of each record but warcinfo.

    A revisit has no payload of its own; payload_bytes is the full payload's, from its HTTP head.
    """

    def run(batches):
        names = ("record_type", "record_id", "url", "page_id", "date", "payload_digest", "payload_bytes", "payload", "refers_to_page")
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64())
        number = lambda x: None if x in (None, "-") else int(x)
        for batch in batches:
            for archive in batch["archive"].to_pylist():
                rows, size = [], 0
                for f, block in read_warc(_read(archive)):
                    if f["warc-type"] == "warcinfo":
                        continue
                    if "sha1:" + sha1_base32(block) != f["warc-block-digest"]:
                        raise ValueError(f"{archive}: damaged block of {f['warc-record-id']}")
                    _, http, payload = split_http(block)
                    again = f["warc-type"] == "revisit"
                    rows.append((f["warc-type"], f["warc-record-id"], f["warc-target-uri"], number(f.get("x-page-id")), f["warc-date"], f["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"]) if again else len(payload), None if again else payload, number(f.get("x-refers-to-page-id"))))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))

    prepare(spark)
    n = max(1, manifest.count())
    return manifest.select("archive").repartition(n).mapInArrow(run, "record_type string, record_id string, url string, page_id long, date string, payload_digest string, payload_bytes long, payload binary, refers_to_page long")


def pages_through_archives(pages: DataFrame, version: int = 1) -> DataFrame:
    """Every page written as ARC, converted to WARC and read back; see read_warc_archives for the columns.

    Null payloads are empty; null ids and repeated rows keep their records; an empty table gives none.
    """
    return read_warc_archives(pages.sparkSession, convert_arc(write_arc(pages, version=version)))
