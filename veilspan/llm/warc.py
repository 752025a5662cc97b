"""WARC archives: a writer, and a Python data source for Spark that reads them, whoever wrote them.

The source plans partitions over files, and over ranges of large uncompressed ones; it takes filters on record headers
(type, page, payload size, ...) from Spark, parses a record's headers first and seeks past the blocks of records that a
filter rules out or whose payload nobody asked for.  Archives compressed by gzip, a member a record, are read one after
another, each by one task.  A payload is an HTTP message's body without its transfer and content encodings, or another
record's block.  Digest and length come from the payload, where that is read or the headers don't tell them.

Edge cases: a null html counts as an empty payload; a null url has no header; rows that share the smallest page_id of
equal payloads are all responses, rows with a null page_id never are when another row has an id; an empty table gives an
archive list without archives and an empty result; repeated rows are records of their own; a record without a length or
with a block that ends early ends the task with an error; a body that can't be decoded is given as it is stored; records
without a payload (warcinfo, request and metadata have their block, revisits none) have null in its columns.
"""

from __future__ import annotations

import hashlib
import io
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from .common import fresh_path, slices, table, utf8, written

SCHEMA = "record_type string, page_id long, url string, refers_to long, payload_digest string, payload_bytes long, payload binary"
URN = "urn:veilspan:page:"
#: Bytes of an uncompressed archive that a task reads.
RANGE = 256 << 20
#: Payloads below this are stored whole, each time.
LEAST = 100
#: Bytes of an archive after which the writer begins another one.
ARCHIVE = 256 << 20


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pyarrow.fs.LocalFileSystem(), path


def record(kind: str, page_id: int | None, url: str | None, refers_to: int | None, payload: bytes) -> bytes:
    """One record: an HTTP response with a deflated body, or a revisit without one."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + (b"Content-Encoding: deflate\r\n\r\n" + zlib.compress(payload, 1) if kind == "response" else b"\r\n")
    digest = hashlib.sha256(payload).hexdigest()
    # a page's response is known by page and payload, so that revisits can refer to it
    name = f"{URN}{page_id}:{digest}" if kind == "response" and page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="".join(map(chr, range(33, 127))).replace("%", "")))
    if kind == "revisit":
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head += [f"WARC-Profile: {profile}", f"WARC-Refers-To: <{URN}{refers_to}:{digest}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(rows: DataFrame, path: str) -> DataFrame:
    """Write rows (page_id, url, html, record_type, refers_to) to archives under path; gives the archives' paths and sizes.

    Only archives in this list count: what a task left that was lost midway isn't in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        fs.create_dir(root)
        out, name, size = None, "", 0
        done = []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((name, size))
                out = None

        for batch in slices(batches, "html"):
            for kind, i, url, ref, html in zip(*(batch[c].to_pylist() for c in ("record_type", "page_id", "url", "refers_to")), utf8(batch["html"]), strict=True):
                if out is None:
                    name, size = f"{path}/{uuid.uuid4().hex}.warc", 0
                    out = fs.open_output_stream(f"{root}/{name.rsplit('/', 1)[1]}")
                data = record(kind, i, url, ref, html)
                out.write(data)
                size += len(data)
                if size >= ARCHIVE:
                    close()
        close()
        if done:
            yield pa.record_batch({"path": [p for p, _ in done], "bytes": [n for _, n in done]})

    return written(rows.select("page_id", "url", "html", "record_type", "refers_to").mapInArrow(run, "path string, bytes long"), "archives")


@dataclass
class Range(InputPartition):
    """Records of an archive that begin from `start` on and before `end`."""

    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class Members(io.RawIOBase):
    """What the members of a gzip file hold, one after the other."""

    def __init__(self, raw):
        self.raw, self.held, self.left = raw, b"", b""
        self.inflate = zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.held:
            if self.inflate.eof:
                self.left, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            data, self.left = self.left or self.raw.read(1 << 16), b""
            if not data:
                return 0
            self.held = self.inflate.decompress(data)
        n = min(len(into), len(self.held))
        into[:n], self.held = self.held[:n], self.held[n:]
        return n


TESTS = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
#: Columns that come from headers alone.
HEADERS = ("record_type", "page_id", "url", "refers_to", "payload_digest", "payload_bytes")


def parse_headers(f: io.BufferedIOBase, end: int | None = None) -> dict[str, str] | None:
    """The next record's headers, names in lower case; None at the end, or if it begins at `end` or behind."""
    line = b"\n"
    while line in (b"\r\n", b"\n"):
        at = 0 if end is None else f.tell()
        line = f.readline()
    if not line or end is not None and at >= end:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record: {line[:40]!r}")
    out = {}
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def skip(f: io.BufferedReader, size: int) -> None:
    if f.seekable():
        f.seek(size, io.SEEK_CUR)
        return
    while size:
        n = len(f.read(min(size, 1 << 20)))
        if not n:
            raise ValueError("a block ends early")
        size -= n


def to_first_record(f: io.BufferedReader, start: int) -> None:
    """Go to the first record from `start` on: where a version line stands after a blank one, headers can be parsed, and the
    length that they tell leads to another record or the end."""
    if not start:
        return
    at, overlap = start - 4, b""
    f.seek(at)
    while data := f.read(1 << 20):
        text = overlap + data
        for m in re.finditer(rb"\r\n\r\n(?=WARC/\d)", text):
            place = at - len(overlap) + m.end()
            f.seek(place)
            head = parse_headers(f)
            size = head.get("content-length", "") if head else ""
            if size.isdigit():
                f.seek(int(size), io.SEEK_CUR)
                if f.read(8) in (b"\r\n\r\nWARC", b"\r\n\r\n"):
                    f.seek(place)
                    return
        at += len(data)
        overlap = text[-10:]
        f.seek(at)


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out)


def payload_of(block: bytes, kind: str) -> bytes:
    """A block's payload; kind: the record's content type."""
    if not kind.startswith("application/http"):
        return block
    head, _, body = block.partition(b"\r\n\r\n")
    fields = dict(x.lower().split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
    try:
        if fields.get(b"transfer-encoding", b"").strip() == b"chunked":
            body = dechunked(body)
        for name in reversed(fields.get(b"content-encoding", b"").split(b",")):
            if name.strip() in (b"gzip", b"x-gzip"):
                body = zlib.decompress(body, 31)
            elif name.strip() == b"deflate":
                try:
                    body = zlib.decompress(body)
                except zlib.error:
                    body = zlib.decompress(body, -15)
    except (zlib.error, ValueError):
        return block.partition(b"\r\n\r\n")[2]
    return body


class WarcReader(DataSourceReader):
    def __init__(self, paths: list[str], payload: str):
        """payload: none (headers only, where they tell all), digest (payloads are decoded and checked, not given back) or
        full."""
        self.paths, self.payload, self.tests = paths, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append((f.attribute[0], type(f), f.value))
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append((f.attribute[0], IsNotNull, None))
            else:
                yield f

    def partitions(self) -> list[Range]:
        """One for each RANGE of an uncompressed archive, one for each compressed one."""
        out = []
        for path in self.paths:
            fs, name = filesystem(path)
            size = fs.get_file_info(name).size or 0
            step = size if path.endswith(".gz") else RANGE
            out += [Range(path, at, min(at + step, size)) for at in range(0, size, max(1, step))]
        return out

    def wanted(self, row: dict, known: bool = True) -> bool:
        """known: whether the payload's digest and length are final; if not, nothing is decided by them."""
        tests = (t for t in self.tests if known or t[0] not in ("payload_digest", "payload_bytes"))
        return all(row[c] is not None and (kind is IsNotNull or TESTS[kind](row[c], value)) for c, kind, value in tests)

    def row(self, head: dict[str, str]) -> dict:
        """What the headers tell."""
        refers, page = head.get("warc-refers-to", "").strip("<>"), head.get("x-page-id", "")
        refers = refers.removeprefix(URN).split(":")[0] if refers.startswith(URN) else ""
        digest, length = head.get("warc-payload-digest"), head.get("x-payload-length", "")
        return {
            "record_type": head.get("warc-type"), "page_id": int(page) if page.lstrip("-").isdigit() else None,
            "url": urllib.parse.unquote(head["warc-target-uri"].strip("<>")) if "warc-target-uri" in head else None,
            "refers_to": int(refers) if refers.lstrip("-").isdigit() else None, "payload_digest": digest and digest.removeprefix("sha256:"),
            "payload_bytes": int(length) if length.isdigit() else None, "payload": None,
        }

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        if partition is None:  # there is no archive
            return
        rows, held = [], 0
        fs, name = filesystem(partition.path)
        packed = partition.path.endswith(".gz")
        with (fs.open_input_stream(name, compression=None) if packed else fs.open_input_file(name)) as raw, io.BufferedReader(Members(raw) if packed else raw, 1 << 20) as f:
            if not packed:
                to_first_record(f, partition.start)
            while (head := parse_headers(f, None if packed else partition.end)) is not None:
                if not head.get("content-length", "").isdigit():
                    raise ValueError(f"a record of {partition.path} has no length")
                size, row = int(head["content-length"]), self.row(head)
                told = row["payload_digest"] is not None and row["payload_bytes"] is not None or row["record_type"] == "revisit"
                if not self.wanted(row, told) or row["record_type"] == "revisit" or told and self.payload == "none":
                    skip(f, size)
                    if not self.wanted(row):
                        continue
                else:
                    block = f.read(size)
                    if len(block) < size:
                        raise ValueError(f"a block of {partition.path} ends early")
                    data = payload_of(block, head.get("content-type", ""))
                    row["payload_digest"], row["payload_bytes"] = hashlib.sha256(data).hexdigest(), len(data)
                    if not self.wanted(row):
                        continue
                    if self.payload == "full":
                        row["payload"] = data
                        held += len(data)
                rows.append(row)
                if len(rows) >= 2000 or held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    """spark.read.format("veilspan_warc").option("payload", "none" | "digest" | "full").option("list", path of a written archive list, or) load(path, ...)"""

    @classmethod
    def name(cls) -> str:
        return "veilspan_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        fs, root = filesystem(self.options["path"])
        info = fs.get_file_info(root)
        if "archives" in self.options:
            paths = [p for p in self.options["archives"].split("\n") if p]
        elif info.type == pyarrow.fs.FileType.Directory:
            paths = sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if f.path.endswith((".warc", ".warc.gz")))
            scheme = m[0] if (m := re.match(r"\w+://[^/]*", self.options["path"])) and not self.options["path"].startswith("file:") else ""
            paths = [scheme + p for p in paths]
        else:
            paths = [self.options["path"]]
        return WarcReader(paths, self.options.get("payload", "full"))


PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def read_warc(spark: SparkSession, path: str, archives: list[str] | None = None, payload: str = "full") -> DataFrame:
    """Records of the archives listed, or else of all under path.

    Spark lets Python sources take filters only with a setting of the session, which is turned on for good: the plan is
    made when the result is used.
    """
    if spark.conf.get(PUSHDOWN, "false") != "true":
        spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("veilspan_warc").option("payload", payload)
    if archives is not None:
        reader = reader.option("archives", "\n".join(archives))
    return reader.load(path)


def plan_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, record_type, refers_to: of equal payloads of at least `least` bytes only the first is stored.

    Only digests and ids are grouped; html moves once, to meet its record type.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select("page_id", F.col("url").cast("string").alias("url"), "html", F.sha2(payload, 256).alias("digest"))
    sizes = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= least)
    first = sizes.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    # written, so that the join below deals out both of its sides itself, and a digest of very many pages is split
    first = written(first.select(F.col("digest").alias("d"), "first"), "firsts")
    again = sizes.join(first, F.col("digest") == F.col("d")).where("page_id is null or page_id <> first")
    again = again.select(F.col("page_id").alias("id"), "d", "first").distinct()
    out = base.join(again, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")), "left")
    kind = F.when(F.col("first").isNull(), "response").otherwise("revisit")
    return out.select("page_id", "url", "html", kind.alias("record_type"), F.col("first").alias("refers_to"))


def archive(pages: DataFrame, payload: str = "digest") -> DataFrame:
    """Write the pages to archives in the shared folder and read all records back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    listed = write_warc(plan_records(pages), path)
    # One path for each archive of up to 256 MB reaches the driver: what a file listing holds as well.
    return read_warc(spark, path, [r["path"] for r in listed.select("path").collect()], payload)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = archive(table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same in SQL, for ids that are no null.
SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
  SELECT page_id, cast(strlen(h) AS bigint) AS payload_bytes, sha256(h) AS payload_digest,
    CASE WHEN strlen(h) >= {LEAST} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN strlen(h) >= {LEAST} AND page_id <> first THEN first END AS refers_to FROM p"""
