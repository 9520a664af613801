"""WARC files as a Spark data source, ``format("warc")``, for reading and writing.

Reading plans partitions from the file listing: small files share a partition, a large one has
its own. Predicates on ``warc_type`` and on the other header columns are pushed into the scan: a
record's WARC header is parsed first, and unless it passes, the payload is skipped: by a seek in
a plain file, by discarding undecoded bytes in a compressed one. Predicates on ``http_status``
are checked once the HTTP header is parsed, before the body is decoded. With option
``payload=false`` no body is decoded at all.

Columns: warc_type, record_id, target_uri, warc_date, content_type, content_length (of the record
block), headers (all WARC fields, names in lower case), http_status, http_headers, payload, file
and offset. For an ``application/http`` response the payload is the body after transfer and
content decoding; else it is the record block.

Spark keeps the reader that predicates were pushed into with the DataFrame, and a later query on
the same DataFrame that has no predicate would find it. So pushing is an option, ``pushdown``,
which ``scan`` sets: it reads anew and always has its condition.

A file is read up to its first damage: a record with no valid version line or length, one that
ends before its length, bytes that no gzip decoder takes, after the last member or within one. The
option ``mode`` is ``permissive`` (the records before are given, the default) or ``failfast`` (an error
names the place). Zero bytes after the last member are padding. A header field that is missing is
null; a field that repeats keeps its last value; an HTTP status of other than at most nine ASCII
digits is null; an empty file or folder has no records. Very long records are read whole, one at a
time; equal records are given each.

A file is never split: where a record starts in a plain file can't be told from payload that
looks alike. The writer ends files at ``WarcWriter.LIMIT`` bytes, half the share of a partition.
Paths are those of the session, ``s3a://`` too.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

SCHEMA = (
    "warc_type string, record_id string, target_uri string, warc_date string, content_type string, content_length long, "
    "headers map<string,string>, http_status int, http_headers map<string,string>, payload binary, file string, offset long"
)
_FIELDS = {
    "warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "content_type": "content-type",
}
_TESTS = {
    EqualTo: lambda x, v: x is not None and x == v,
    EqualNullSafe: lambda x, v: x == v,
    In: lambda x, v: x in v,
    IsNotNull: lambda x, _: x is not None,
    StringStartsWith: lambda x, v: x is not None and x.startswith(v),
    StringEndsWith: lambda x, v: x is not None and x.endswith(v),
    StringContains: lambda x, v: x is not None and v in x,
    GreaterThan: lambda x, v: x is not None and x > v,
    GreaterThanOrEqual: lambda x, v: x is not None and x >= v,
    LessThan: lambda x, v: x is not None and x < v,
    LessThanOrEqual: lambda x, v: x is not None and x <= v,
}
_ARROW = pa.schema([
    ("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()),
    ("content_type", pa.string()), ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())),
    ("http_status", pa.int32()), ("http_headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
    ("file", pa.string()), ("offset", pa.int64()),
])


_NUMBER = re.compile(r"[0-9]{1,18}")


class Damaged(ValueError):
    """The file can't be read further."""


def uri(path: str) -> str:
    """The path as a URI that Arrow knows."""
    path = re.sub(r"^s3[an]://", "s3://", path)
    return path if "://" in path or path.startswith("file:") else "file://" + path


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri(path))


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths):
        self.paths = paths


class _Plain:
    """Records of a plain file: what isn't wanted is passed over by a seek."""

    def __init__(self, raw):
        self.raw, self.at = raw, 0
        self.size = raw.seek(0, io.SEEK_END)
        raw.seek(0)

    def line(self) -> bytes:
        got = self.raw.readline()
        self.at += len(got)
        return got

    def take(self, n: int) -> bytes:
        got = self.raw.read(n)
        self.at += len(got)
        return got

    def skip(self, n: int) -> bool:
        """Whether there was as much."""
        whole = self.at + n <= self.size
        self.at = min(self.size, self.at + n)
        self.raw.seek(self.at)
        return whole

    def offset(self) -> int:
        return self.at


class _Zipped:
    """Records of a file of gzip members; offsets are those of the member that a record starts."""

    def __init__(self, raw):
        self.raw, self.member, self.consumed = raw, 0, 0
        self.unzip, self.left, self.have, self.at = None, b"", b"", 0

    def _more(self) -> bool:
        while True:
            if self.unzip is None:
                while not self.left.lstrip(b"\0"):  # padding
                    self.consumed += len(self.left)
                    self.left = self.raw.read(1 << 18)
                    if not self.left:
                        return False
                self.consumed += len(self.left) - len(self.left.lstrip(b"\0"))
                self.left = self.left.lstrip(b"\0")
                self.unzip, self.member = zlib.decompressobj(31), self.consumed
            if not self.left:
                self.left = self.raw.read(1 << 18)
                if not self.left:
                    return False
            try:
                got = self.unzip.decompress(self.left)
            except zlib.error as why:
                raise Damaged(f"the gzip member at {self.member} can't be decoded: {why}") from why
            rest = self.unzip.unused_data
            self.consumed += len(self.left) - len(rest)
            self.left = rest
            if self.unzip.eof:
                self.unzip = None
            if got:
                self.have = self.have[self.at :] + got
                self.at = 0
                return True

    def line(self) -> bytes:
        while (end := self.have.find(b"\n", self.at)) < 0:
            if not self._more():
                end = len(self.have) - 1
                break
        got = self.have[self.at : end + 1]
        self.at = end + 1
        return got

    def take(self, n: int) -> bytes:
        while len(self.have) - self.at < n and self._more():
            pass
        got = self.have[self.at : self.at + n]
        self.at += len(got)
        return got

    def skip(self, n: int) -> bool:
        """Whether there was as much."""
        while n > len(self.have) - self.at:
            n -= len(self.have) - self.at
            self.have, self.at = b"", 0
            if not self._more():
                return False
        self.at += n
        return True

    def offset(self) -> int:
        return self.member


def _fields(read_line) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    while (line := read_line().rstrip(b"\r\n")) != b"":
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and last:
            out[last] += " " + text.strip()
        elif ":" in text:
            name, value = text.split(":", 1)
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def http(block: bytes) -> tuple[int | None, dict[str, str], int]:
    """Status, headers and where the body starts."""
    head = io.BytesIO(block)
    first = head.readline().split()
    status = int(first[1]) if len(first) > 1 and first[0].startswith(b"HTTP/") and re.fullmatch(rb"[0-9]{1,9}", first[1]) else None
    return status, _fields(head.readline), head.tell()


def body(raw: bytes, headers: dict[str, str]) -> bytes:
    """The body after transfer and content decoding; as it is where it can't be decoded."""
    if "chunked" in headers.get("transfer-encoding", "").lower():
        out, at = [], 0
        try:
            while (n := int(raw[at : (end := raw.index(b"\r\n", at))].split(b";")[0], 16)) > 0:
                out.append(raw[end + 2 : end + 2 + n])
                at = end + 4 + n
            raw = b"".join(out)
        except ValueError:
            pass
    coding = headers.get("content-encoding", "").lower()
    try:
        if coding in ("gzip", "x-gzip"):
            raw = gzip.decompress(raw)
        elif coding == "deflate":
            raw = zlib.decompress(raw, -15 if raw[:1] != b"\x78" else 15)
    except (OSError, zlib.error, EOFError):
        pass
    return raw


def records(raw, zipped: bool, wanted=lambda name, value: True, payload: bool = True, failfast: bool = False):
    """Rows of one open file, without file name; ``wanted(column, value)`` is asked as each is known."""
    try:
        yield from _records(_Zipped(raw) if zipped else _Plain(raw), zipped, wanted, payload)
    except Damaged:
        if failfast:
            raise


def _records(at, zipped, wanted, payload):
    while True:
        while (line := at.line()) in (b"\r\n", b"\n"):
            pass
        if not line:
            return
        offset = at.offset() if zipped else at.offset() - len(line)
        head = _fields(at.line) if line.startswith(b"WARC/") else {}
        length = head.get("content-length", "")
        if not _NUMBER.fullmatch(length):
            raise Damaged(f"no WARC record at offset {offset}")
        n = int(length)
        known = {c: head.get(f) for c, f in _FIELDS.items()} | {"content_length": n}
        if not all(wanted(c, v) for c, v in known.items()):
            if not at.skip(n):
                raise Damaged(f"the record at offset {offset} ends early")
            continue
        is_http = (known["content_type"] or "").startswith("application/http") and known["warc_type"] == "response"
        status, fields, data = None, None, None
        if is_http or payload:
            block = at.take(n)
            if len(block) < n:
                raise Damaged(f"the record at offset {offset} ends early")
            if is_http:
                status, fields, start = http(block)
                if not wanted("http_status", status):
                    continue
                data = body(block[start:], fields) if payload else None
            else:
                data = block
        elif not at.skip(n):
            raise Damaged(f"the record at offset {offset} ends early")
        if not is_http and not wanted("http_status", None):
            continue
        yield (*known.values(), list(head.items()), status, None if fields is None else list(fields.items()), data, offset)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.failfast = options.get("mode", "permissive").lower() == "failfast"
        self.push = options.get("pushdown", "false").lower() == "true"
        self.share = int(options.get("maxpartitionbytes", 128 << 20))
        self.tasks = int(options.get("tasks", 0))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if self.push and type(f) in _TESTS and name in (*_FIELDS, "content_length", "http_status"):
                self.tests.append((name, type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        fs, path = _fs(self.path)
        found = fs.get_file_info(path)
        every = [found] if found.is_file else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in every if f.is_file and not any(p[:1] in "_." for p in f.path[len(path) :].split("/") if p))
        share = min(self.share, max(1 << 20, sum(n for _, n in files) // self.tasks)) if self.tasks else self.share
        out, size = [Files([])], 0
        for name, n in files:
            if size and size + n > share:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(name)
            size += n
        return out

    def read(self, partition):
        fs, _ = _fs(self.path)

        def wanted(column, value):
            return all(_TESTS[kind](value, v) for c, kind, v in self.tests if c == column)

        held, size = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                zipped = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                for row in records(io.BufferedReader(raw, 1 << 18), zipped, wanted, self.payload, self.failfast):
                    held.append((*row[:-1], path, row[-1]))
                    size += 500 + len(row[-2] or b"")
                    if size > 8 << 20:
                        yield _batch(held)
                        held, size = [], 0
        if held:
            yield _batch(held)


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


def encode(kind: str, uri: str | None, date: str | None, content_type: str | None, payload: bytes, extra=(), record_id: str | None = None) -> bytes:
    """One WARC record. Line breaks in header values become blanks."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id or f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date or "1970-01-01T00:00:00Z")]
    fields += [("WARC-Target-URI", uri)] if uri is not None else []
    fields += [("Content-Type", content_type)] if content_type is not None else []
    fields += list(extra)
    head = "".join(f"{k}: {' '.join(str(v).splitlines())}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(payload) + payload + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of warc_type, target_uri, warc_date, content_type, headers and payload.

    Each record is a gzip member. Tasks write into a staging folder of the target; the commit moves
    the files of the attempts that count, so failed and repeated tasks leave nothing.
    """

    LIMIT = 64 << 20

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.level = int(options.get("level", 1))

    def write(self, iterator):
        fs, path = _fs(self.path)
        stage = f"{path}/_staging-{self.job}"
        fs.create_dir(stage, recursive=True)
        out, names, size = None, [], 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > self.LIMIT:
                    if out:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{stage}/{names[-1]}", compression=None), 0
                extra = dict(row.get("headers") or {})
                made = gzip.compress(
                    encode(row["warc_type"], row.get("target_uri"), row.get("warc_date"), row.get("content_type"), row.get("payload") or b"", extra.items()),
                    self.level, mtime=0,
                )
                out.write(made)
                size += len(made)
        if out:
            out.close()
        return Written(names)

    def commit(self, messages):
        fs, path = _fs(self.path)
        stage = f"{path}/_staging-{self.job}"
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
                if f.path.rstrip("/").split("/")[-1] != f"_staging-{self.job}":
                    (fs.delete_dir if f.type == pafs.FileType.Directory else fs.delete_file)(f.path)
        fs.create_dir(path, recursive=True)
        for m in messages:
            for name in m.paths if m else ():
                fs.move(f"{stage}/{name}", f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages):
        fs, path = _fs(self.path)
        if fs.get_file_info(f"{path}/_staging-{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{path}/_staging-{self.job}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``format("warc")`` known to the session and lets Python sources take predicates."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    """All records below ``path``. A partition holds as many bytes as Spark's own file sources would give it."""
    register(spark)
    if "maxpartitionbytes" not in options:
        most = spark.conf.get("spark.sql.files.maxPartitionBytes").lower()
        n = re.fullmatch(r"([0-9]+)([kmgt]?)b?", most)
        options["maxpartitionbytes"] = int(n[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[n[2]] if n else 128 << 20
        options["tasks"] = spark.sparkContext.defaultParallelism
    return spark.read.format("warc").options(**options).load(path)


def scan(spark: SparkSession, path: str, condition: str, **options) -> DataFrame:
    """Records that meet the condition, which is pushed down as far as headers decide it."""
    return read_warc(spark, path, pushdown="true", **options).filter(condition)


def write_warc(df: DataFrame, path: str, mode: str = "append") -> None:
    register(df.sparkSession)
    df.write.format("warc").mode(mode).save(path)


def page_records(pages: DataFrame) -> DataFrame:
    """A request, a response and a metadata record of each page; a null html has no response."""
    url = F.coalesce("url", F.lit(""))
    html = F.encode(F.col("html"), "utf-8")
    head = F.format_string("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n", F.octet_length("html"))
    ids = F.when(F.col("page_id").isNotNull(), F.create_map(F.lit("X-Page-ID"), F.col("page_id").cast("string")))

    def record(kind, content_type, payload):
        return F.struct(F.lit(kind).alias("warc_type"), F.lit(content_type).alias("content_type"), payload.alias("payload"))

    kinds = F.array(
        record("request", "application/http; msgtype=request", F.encode(F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1\r\n\r\n")), "utf-8")),
        record("response", "application/http; msgtype=response", F.concat(F.encode(head, "utf-8"), html)),
        record("metadata", "application/warc-fields", F.encode(F.lit("fetchTimeMs: 0\r\n"), "utf-8")),
    )
    return pages.select("url", ids.alias("headers"), F.explode(kinds).alias("r")).filter("r.payload is not null").select(
        "r.warc_type", F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("warc_date"), "r.content_type", "headers", "r.payload"
    )


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """``(page_id, url, html)`` of the responses, after the pages were written to ``path`` as WARC files.

    Pages of a null html have no response. A null page_id or url comes back as null, an empty html
    as empty; line breaks within a url as blanks. Very long pages are one record each; repeated
    rows come back as often. An empty table gives an empty result; other columns, of whatever
    names, are left out; page_id is a whole number.
    """
    write_warc(page_records(pages), path)
    return scan(pages.sparkSession, path, "warc_type = 'response' and http_status = 200").select(
        F.col("headers")["x-page-id"].cast("long").alias("page_id"), F.col("target_uri").alias("url"), F.decode("payload", "utf-8").alias("html")
    )
