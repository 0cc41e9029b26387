"""WARC archives as a Spark data source: one gzip member per record, read sequentially and verified."""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from freshet.llm.shared import shared_dir, stored, table

#: Payloads shorter than this are never turned into revisits.
MIN_REVISIT = 100
#: Compressed bytes after which a writer begins the next file; a reader's task is one file.
FILE_BYTES = 64 << 20
_CHUNK = 1 << 16
SCHEMA = "record_id string, record_type string, target_uri string, page_id long, refers_to long, payload_digest string, payload_bytes long, payload binary"
_COLUMNS = ("record_id", "record_type", "target_uri", "page_id", "refers_to", "payload_digest", "payload_bytes")


class BadRecord(ValueError):
    """A record whose framing or digest doesn't hold; says the file and the offset of its gzip member."""


def _clean(value: str) -> str:
    """A header's value: line breaks would end it, so control characters and percent signs are percent-encoded."""
    return "".join(c if " " <= c != "%" and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _unclean(value: str) -> str:
    out, i = [], 0
    while i < len(value):
        if value[i] == "%" and i + 3 <= len(value):
            out.append(chr(int(value[i + 1 : i + 3], 16)))
            i += 3
        else:
            out.append(value[i])
            i += 1
    return "".join(out)


def record(row: dict) -> bytes:
    """One WARC/1.1 record as one gzip member.  A revisit carries the digest and length of a payload it doesn't hold."""
    block = b"" if row["record_type"] == "revisit" else bytes(row["payload"] or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:uuid:{row['record_id']}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Payload-Length: {row['payload_bytes']}",
    ]
    for name, key in (("WARC-Target-URI", "target_uri"), ("X-Page-Id", "page_id"), ("X-Refers-To-Page-Id", "refers_to")):
        if row[key] is not None:
            head.append(f"{name}: {_clean(str(row[key]))}")
    if row["record_type"] == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append(f"Content-Length: {len(block)}")
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(stream: io.RawIOBase) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member in turn; the stream is read and unpacked a chunk at a time."""
    offset = begin = 0
    left = b""
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            chunk = left or stream.read(_CHUNK)
            left = b""
            if not chunk:
                if parts or offset != begin:
                    raise BadRecord(f"the member at {begin} is cut short")
                return
            offset += len(chunk)
            try:
                parts.append(unpack.decompress(chunk))
            except zlib.error as e:
                raise BadRecord(f"the member at {begin}: {e}") from e
        left = unpack.unused_data
        offset -= len(left)
        yield begin, b"".join(parts)
        begin = offset


def parse(data: bytes) -> dict:
    """The record of one member: headers up to the blank line, framing by Content-Length, digests verified."""
    at = data.find(b"\r\n\r\n")
    if at < 0 or not data.startswith(b"WARC/1."):
        raise BadRecord("no WARC header")
    lines = data[:at].decode("utf-8").split("\r\n")[1:]
    head = {k.strip().lower(): v.strip(" \t") for k, _, v in (x.partition(":") for x in lines)}
    if not head.get("content-length", "").isdigit():
        raise BadRecord("no Content-Length")
    n = int(head["content-length"])
    block = data[at + 4 : at + 4 + n]
    if len(block) != n or data[at + 4 + n :] != b"\r\n\r\n":
        raise BadRecord(f"the block isn't framed by its {n} bytes")
    kind = head.get("warc-type")
    for name in ("warc-block-digest", "warc-payload-digest"):
        want = head.get(name, "")
        if want.startswith("sha256:") and (name == "warc-block-digest" or kind != "revisit") and hashlib.sha256(block).hexdigest() != want[7:]:
            raise BadRecord(f"{name} doesn't hold")
    number = lambda k: int(head[k]) if k in head else None
    return {
        "record_id": head.get("warc-record-id", "").removeprefix("<urn:uuid:").removesuffix(">"),
        "record_type": kind,
        "target_uri": _unclean(head["warc-target-uri"]) if "warc-target-uri" in head else None,
        "page_id": number("x-page-id"),
        "refers_to": number("x-refers-to-page-id"),
        "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha256:"),
        "payload_bytes": number("x-payload-length") if kind == "revisit" else n,
        "payload": None if kind == "revisit" else block,
    }


def read_file(fs: pafs.FileSystem, path: str) -> Iterator[dict]:
    with fs.open_input_stream(path, compression=None) as stream:
        for offset, data in members(stream):
            try:
                yield parse(data)
            except BadRecord as e:
                raise BadRecord(f"{path}, member at {offset}: {e}") from e


@dataclass
class WarcFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WarcReader(DataSourceReader):
    """A task for each file, streamed record by record."""

    def __init__(self, uri: str, payload: bool) -> None:
        self.uri, self.payload = uri, payload

    def partitions(self) -> list[WarcFile]:
        fs, path = pafs.FileSystem.from_uri(self.uri)
        found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        return [WarcFile(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and x.path.endswith(".warc.gz")]

    def read(self, partition: WarcFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without archives
            return
        fs, _ = pafs.FileSystem.from_uri(self.uri)
        schema = pa.schema([(c, pa.int64() if c in ("page_id", "refers_to", "payload_bytes") else pa.string()) for c in _COLUMNS] + [("payload", pa.binary())])
        rows: list[dict] = []
        size = 0
        for x in read_file(fs, partition.path):
            size += len(x["payload"] or b"") + 500
            rows.append(x if self.payload else x | {"payload": None})
            if size >= 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


class WarcWriter(DataSourceArrowWriter):
    """Task attempts write files of their own into a folder of this write, hidden until it commits: lost attempts leave nothing behind, and writes to one folder at a time don't meet."""

    def __init__(self, uri: str, file_bytes: int) -> None:
        self.uri, self.file_bytes = uri, file_bytes
        self.attempts = f".attempts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = pafs.FileSystem.from_uri(self.uri)
        fs.create_dir(f"{path}/{self.attempts}", recursive=True)
        files: list[tuple[str, str]] = []
        out = None
        written = 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    files.append((f"{path}/{self.attempts}/{name}", f"{path}/{name}"))
                    out, written = fs.open_output_stream(files[-1][0], compression=None), 0
                data = record(row)
                out.write(data)
                written += len(data)
                if written >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = pafs.FileSystem.from_uri(self.uri)
        for m in messages:
            for a, b in m.files if m else ():
                fs.move(a, b)
        self._clear(fs, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*pafs.FileSystem.from_uri(self.uri))

    def _clear(self, fs: pafs.FileSystem, path: str) -> None:
        if fs.get_file_info(f"{path}/{self.attempts}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{path}/{self.attempts}")


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")`` over a folder that driver and executors share.

    Options: payload ("false": payloads are verified but not returned),
    fileBytes (size at which a new file begins).
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(self.options["path"], int(self.options.get("filebytes", self.options.get("fileBytes", FILE_BYTES))))


def records(pages: DataFrame) -> DataFrame:
    """The records of ``pages(page_id, url, html)``: responses, and revisits of equal payloads.

    Of equal payloads of MIN_REVISIT bytes or more, the row with the smallest
    page_id is the response and all others refer to it; of rows that repeat that
    page_id with that payload the one with the smallest url is (null last), and
    of rows equal in all three one.  With no page_id among them all are
    responses.  A null html is an empty payload.  Only digests that stand more
    than once are joined back, so a digest that a third of the rows share is a
    large side that the engine can split, against one row.  Rows equal to a
    response are few or one page's: they are kept once and written as often as
    they stood.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").alias("target_uri"), html.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    place = F.struct(F.col("page_id"), F.col("target_uri").isNull().alias("no_uri"), "target_uri")
    long_enough = rows.where((F.col("payload_bytes") >= MIN_REVISIT) & F.col("page_id").isNotNull())
    everyone = rows.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy(F.col("payload_digest").alias("_digest")).agg(F.count("*").alias("_n"), F.min("page_id").alias("_first"))
    where = long_enough.groupBy(F.col("payload_digest").alias("_digest"), place.alias("_place")).agg(F.count("*").alias("_same"))
    least = where.groupBy("_digest").agg(F.min(F.struct("_place", "_same")).alias("_least"))
    first = stored(everyone.where("_n > 1 and _first is not null").join(least, "_digest").select("_digest", "_first", F.col("_least._place.target_uri").alias("_uri"), F.col("_least._same").alias("_same")))
    met = rows.join(first, F.col("payload_digest") == F.col("_digest"), "left")
    leads = (F.col("page_id") == F.col("_first")) & F.col("target_uri").eqNullSafe(F.col("_uri"))

    def as_records(part: DataFrame, revisit: Column) -> DataFrame:
        return part.select(
            F.uuid().alias("record_id"),
            F.when(revisit, "revisit").otherwise("response").alias("record_type"),
            "target_uri",
            "page_id",
            F.when(revisit, F.col("_first")).alias("refers_to"),
            "payload_digest",
            "payload_bytes",
            F.when(~revisit, F.col("payload")).alias("payload"),
        )

    equal = F.coalesce(leads & (F.col("_same") > 1), F.lit(False))
    plain = as_records(met.where(~equal), F.col("_first").isNotNull() & ~F.coalesce(leads, F.lit(False)))
    if first.where("_same > 1").isEmpty():
        return plain
    once = met.where(equal).dropDuplicates(["payload_digest"]).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_same"))))
    return plain.unionByName(as_records(once, F.col("_copy") > 1))


def write(recs: DataFrame, uri: str) -> None:
    recs.sparkSession.dataSource.register(WarcSource)
    recs.write.format("warc").mode("append").save(uri)


def read(spark: SparkSession, uri: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(uri)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = shared_dir(spark) + "/archives"
    write(records(table(spark, sf_dir, "pages")), uri)
    return read(spark, uri, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH d AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, payload_bytes >= {MIN_REVISIT} AND min(page_id) OVER (PARTITION BY payload_digest) IS NOT NULL
                AND row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS LAST) > 1 AS again,
             min(page_id) OVER (PARTITION BY payload_digest) AS page FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN page END AS refers_to
FROM f"""
