"""WARC files: a writer, and a Python data source that plans and prunes.

The source gives one partition per planned span of files, takes filters on record_type
and page_id, parses a record's headers first, and passes over the payload of a record
that a filter rejects or whose payload column isn't asked for (``payload=false``).
Files are WARC/1.1, a gzip member a record; a revisit names its response by WARC-Refers-To and has no
block; its payload's length and digest stand in its header.

Defined cases: null html is an empty payload; a null url is written as an empty one;
rows with a null page_id are kept, never the response of others unless all of a
payload are null; rows that repeat a page_id and payload are all written, one
response's id serving the others; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from attesta.llm.common import table
from attesta.llm.token_files import _fs
from attesta.settings import shared_folder, written

SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
ROLL = 64 << 20  # bytes after which a task starts another file
LEVEL = 1  # of gzip: a page shrinks to a fraction, and a higher level costs more time than it saves bytes


def record(page_id, url, kind, html: bytes, refers) -> bytes:
    digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + html if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2000-01-01T00:00:00Z",
            f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(html)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers is None else refers}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_warcs(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes one record per row and returns the manifest (path, bytes). Payloads of under ``least`` bytes are never revisits."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    first = rows.groupBy(F.col("sha").alias("same")).agg(F.max("page_id").alias("top"))
    rows = rows.join(first, F.col("sha") == F.col("same")).drop("same", "sha")
    kind = F.when((F.length("html") < least) | F.col("page_id").eqNullSafe(F.col("top")), "response").otherwise("revisit")
    rows = rows.withColumn("kind", kind)

    def task(batches):
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        out, n, name = None, 0, ""
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, n = fs.open_output_stream(f"{base}/{name}", compression=None), 0
                n += out.write(gzip.compress(record(r["page_id"], r["url"], r["kind"], r["html"], r["top"]), LEVEL, mtime=0))
                if n >= ROLL:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": pa.array([n], pa.int64())})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": pa.array([n], pa.int64())})

    return written(rows.select("page_id", "url", "html", "top", "kind").mapInArrow(task, "path string, bytes long"), "warc-manifest")


class Span(InputPartition):
    def __init__(self, paths):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.options, self.types, self.pages = options, None, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("record_type",):
                self.types = {f.value} if self.types is None else self.types & {f.value}
            elif isinstance(f, EqualTo) and f.attribute == ("page_id",):
                self.pages = {f.value} if self.pages is None else self.pages & {f.value}
            else:
                yield f

    def partitions(self):
        """Files in order of size, dealt out to the lightest span."""
        fs, base = _fs(self.options["list"])
        names = [x for x in fs.open_input_stream(base).read().decode().split("\n") if x]
        most = int(self.options.get("spans", "64"))
        spans = [names[i::most] for i in range(min(most, len(names)))]
        return [Span(x) for x in spans] or [Span([])]

    def read(self, partition):
        wanted = self.options.get("payload", "true") == "true"
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0
        for path in partition.paths:
            fs, base = _fs(path)
            with fs.open_input_stream(base, buffer_size=1 << 20, compression=None) as f, gzip.GzipFile(fileobj=f, mode="rb") as plain:
                for row in self._records(plain, wanted):
                    rows.append(row)
                    held += 200 + len(row["payload"] or b"")
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _records(self, f, wanted):
        buffer, at = b"", 0
        while True:
            while (stop := buffer.find(b"\r\n\r\n", at)) < 0:
                more = f.read(1 << 20)
                if not more:
                    return
                buffer, at = buffer[at:] + more, 0
            head = dict(x.split(": ", 1) for x in buffer[at:stop].decode().split("\r\n")[1:])
            at, length = stop + 4, int(head["Content-Length"])
            number = lambda name: int(head[name][10:-1]) if head.get(name, "<urn:page:>") != "<urn:page:>" else None
            row = {"page_id": number("WARC-Record-ID"), "url": unquote(head["WARC-Target-URI"]), "record_type": head["WARC-Type"], "payload_bytes": int(head["X-Payload-Length"]),
                   "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": number("WARC-Refers-To"), "payload": None}
            asked = (self.types is None or row["record_type"] in self.types) and (self.pages is None or row["page_id"] in self.pages)
            need = length + 4
            if len(buffer) - at < need:
                if asked and wanted:
                    buffer, at = buffer[at:] + f.read(need - (len(buffer) - at)), 0
                else:
                    left = need - (len(buffer) - at)
                    while left > 0 and (x := f.read(min(left, 1 << 20))):
                        left -= len(x)
                    buffer, at, need = b"", 0, 0
            if asked and wanted and length:
                block = buffer[at:at + length]
                row["payload"] = block[block.index(b"\r\n\r\n") + 4:]
            at += need
            if asked:
                yield row


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "attesta_warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))


def read_warcs(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """Records of the manifest's files; the list of paths (one a file of megabytes) goes to a shared file."""
    spark = manifest.sparkSession
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    path = f"{shared_folder(spark)}/warc-list-{uuid.uuid4().hex}"
    fs, base = _fs(path)
    with fs.open_output_stream(base) as out:
        for row in manifest.select("path").toLocalIterator():
            out.write((row["path"] + "\n").encode())
    return spark.read.format("attesta_warc").option("list", path).option("payload", str(payload).lower()).option(
        "spans", str(4 * spark.sparkContext.defaultParallelism)).load()


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warcs(table(spark, sf_dir, "pages"), f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    return read_warcs(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
