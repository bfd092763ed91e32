"""WARC archives of pages: written as whole-file gzip, normalised to a gzip member per record.

Spark's text writer writes the records, so an archive is one gzip stream, as many crawlers
leave them, in which no record can be reached without reading all before it. The normaliser
inflates each stream once, cuts it into records by their Content-Length, compresses every
record as a member of its own, and writes the members one after the other with an index of
offsets beside them. Through the index any record is read by itself.

All files are written by Spark's committers and the stream is read by Spark's reader, so
they may lie on any store that Spark knows. Reading by offsets opens files by pyarrow.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, cut, shared_folder

#: Fixed values of the format: what ends a record and begins the next, and the profile of a revisit.
END, START = b"\r\n\r\n", b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a payload from which on equal ones are written once.
LEAST_BYTES = 1_000
#: The date of records of pages that have none.
DATE = "1970-01-01T00:00:00Z"
#: Groups of equal payloads that are broadcast at most; beyond, they are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Bytes that a task handles at once, and that a task reads of the archives in all.
BATCH_BYTES, TASK_BYTES = 4 << 20, 64 << 20
#: Bytes of an archive that are read at once.
READ_BYTES = 8 << 20
_INDEX = "record_type string, record_id string, refers_to string, payload_digest string, payload_bytes long, offset long, length long"


def _with_latest(rows: DataFrame, least: int, most: int) -> DataFrame:
    """rows (page_id, size, digest, ...) with `latest`: the largest page_id with the payload, null where nothing repeats it."""
    groups = cut(
        rows.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("count")).where("count > 1")
    )
    seen = groups.agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("rows")).first()
    side = groups.select("digest", "latest")
    if seen["n"] <= most:
        return rows.join(F.broadcast(side), "digest", "left")
    hot = groups.where(F.col("count") > seen["rows"] / HOT_SHARE)  # fewer than HOT_SHARE
    marked = rows.join(F.broadcast(hot.select("digest", "latest", F.lit(True).alias("hot"))), "digest", "left")
    cold = marked.where("hot IS NULL").drop("latest", "hot").join(side, "digest", "left")
    return marked.where("hot").drop("hot").unionByName(cold)


def _record(date: str) -> Column:
    """The text of a record without its last line feed, of page_id, url, body, size, digest and latest."""
    name = lambda c: F.coalesce(F.concat(F.lit("<urn:x-page:"), F.url_encode(F.col(c).cast("string")), F.lit(">")), F.lit("<urn:x-no-page>"))
    revisit = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), name("page_id"),
        F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), uri), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), name("latest"), F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"),
        F.lit("\r\n\r\n"), http, F.when(revisit, F.lit("")).otherwise(F.col("body")),
        F.lit("\r\n\r"),
    )


def write(pages: DataFrame, folder: str, least: int = LEAST_BYTES, date: str = DATE, most: int = BROADCAST_ROWS) -> None:
    """Write a record per page into `folder`, each file one gzip stream.

    pages needs page_id, url and html; other columns are ignored. Null html is an empty
    payload, a null url leaves the target out. Of the rows with equal payloads of at least
    `least` bytes those with the largest page_id are responses, the others, null ids too,
    revisit it without a payload; where all ids are null all are responses, as are rows that
    repeat the largest id. An empty table gives archives without records.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), body.alias("body"), F.octet_length(body).cast("long").alias("size"), F.sha1(body.cast("binary")).alias("digest"))
    known = _with_latest(rows, least, most)
    known.select(_record(date).alias("value")).write.option("compression", "gzip").option("lineSep", "\n").text(folder)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


class Cutter:
    """Cuts a stream, fed in pieces of any size, into records; holds one record at most and the piece fed."""

    def __init__(self):
        self.parts, self.have, self.need, self.fields = [], 0, 0, None

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.parts.append(piece)
        self.have += len(piece)
        if self.have < self.need:
            return
        data, at = b"".join(self.parts), 0
        while True:
            if self.fields is None:
                head = data.find(END, at)
                if head < 0:
                    break
                if not data.startswith(START, at):
                    raise ValueError(f"no record starts with {data[at : at + 40]!r}")
                self.fields = _fields(data[at:head])
                self.need = head - at + len(END) + int(self.fields["content-length"]) + len(END)
            if len(data) - at < self.need:
                break
            record = data[at : at + self.need]
            if not record.endswith(END):
                raise ValueError(f"record {self.fields.get('warc-record-id')} doesn't end where its Content-Length says")
            yield self.fields, record
            at += self.need
            self.fields, self.need = None, 0
        self.parts, self.have = [data[at:]], len(data) - at

    def end(self) -> None:
        if self.have:
            raise ValueError(f"the archive ends within a record, {self.have} bytes after its start")


def _id(name: str | None) -> str | None:
    """The page id of a record's name, as text; null for none."""
    start = "<urn:x-page:"
    return unquote_plus(name[len(start) : -1]) if name and name.startswith(start) else None


def _described(fields: dict[str, str], record: bytes) -> dict:
    """What the index tells of a record."""
    head = record.find(END) + len(END)
    http = record.find(END, head)
    return {
        "record_type": fields["warc-type"],
        "record_id": _id(fields["warc-record-id"]),
        "refers_to": _id(fields.get("warc-refers-to")),
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
        "payload_bytes": int(_fields(record[head:http])["content-length"]),
    }


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite the whole-file gzip archives of `source` with a member per record, into `target`; returns the index.

    `target`/archives holds the files, each a sequence of gzip members; a zero byte may pad
    a member, as gzip readers allow. `target`/index holds a row per record: its file, offset
    and length, type, ids, payload digest and bytes. A stream is inflated once: members go
    to the shared checkpoint folder before they are written. Members don't depend on the
    time of writing. Archives without records give an empty index. A damaged archive is an
    error that names the record.
    """
    between = (END + START).decode()
    pieces = spark.read.option("lineSep", between).text(source).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, file, cutter = [], 0, None, Cutter()
        for batch in batches:
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
                piece = piece.as_py()
                if name != file:
                    cutter.end()
                    file, cutter = name, Cutter()
                else:
                    piece = END + START + piece
                for fields, record in cutter.feed(piece):
                    packer = zlib.compressobj(wbits=31)
                    member = packer.compress(record) + packer.flush()
                    # the writer ends each with a zero byte: the member's last one, or padding
                    rows.append(_described(fields, record) | {"line": member[:-1] if member[-1] == 0 else member, "length": len(member)})
                    size += len(member)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=members)
                    rows, size = [], 0
        cutter.end()
        yield pa.RecordBatch.from_pylist(rows, schema=members)

    text, number = pa.string(), pa.int64()
    members = pa.schema(
        {"record_type": text, "record_id": text, "refers_to": text, "payload_digest": text, "payload_bytes": number, "line": pa.binary(), "length": number}
    )
    packed = cut(pieces.mapInArrow(run, "record_type string, record_id string, refers_to string, payload_digest string, payload_bytes long, line binary, length long"))
    packed.select(F.col("line").cast("string").alias("value")).write.option("lineSep", "\0").text(f"{target}/archives")

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            steps = batch.column("on_disk").to_pylist()
            starts = []
            for s in steps:
                starts.append(at)
                at += s
            columns = [pa.array([part] * len(steps), pa.int32()), *batch.columns[:-1], pa.array(starts, number)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", *batch.schema.names[:-1], "offset"])

    # partition k of the members is file part-k
    placed = packed.select("record_type", "record_id", "refers_to", "payload_digest", "payload_bytes", "length", (F.octet_length("line") + 1).cast("long").alias("on_disk"))
    placed = placed.mapInArrow(offsets, "part int, record_type string, record_id string, refers_to string, payload_digest string, payload_bytes long, length long, offset long")
    files = spark.read.format("binaryFile").load(f"{target}/archives").select(F.col("path").alias("file"), F.regexp_extract("path", r"/part-(\d+)-[^/]*$", 1).cast("int").alias("part"))
    placed.join(files, "part").drop("part").write.parquet(f"{target}/index")
    return spark.read.parquet(f"{target}/index")


def _open(file: str):
    """A file that Spark names by `file:/...`, `s3a://...` or the like."""
    scheme, _, rest = file.partition(":")
    store, path = FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{rest.removeprefix('//')}")
    return store.open_input_file(path)


def read(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records that `index` (rows of an archive's index) points to, each read by its offset.

    (record_id, record_type, refers_to, target_uri, payload_bytes, payload_digest, payload):
    ids as text, payload binary, null for revisits, left out if not wanted. Bytes and digest
    of a response are its payload's own; a record whose payload isn't what its digest says
    is an error. An empty index gives an empty table.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, total // TASK_BYTES)
    places = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    text = pa.string()
    schema = pa.schema({"record_id": text, "record_type": text, "refers_to": text, "target_uri": text, "payload_bytes": pa.int64(), "payload_digest": text, "payload": pa.binary()})
    if not payload:
        schema = schema.remove(6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, name, file, ahead, start = [], 0, None, None, b"", 0
        for batch in batches:
            for place in batch.to_pylist():
                if place["file"] != name:
                    name, ahead = place["file"], b""
                    file = _open(name)
                at = place["offset"] - start
                if not (ahead and 0 <= at and at + place["length"] <= len(ahead)):
                    start, at = place["offset"], 0
                    ahead = file.read_at(max(READ_BYTES, place["length"]), start)
                record = zlib.decompress(memoryview(ahead)[at : at + place["length"]], wbits=31)
                rows.append(_row(record))
                size += len(record)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    names = "record_id string, record_type string, refers_to string, target_uri string, payload_bytes long, payload_digest string"
    return places.mapInArrow(run, names + (", payload binary" if payload else ""))


def _row(record: bytes) -> dict:
    head = record.find(END)
    fields = _fields(record[:head])
    row = _described(fields, record) | {"target_uri": fields.get("warc-target-uri"), "payload": None}
    if row["record_type"] == "response":
        body = record[record.find(END, head + len(END)) + len(END) : -len(END)]
        found = hashlib.sha1(body).hexdigest()
        if found != row["payload_digest"]:
            raise ValueError(f"payload of {fields['warc-record-id']} has the digest {found}")
        row |= {"payload": body, "payload_bytes": len(body)}
    return row


def through_archives(pages: DataFrame, folder: str | None = None, **settings) -> DataFrame:
    """pages written as archives, normalised and read back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    `folder` must not exist; by default a new one in the shared checkpoint folder. Rows are as
    `write` and `read` say; ids have page_id's type again.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    write(pages, f"{folder}/raw", **settings)
    index = normalise(pages.sparkSession, f"{folder}/raw", folder)
    kind = dict(pages.dtypes)["page_id"]
    ids = [F.col(c).cast(kind).alias(out) for c, out in (("record_id", "page_id"), ("refers_to", "refers_to"))]
    return read(index, payload=False).select(ids[0], "payload_bytes", "payload_digest", "record_type", ids[1])
