"""WARC archives: pages written as records, whole-file gzip turned into one member a record, and records read back by an offset index.

``write_archives`` writes records as Spark writes text: a file is one gzip stream from end to end, of which nothing can be read without all that
is before it. ``normalise`` inflates each such stream once, from its start to its end, compresses every record as a gzip member of its own, and returns
(and stores) where each member lies. ``read_records`` then reads any records by that index, and checks payloads against their digests.

A page whose payload another page has too is a ``revisit`` that names the page that keeps it, the one of largest page_id; the others are
``response``.

Scale: payloads are shuffled only if the payloads that occur more than once are too many to broadcast, once then; a payload that a third of all pages
have is split by adaptive execution, as nothing has to have its rows together. Streams pass through a task in pieces, so it holds one record
at a time. Files are read through Spark and written through Arrow's file systems, into a folder that all executors share, under a name of
their own for each attempt of a task: only the attempt that Spark accepts gets into the index, so lost executors leave files that
nothing refers to, no half archives.

Defined cases: a null payload is an empty one; a null page_id is a revisit where any page of its payload has an id, else a response; rows that
repeat the largest page_id of their payload are responses all of them; a null url leaves out the target; line ends in a url are
written %0D and %0A; a very long payload is a record like any other; an empty table gives no record; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, cut, small_batches, text_of

CRLF, GAP = "\r\n", "\r\n\r\n"
#: Fixed values of the format: version, profile of a revisit, digits of base 32.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes of archive that a task reads back at least.
STRETCH = 64 << 20
INDEX = "archive string, offset long, length long, record_id string, page_id long, record_type string, url string, payload_digest string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def base32(sha1_hex: Column) -> Column:
    """40 hexadecimal digits in base 32: eight digits at a time for ten."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    parts = [F.lpad(F.conv(F.substring(sha1_hex, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*parts)), digits, BASE32)


def decided(pages: DataFrame, space: Workspace, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, sha256, keep: the page that keeps the payload, null where the page does so itself.

    Payloads that occur more than once are stored first, by their hashes, so that Spark knows how many they are before it deals out all pages.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), text_of(html).alias("payload"))
    rows = rows.withColumn("sha256", F.sha2(F.col("payload").cast("binary"), 256))
    shared = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha256").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("pages"))
    shared = space.write(shared.where("pages > 1").select(F.col("sha256").alias("of"), "largest"), "shared")
    rows = rows.join(shared, F.col("sha256") == F.col("of"), "left")
    own = F.col("largest").eqNullSafe(F.col("page_id"))
    return rows.select("page_id", "url", "payload", "sha256", F.when(~own, F.col("largest")).alias("keep"))


def _record_id(page_id: Column, sha256: Column) -> Column:
    """The same for the same page and payload, whoever computes it."""
    h = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("")), sha256).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A line of a head, nothing for a null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def records(rows: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """value: a record of each row of :func:`decided`, without the gap that follows it."""
    revisit = F.col("keep").isNotNull()
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}"), _field("Content-Length", F.octet_length("payload")), F.lit(CRLF))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit(VERSION + CRLF),
        _field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("sha256"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", target),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.sha1(F.col("payload").cast("binary"))))),
        F.when(revisit, F.concat(_field("WARC-Profile", F.lit(SAME_PAYLOAD)), _field("WARC-Refers-To", _record_id(F.col("keep"), F.col("sha256"))), _field("Refers-To-Page-Id", F.col("keep")))).otherwise(F.lit("")),
        _field("Page-Id", F.col("page_id")),
        _field("Content-Type", F.lit("application/http;msgtype=response")),
    )
    return rows.select(head.alias("head"), block.alias("block")).select(F.concat("head", _field("Content-Length", F.octet_length("block")), F.lit(CRLF), "block").alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, **columns: str) -> None:
    """Files of records, each one gzip stream. Records end as the format wants it because that is the end of a line here."""
    space = Workspace(pages.sparkSession)
    try:
        records(decided(pages, space, min_bytes, **columns)).write.option("lineSep", GAP).option("compression", "gzip").text(path)
    finally:
        space.drop()


def _store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(uri)


def _qualified(spark: SparkSession, path: str) -> str:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there).toString()


def fields_of(head: bytes) -> dict[str, str]:
    """Names, in lower case, and values of a head's lines. A line that begins with white space goes on with the one before."""
    lines = head.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split(CRLF)
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record of an archive: {lines[0][:60]!r}")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


def split_records(pieces: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Head and block of each record of a stream that comes in pieces, cut at the gaps that it holds."""
    gap = GAP.encode()
    held, size, need = [], 0, 1
    for piece in pieces:
        held += [piece, gap]
        size += len(piece) + len(gap)
        if size < need:
            continue
        data, at = b"".join(held), 0
        while True:
            while data[at : at + 1] in (b"\r", b"\n"):
                at += 1
            end, need = data.find(gap, at), 1
            if end < 0:
                break
            start = end + len(gap)
            stop = start + int(fields_of(data[at:end])["content-length"])
            if len(data) < stop + len(gap):
                need = stop + len(gap) - at
                break
            if data[stop : stop + len(gap)] != gap:
                raise ValueError("a record is not as long as it says")
            yield data[at:end], data[start:stop]
            at = stop + len(gap)
        held, size = [data[at:]], len(data) - at
    if b"".join(held).strip():
        raise ValueError("an archive ends inside a record")


def _number(value: str | None) -> int | None:
    return int(value) if value else None


def _members(target: str, most_bytes: int, level: int):
    """Rewrites streams, a file after the other, and tells where each record went."""
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_digest", pa.string())])

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            paths = batch.column(0)
            for i, piece in enumerate(batch.column(1)):
                yield paths[i].as_py(), piece.as_py()

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import itertools

        store, folder = _store(target)
        out, name, at, rows = None, "", 0, []
        try:
            for _, stream in itertools.groupby(streams(batches), key=lambda x: x[0]):
                for head, block in split_records(piece for _, piece in stream):
                    if out is None or at >= most_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = packer.compress(b"".join((head, GAP.encode(), block, GAP.encode()))) + packer.flush()
                    out.write(member)
                    f = fields_of(head)
                    rows.append((name, at, len(member), f.get("warc-record-id"), _number(f.get("page-id")), f.get("warc-type"), f.get("warc-target-uri"), (f.get("warc-payload-digest") or ":").partition(":")[2] or None))
                    at += len(member)
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
        finally:
            # an archive is whole before its last rows can be
            if out is not None:
                out.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return rewrite


def normalise(spark: SparkSession, source: str, target: str, most_bytes: int = 1 << 30, level: int = 6) -> DataFrame:
    """Archives of one member a record in a folder, from gzipped files of records, and the index of their members, stored in ``index`` beside them."""
    small_batches(spark)
    target = _qualified(spark, target)
    store = spark._jvm.org.apache.hadoop.fs.Path(target)
    store.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(store)
    pieces = spark.read.option("lineSep", GAP).text(source).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("piece"))
    pieces.mapInArrow(_members(target, most_bytes, level), INDEX).write.parquet(f"{target}/index")
    return spark.read.schema(INDEX).parquet(f"{target}/index")


def _reader(target: str, payloads: bool):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def read_one(record: bytes) -> tuple:
        head, block = next(split_records([record.removesuffix(GAP.encode())]))
        f = fields_of(head)
        http, _, payload = block.partition(GAP.encode())
        digest = (f.get("warc-payload-digest") or "").removeprefix("sha1:")
        revisit = f["warc-type"] == "revisit"
        if revisit:
            told = (line.partition(b":") for line in http.split(CRLF.encode()))
            size = next(int(value) for name, _, value in told if name.strip().lower() == b"content-length")
        else:
            size = len(payload)
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"{f.get('warc-record-id')}: the payload is not what its digest says")
        return _number(f.get("page-id")), size, digest, f["warc-type"], _number(f.get("refers-to-page-id")), f.get("warc-target-uri"), payload if payloads and not revisit else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(target)
        name, file = None, None
        for batch in batches:
            rows, size = [], 0
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != name:
                    if file is not None:
                        file.close()
                    name, file = archive, store.open_input_file(f"{folder}/{archive}")
                file.seek(offset)
                rows.append(read_one(zlib.decompress(file.read(length), 31)))
                size += rows[-1][1] if payloads else 0
                if size >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return read


def read_records(spark: SparkSession, target: str, index: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload of the records of an index, all of the folder's unless given.

    Rows of the index are dealt by stretches of their archives, so each task reads on in a file. The payload of a revisit is null: it is that of
    the page that it refers to.
    """
    small_batches(spark)
    target = _qualified(spark, target)
    index = index if index is not None else spark.read.schema(INDEX).parquet(f"{target}/index")
    total = index.agg(F.sum("length")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, total // STRETCH)
    dealt = index.repartition(parts, "archive", F.floor(F.col("offset") / max(1, total // parts))).sortWithinPartitions("archive", "offset")
    return dealt.select("archive", "offset", "length").mapInArrow(_reader(target, payloads), READ)


def archived_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of pages that were archived, normalised, and read back."""
    spark = pages.sparkSession
    space = Workspace(spark)
    try:
        write_archives(pages, f"{space.path}/streams", min_bytes)
        normalise(spark, f"{space.path}/streams", f"{space.path}/archives")
        found = read_records(spark, f"{space.path}/archives", payloads=False)
        return cut(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    finally:
        space.drop()
