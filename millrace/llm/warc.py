"""WARC archives: a writer that deduplicates payloads by revisit records and a splittable reader.

Writer: a record a page, each a gzip member of its own. Of pages with equal payloads of at least ``min_bytes`` bytes, that
with the smallest id becomes a response and the others revisits that refer to it; smaller payloads are all responses.
Records carry the length and digest of the full payload. Each task writes one archive under an attempt's name and renames
it when it is whole, so a repeated task leaves one archive; the archives of a finished job are named by its tasks.

Reader: Spark lists the archives as a table of names and sizes, and its tasks cut them into byte ranges, a row each, so
ranges are read anywhere and none passes through the driver. A range looks for the
gzip magic, takes a candidate for a record only if its member decodes to a WARC version line and complete headers, and
owns exactly the records that start inside it, reading past its end to finish the last. After a record the next is
expected where it ends; where none is, the search goes on byte by byte. Members are decoded piecewise: memory is bounded
by one record's payload.

Defined cases: null html is an empty payload; rows that repeat the smallest id of a payload are all responses; a null id
is never referred to unless a payload has no other, and then its rows are responses; empty tables give no rows;
damaged members are skipped by the reader.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import new_path

MAGIC = b"\x1f\x8b\x08"
_PIECE = 1 << 16
_END = b"\r\n\r\n"


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def plan_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: what each record holds; ``refers_to`` is null for responses."""
    own = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    large = F.length("payload") >= min_bytes
    firsts = own.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    firsts = firsts.select(F.col("digest").alias("__d"), "first")
    return (
        own.join(firsts, F.col("digest") == F.col("__d"), "left")
        .withColumn("refers_to", F.when(large & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
        .select("page_id", "url", "payload", "digest", "refers_to")
    )


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + _END[2:]
    block = http if revisit else http + payload
    heads = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        heads.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if revisit:
        heads += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    heads.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(heads).encode() + _END + block + _END) + pack.flush()


def write(records: DataFrame, path: str) -> None:
    """Write the rows of ``plan_records`` as archives under ``path``, one a task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = open_fs(path)
        part, held = TaskContext.get().partitionId(), None
        attempt = f"{at}/_{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if held is None:
                    store.create_dir(at, recursive=True)
                    held = store.open_output_stream(attempt)
                held.write(_record(*(x.as_py() for x in row)))
        if held is not None:
            held.close()
            store.move(attempt, f"{at}/part-{part:06d}.warc.gz")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64())})

    store, at = open_fs(path)
    store.create_dir(at, recursive=True)  # there are archives of no records, too
    records.mapInArrow(task, "part long").agg(F.count(F.lit(1))).first()


class _Source:
    """A file's bytes from an offset on. What was read stays until it is dropped; dropping moves a mark and copies only now and then."""

    def __init__(self, file, at: int):
        self.file, self.at, self.held, self.mark = file, at, bytearray(), 0
        file.seek(at)

    def __len__(self) -> int:
        return len(self.held) - self.mark

    def more(self) -> bool:
        got = self.file.read(_PIECE)
        self.held += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.mark, self.at = self.mark + n, self.at + n
        if self.mark >= max(4 * _PIECE, len(self.held) // 2):
            del self.held[: self.mark]
            self.mark = 0

    def find(self, what: bytes) -> int:
        """The first place of ``what``, counted from the mark; -1 if there is none."""
        spot = self.held.find(what, self.mark)
        return spot if spot < 0 else spot - self.mark

    def piece(self, start: int) -> bytes:
        return bytes(self.held[self.mark + start : self.mark + start + _PIECE])


def _member(src: _Source) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and compressed length of the record that starts at the source's position; None if none does."""
    unpack, plain, used, headers, looked, start = zlib.decompressobj(31), bytearray(), 0, None, 0, 0
    try:
        while not unpack.eof:
            if used == len(src) and not src.more():
                return None
            piece = src.piece(used)
            used += len(piece)
            plain += unpack.decompress(piece)
            if len(plain) >= 7 and not plain.startswith(b"WARC/1."):
                return None
            if headers is None:
                cut = plain.find(_END, max(0, looked - len(_END)))
                looked = len(plain)
                if cut >= 0:
                    lines = plain[:cut].decode("utf-8", "replace").split("\r\n")[1:]
                    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                    start = cut + len(_END)
                    if "warc-type" not in headers or not headers.get("content-length", "").isdigit():
                        return None
    except zlib.error:
        return None
    if headers is None:
        return None
    return headers, bytes(plain[start : start + int(headers["content-length"])]), used - len(unpack.unused_data)


def records_in(file, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records that start in [start, end)."""
    src = _Source(file, start)
    while src.at < end:
        spot = src.find(MAGIC)
        if spot < 0:
            src.drop(max(0, len(src) - len(MAGIC) + 1))
            if not src.more():
                return
            continue
        src.drop(spot)
        if src.at >= end:
            return
        found = _member(src)
        if found is None:
            src.drop(1)
            continue
        yield src.at, found[0], found[1]
        src.drop(found[2])


def ranges(spark: SparkSession, path: str, split_bytes: int = 8 << 20) -> DataFrame:
    """``file, start, end``: the byte ranges of the archives under ``path``, from a listing that reads no contents."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc*").load(path)
    files = listed.select(F.col("path").alias("file"), F.col("length").alias("size")).where(F.col("file").rlike(r"\.warc(\.gz)?$") & (F.col("size") > 0))
    cuts = files.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    return cuts.select("file", "start", F.least(F.col("start") + split_bytes, "size").alias("end"))


def _spread(cuts: DataFrame) -> DataFrame:
    """A task reads few ranges: as many partitions as ranges, up to a bound."""
    return cuts.repartition(max(1, min(cuts.count(), 100_000)), "file", "start")


def read(spark: SparkSession, path: str, split_bytes: int = 8 << 20) -> DataFrame:
    """``file, offset, record_type, record_id, refers_to, url, payload_digest, payload_bytes, payload``: a row a record.

    For responses the length and digest are those of the payload as read; for revisits, those their headers name.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, end in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                store, at = open_fs(name)
                with store.open_input_file(at) as file:
                    rows, held = [], 0
                    for offset, heads, block in records_in(file, start, end):
                        revisit = heads["warc-type"] == "revisit"
                        payload = block[block.find(_END) + 4 :] if heads.get("content-type", "").startswith("application/http") else block
                        rows.append((
                            name, offset, heads["warc-type"], heads.get("warc-record-id"), heads.get("warc-refers-to"), heads.get("warc-target-uri"),
                            heads.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
                            int(heads.get("x-payload-length", 0)) if revisit else len(payload), None if revisit else payload,
                        ))
                        held += len(payload)
                        if held > 4 << 20 or len(rows) >= 2000:
                            yield _rows(rows)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows)

    return _spread(ranges(spark, path, split_bytes)).mapInArrow(
        task,
        "file string, offset long, record_type string, record_id string, refers_to string, url string, payload_digest string, payload_bytes long, payload binary",
    )


_SCHEMA = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()),
    ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def page_of(name) -> object:
    """The page id in a record name of the writer's."""
    return F.regexp_extract(name, r"<urn:page:(-?\d+)>", 1).try_cast("long")


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the pages to archives and read these: the rows of ``read`` with ``page_id`` and ``refers_to_page``."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(plan_records(pages, **options), path)
    return read(spark, path).withColumns({"page_id": page_of(F.col("record_id")), "refers_to_page": page_of(F.col("refers_to"))})
