"""WARC archives compressed by an embedded Zstandard dictionary (operator 9).

Each archive is a ``.warc.zst`` file: a skippable frame (magic ``0x184D2A5D``) with the dictionary, then one frame per
WARC/1.1 record, as the WARC-Zstandard draft has it. The dictionary is trained on records spread evenly over the
archive's own. Payloads that occur again become ``revisit`` records of the one with the smallest id.

Archives are written to a shared folder under names that hold the task attempt; a manifest table names those of the
attempts that counted, so a lost executor's files are never read. Files go through ``pyarrow.fs``, reading through
Spark's ``binaryFile`` source.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grouping import partitions
from .scratch import shared_dir

MAGIC = 0x184D2A5D
#: Raw bytes of records to an archive, of samples to a dictionary, of the dictionary, and zstd's level.
ARCHIVE_BYTES, SAMPLE_BYTES, DICT_BYTES, LEVEL = 24 << 20, 2 << 20, 64 << 10, 6
DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, is_revisit: bool) -> bytes:
    """One WARC record. A revisit keeps the response's HTTP head, with the length of the payload it leaves out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {escape(url)}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Target-URI: {escape(refers_url)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def escape(url: str | None) -> str:
    """A header value has no line breaks."""
    return (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def unescape(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def train(records: list[bytes]) -> bytes:
    """A dictionary of evenly spread records; empty where they are too few or too alike to train one."""
    total = sum(map(len, records))
    step = max(1, min(-(-total // SAMPLE_BYTES), len(records) // 16))
    samples = [r[: 128 << 10] for r in records[::step]]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive(records: list[bytes]) -> tuple[bytes, list[tuple[int, int]]]:
    """The file and each record's (offset, length) in it."""
    raw = train(records)
    out = io.BytesIO()
    out.write(struct.pack("<II", MAGIC, len(raw)) + raw)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdCompressor(level=LEVEL)
    places = []
    for r in records:
        frame = packer.compress(r)
        places.append((out.tell(), len(frame)))
        out.write(frame)
    return out.getvalue(), places


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, from the file alone."""
    magic, n = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    raw = data[8 : 8 + n]
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    stream = io.BufferedReader(opener.stream_reader(io.BytesIO(data[8 + n :]), read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record ends early")
        yield headers, block


_MANIFEST = "archive string, page_id long, offset long, length long"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        where, base = pafs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        held: list[bytes] = []
        ids: list = []
        n = size = 0

        def close() -> pa.RecordBatch:
            data, places = archive(held)
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.warc.zst"
            with where.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(ids, pa.int64()), pa.array([a for a, _ in places], pa.int64()), pa.array([b for _, b in places], pa.int64())], names=["archive", "page_id", "offset", "length"])

        for batch in batches:
            for row in zip(*(c for c in batch.columns), strict=True):
                page_id, url, html, refers_to, refers_url, is_revisit = (x.as_py() for x in row)
                held.append(record(page_id, url, html, refers_to, refers_url, is_revisit))
                ids.append(page_id)
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, ids, size, n = [], [], 0, n + 1
        if held:
            yield close()

    return run


def plan_records(pages: DataFrame, groups_path: str, *, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """page_id, url, html (bytes), refers_to, refers_url and is_revisit of each row.

    Payloads that occur again are written to ``groups_path``, a row each, and joined from there: the pages move once at
    most, and as both sides are plain exchanges, Spark splits the partition of a payload with many copies."""
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), F.coalesce(F.encode(pages[html_col], "UTF-8"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("sum", F.unhex(F.sha1("html")))
    groups = rows.filter(F.length("html") >= least_bytes).groupBy("sum").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"), F.min_by(F.struct("url"), "page_id").alias("u"))
    groups.filter("n > 1 and refers_to is not null").select("sum", "refers_to", F.col("u.url").alias("refers_url")).write.parquet(groups_path)
    groups = pages.sparkSession.read.schema("sum binary, refers_to long, refers_url string").parquet(groups_path)
    found = rows.join(groups, "sum", "left").drop("sum")
    found = found.withColumn("is_revisit", F.coalesce(F.length("html") >= least_bytes, F.lit(False)) & F.col("refers_to").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("refers_to"), F.lit(False)))
    return found.withColumn("refers_to", F.when(F.col("is_revisit"), F.col("refers_to"))).withColumn("refers_url", F.when(F.col("is_revisit"), F.col("refers_url")))


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes the archives below ``folder``/archives; the manifest (archive, page_id, offset, length), from
    ``folder``/manifest.

    Of rows with equal payloads of at least ``least_bytes`` bytes, that with the smallest page_id is the response
    (each of them, should rows repeat it) and others revisit it. A null html is an empty payload, a null url an empty
    one; a row without an id is never referred to. An empty table writes no archive. Other columns are not read.
    """
    planned = plan_records(pages, f"{folder}/groups", id_col=id_col, url_col=url_col, html_col=html_col, least_bytes=least_bytes)
    planned.mapInArrow(_write(f"{folder}/archives"), _MANIFEST).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


_PAGES = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda x: int(x[len("<urn:page:") : -1]) if len(x) > len("<urn:page:>") else None
    for batch in batches:
        for data in batch.column(0):
            rows = []
            for head, block in read_archive(data.as_py()):
                http, _, payload = block.partition(b"\r\n\r\n")
                length = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                said = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response" and (len(payload) != length or digest(payload) != said):
                    raise ValueError(f"damaged payload of {head['WARC-Record-ID']}")
                rows.append((number(head["WARC-Record-ID"]), unescape(head["WARC-Target-URI"]), length, said, head["WARC-Type"], number(head.get("WARC-Refers-To", ""))))
            for at in range(0, len(rows), 10_000):
                columns = zip(*rows[at : at + 10_000], strict=True)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _PAGES.split(", ")])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to of the manifest's archives."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], _PAGES)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(f"{folder}/archives")
    files = files.withColumn("archive", F.element_at(F.split("path", "/"), -1))
    named = manifest.select("archive").distinct()
    return files.join(F.broadcast(named) if named.count() < 10_000 else named, "archive", "left_semi").select("content").mapInArrow(_parse, _PAGES)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages and reads them back from the archives."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages.repartition(partitions(spark)) if pages.rdd.getNumPartitions() > 4 * partitions(spark) else pages, folder)
    return read_archives(spark, folder).drop("url")
