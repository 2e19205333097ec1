"""Content-addressed archive of WARC records.

Pages are written as WARC files, one record each, and parsed back from their bytes into two tables: ``payloads``
holds the bytes of each different payload once, under its SHA-256; ``headers`` holds the exact
header block of every record and the digest it refers to. Records are rebuilt by a join on the digest,
and what is read is checked against both digests.

A WARC file is written by Spark's text writer, whose line separator is the end of a record, and is compressed as a
whole; its size follows the partitions. Files are parsed as streams, by Content-Length.

Defined results: a null html is an empty payload; a null url is an empty target; of
records with equal payloads the one with the largest page_id is the response (a null
page_id counts as the smallest), so repeated rows of that page_id are all responses;
no pages give an empty archive; a payload that does not have the digest its header states is read as not
verified, and so is a record whose payload is not there; a file that is cut off raises ValueError. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.tables import small_enough
from bazaarlens.session import shared_folder

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# Digits of Spark's conv in base 32.
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
# Bytes of records that a task hands on at once, or one record.
BATCH_BYTES = 8_000_000
# Up to so many repeated responses are named to every task; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, in four steps of 40 bits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def records(pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """page_id, header (the exact header block) and body of every record.

    ``date`` is every record's WARC-Date: pages carry no time, and equal pages give equal archives.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    payload = F.encode(html, "UTF-8")
    rows = pages.select(
        "page_id",
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        html.alias("html"),
        F.octet_length(payload).alias("bytes"),
        F.sha2(payload, 256).alias("digest"),
        base32_sha1(payload).alias("sha1"),
    )
    winners = rows.groupBy("digest").agg(F.max("page_id").alias("response"))
    rows = rows.join(winners, "digest")
    revisit = (F.col("bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("response"))

    def urn(page_id: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))

    def line(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(CRLF))

    # A target may not break the header block: line ends and the escape sign itself are percent-coded.
    target = F.replace(F.col("url"), F.lit("%"), F.lit("%25"))
    target = F.replace(F.replace(target, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", date),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("X-Payload-SHA256", F.col("digest")),
        F.when(
            revisit,
            F.concat(line("WARC-Refers-To", urn(F.col("response"))), line("WARC-Profile", REVISIT_PROFILE)),
        ).otherwise(F.lit("")),
        line("Content-Type", "text/html; charset=utf-8"),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit(CRLF),
    )
    return rows.select("page_id", head.alias("header"), F.when(revisit, F.lit("")).otherwise(F.col("html")).alias("body"))


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    """WARC files of all pages in ``folder``."""
    whole = records(pages, min_bytes).select(F.concat("header", "body"))
    whole.write.option("lineSep", CRLF * 2).option("compression", "gzip").text(folder)


def parse_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header block, body) of every record of a WARC file, plain or compressed."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head, length = [line], 0
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError("a header block is cut off")
            head.append(line)
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length":
                length = int(value)
        body = stream.read(length)
        if len(body) < length:
            raise ValueError("a record is cut off")
        yield b"".join(head) + b"\r\n", body


def read_warc(spark: SparkSession, folder: str, bodies: bool = True) -> DataFrame:
    """header, body (null without ``bodies``), its SHA-256, file and place in the file of every record of the WARC files in ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, held = [], 0
                for at, (header, body) in enumerate(parse_warc(content.as_buffer().to_pybytes())):
                    rows.append((header, body if bodies else None, hashlib.sha256(body).hexdigest(), file, at))
                    held += len(header) + (len(body) if bodies else 0)
                    if held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    # A task reads one file's bytes at a time.
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(run, "header binary, body binary, sha256 string, file string, at long")


def _batch(rows: list[tuple[bytes, bytes | None, str, str, int]]) -> pa.RecordBatch:
    kinds = {"header": pa.binary(), "body": pa.binary(), "sha256": pa.string(), "file": pa.string(), "at": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], list(kinds))


def header_field(header: Column, name: str) -> Column:
    return F.regexp_extract(F.decode(header, "UTF-8"), rf"\n{name}: ([^\r\n]*)\r\n", 1)


def archive_warc(spark: SparkSession, warc: str, folder: str) -> None:
    """Writes ``headers`` and ``payloads`` of the WARC files in ``warc`` into ``folder``; each payload once."""
    read = read_warc(spark, warc, bodies=False)
    response = header_field(F.col("header"), "WARC-Type") == "response"
    headers = read.select(
        header_field(F.col("header"), "X-Payload-SHA256").alias("digest"),
        "header",
        F.when(response, F.col("sha256")).alias("sha256"),
        "file",
        "at",
    )
    headers.write.option("compression", "zstd").parquet(f"{folder}/headers")
    places = spark.read.schema("sha256 string, file string, at long").parquet(f"{folder}/headers").where("sha256 is not null")
    payloads_once(read_warc(spark, warc), places).write.option("compression", "zstd").parquet(f"{folder}/payloads")


def payloads_once(records: DataFrame, places: DataFrame) -> DataFrame:
    """digest and payload of the first response of each payload; ``places`` has sha256, file and at of all responses.

    Which responses repeat an earlier one is found by digests alone. Mostly few do: then no payload is shuffled.
    """
    place = F.struct("file", "at")
    repeated = places.groupBy("sha256").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    spare = places.join(repeated, "sha256").where(place != F.col("first")).select("file", "at")
    if small_enough(spare, BROADCAST_ROWS):
        spare = F.broadcast(spare)
    responses = records.where(header_field(F.col("header"), "WARC-Type") == "response")
    return responses.join(spare, ["file", "at"], "left_anti").select(F.col("sha256").alias("digest"), F.col("body").alias("payload"))


def write_archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> str:
    """Writes ``warc``, ``headers`` and ``payloads`` into ``folder`` (by default a new one in the shared folder)."""
    folder = folder or f"{shared_folder(pages.sparkSession).rstrip('/')}/bazaarlens/warc-{uuid.uuid4().hex}"
    write_warc(pages, f"{folder}/warc", min_bytes)
    archive_warc(pages.sparkSession, f"{folder}/warc", folder)
    return folder


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every record: header fields, the payload that it stands for and its size, and ``verified`` (both digests hold)."""
    headers = spark.read.schema("digest string, header binary").parquet(f"{folder}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    # Digests and sizes are taken once per stored payload, not per record: who needs no payload moves none.
    payloads = payloads.withColumns(
        {
            "sha1": base32_sha1(F.col("payload")),
            "sound": F.sha2("payload", 256) == F.col("digest"),
            "payload_bytes": F.octet_length("payload").cast("long"),
        }
    )

    def field(name: str) -> Column:
        return header_field(F.col("header"), name)

    read = headers.join(payloads, "digest", "left")
    refers = F.regexp_extract(field("WARC-Refers-To"), r"^<urn:page:(-?\d+)>$", 1)
    target = F.replace(F.replace(field("WARC-Target-URI"), F.lit("%0D"), F.lit("\r")), F.lit("%0A"), F.lit("\n"))
    return read.select(
        F.regexp_extract(field("WARC-Record-ID"), r"^<urn:page:(-?\d*)>$", 1).try_cast("long").alias("page_id"),
        F.replace(target, F.lit("%25"), F.lit("%")).alias("url"),
        field("WARC-Type").alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
        F.col("sha1").alias("payload_digest"),
        F.coalesce(
            F.col("sound") & (F.concat(F.lit("sha1:"), F.col("sha1")) == field("WARC-Payload-Digest")), F.lit(False)
        ).alias("verified"),
        "header",
        "payload",
        "payload_bytes",
    )


def record_bytes(record_type: Column, header: Column, payload: Column) -> Column:
    """The record as it stands in a WARC file; a revisit carries no payload of its own."""
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    body = F.when(record_type == "response", payload).otherwise(F.encode(F.lit(""), "UTF-8"))
    return F.concat(header, body, end)
