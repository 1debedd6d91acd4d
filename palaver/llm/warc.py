"""WARC archives in Zstandard with a dictionary per archive.

Every archive file starts with a skippable frame that holds the dictionary, built from
records of that archive; each record is a frame of its own, compressed with it. Files
are written by Spark's text writer, one record a row, so they land in any store Spark
can write and a lost executor's half-written files are discarded. The writer ends each
row with a separator; here that is an empty skippable frame, so the file stays a valid
sequence of Zstandard frames.

Records with equal payloads of at least ``least`` bytes are written once: the one with
the largest page id is a response, the others are revisits that name it.

Defined cases: a null html is an empty payload; a null url leaves the target out; a null
page id counts as smaller than any other; rows that repeat the largest id of a payload
are all responses; an empty table gives no rows; other columns are not looked at.
"""
from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from palaver.session import materialize, shared_dir

#: Magic number of the dictionary's skippable frame; an empty skippable frame.
DICTIONARY_FRAME = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
ZSTD_MAGIC = 0xFD2FB528


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: str | None) -> str:
    return f"<urn:page:{page_id if page_id is not None else ''}>"


def record(page_id: str | None, url: str | None, payload: bytes, sha1: str, refers_to: str | None, date: str) -> bytes:
    """One WARC/1.1 record; ``refers_to`` makes it a revisit, which carries no payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[str | None, int, str, str, str | None]:
    """page id, payload bytes, digest, record type, id of the response referred to.

    A response's length and digest are taken from its payload, which must agree with the header.
    """
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sha1, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    length = int(http.rpartition(b"Content-Length: ")[2])
    if kind == "response" and (digest(payload) != sha1 or len(payload) != length):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its header")

    def page(name: str | None) -> str | None:
        return name[len("<urn:page:"):-1] or None if name else None

    return page(fields["WARC-Record-ID"]), length, sha1, kind, page(fields.get("WARC-Refers-To"))


def frames(data: bytes) -> Iterator[bytes]:
    """The records of one archive file."""
    view, at, decoder = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if magic == DICTIONARY_FRAME:
            decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8: at + 8 + size])))
        if magic == ZSTD_MAGIC:
            one = decoder.decompressobj()
            yield one.decompress(view[at:])
            at = len(view) - len(one.unused_data)
        else:
            at += 8 + size


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; with too little to train on, the records' own bytes serve as a raw one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def encode(batches: Iterator[pd.DataFrame], date: str, dict_bytes: int, sample_bytes: int, level: int) -> Iterator[pd.DataFrame]:
    """Rows of one partition to the frames of one archive, the dictionary's first."""
    compressor, held, held_bytes = None, [], 0

    def start() -> bytes:
        nonlocal compressor
        raw = _dictionary(held, dict_bytes)
        compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
        return struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw

    for batch in batches:
        out = []
        for page_id, url, html, sha1, refers in zip(batch["page_id"], batch["url"], batch["html"], batch["digest"], batch["refers"]):
            data = record(page_id, url, (html or "").encode(), sha1, refers, date)
            if compressor is None:
                held.append(data)
                held_bytes += len(data)
                if held_bytes < sample_bytes:
                    continue
                out += [start(), *map(compressor.compress, held)]
                held = []
            else:
                out.append(compressor.compress(data))
        yield pd.DataFrame({"frame": out})
    if compressor is None and held:
        yield pd.DataFrame({"frame": [start(), *map(compressor.compress, held)]})


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = "2024-01-01T00:00:00Z", dict_bytes: int = 32768,
                   sample_bytes: int = 2_000_000, level: int = 6) -> None:
    """Write a record per page under ``path``, an archive per partition.

    ``sample_bytes``: the dictionary of an archive is trained on that many bytes of its first records.
    """
    def sums(batches):
        for b in batches:
            data = [(x or "").encode() for x in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "digest": [digest(x) for x in data], "n_bytes": [len(x) for x in data]})

    narrow = pages.select(F.col("page_id").cast("string"), "html")
    known = materialize(narrow.mapInPandas(sums, "page_id string, digest string, n_bytes long"), "digests")
    number = F.col("page_id").cast(pages.schema["page_id"].dataType)
    shared = (known.where(F.col("n_bytes") >= least).groupBy("digest")
              .agg(F.count("*").alias("n"), F.max(number).cast("string").alias("first")).where("n > 1").select("digest", "first"))

    def with_digest(batches):
        for b in batches:
            yield b.assign(digest=[digest((x or "").encode()) for x in b["html"]])

    rows = pages.select(F.col("page_id").cast("string"), F.col("url").cast("string"), "html").mapInPandas(
        with_digest, "page_id string, url string, html string, digest string")
    rows = rows.join(shared, "digest", "left").withColumn(
        "refers", F.when(~F.col("first").eqNullSafe(F.col("page_id")) & F.col("first").isNotNull(),
                         F.concat(F.lit("<urn:page:"), "first", F.lit(">"))))
    frame = rows.select("page_id", "url", "html", "digest", "refers").mapInPandas(
        lambda it: encode(it, date, dict_bytes, sample_bytes, level), "frame binary")
    frame.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).text(path)


def read_archives(spark, path: str, kind: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record under ``path``."""
    def decode(batches):
        for batch in batches:
            for data in batch["content"]:
                found = [parse(x) for x in frames(data)]
                yield pd.DataFrame(found, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInPandas(decode, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return rows.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write all pages to new archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **options)
    return read_archives(spark, path, pages.schema["page_id"].dataType.simpleString())
