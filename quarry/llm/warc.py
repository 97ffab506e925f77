"""WARC archives in Zstandard, one frame per record, with a shared dictionary.

Layout of an archive: a skippable frame (magic 0x184D2A5D) that holds the dictionary, then one
frame per record. Between records stands an empty skippable frame, which decoders pass over.
The archives are written and read through Spark's own file sources, so that they may lie in any
store that Spark reaches.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, pieces, released, scratch_path, unit_hash

#: Fixed values of the formats: magic numbers of the dictionary's frame, of other skippable frames and of Zstandard's frames and dictionaries.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGIC = 0x184D2A50
FRAME_MAGIC = 0xFD2FB528
TRAINED_MAGIC = 0xEC30A437
#: Profile of a revisit record whose payload equals an earlier one's.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads of at least so many bytes are stored once.
MIN_REVISIT = 1000
#: The dictionary has at most so many bytes, trained on about so many payloads of at most so many bytes.
DICTIONARY_BYTES = 64 << 10
SAMPLE_ROWS = 400
SAMPLE_ROW_BYTES = 64 << 10
#: An archive ends with the record that reaches so many bytes.
ARCHIVE_BYTES = 32 << 20
#: Digests of repeated payloads, of 60 bytes each, are broadcast up to so many.
MAX_BROADCAST = 200_000
#: What separates frames: an empty skippable frame.
SEPARATOR = struct.pack("<II", SKIPPABLE_MAGIC, 0)


class WarcError(ValueError):
    """An archive that breaks the format."""


def record_uuid(page_id: int | str | None, digest: str) -> str:
    """The id of the record that holds a page's payload: rows with one id and payload are one record told several times."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {digest}"))


def encode_record(kind: str, uri: str | None, record_id: str, payload: bytes, digest: str, refers_to: str | None, fields: dict[str, str]) -> bytes:
    """A record: WARC header, HTTP header and, unless it is a revisit, the payload. digest is a hex SHA-1."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    sha = lambda x: "sha1:" + base64.b32encode(x).decode()
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{record_id}>", "WARC-Date": "1970-01-01T00:00:00Z"}
    head |= {"WARC-Target-URI": (uri or "").replace("\r", "%0D").replace("\n", "%0A"), "Content-Type": "application/http;msgtype=response"}
    head |= {"WARC-Payload-Digest": sha(bytes.fromhex(digest)), "WARC-Block-Digest": sha(hashlib.sha1(block).digest())} | fields
    if kind == "revisit":
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:uuid:{record_uuid(refers_to, digest)}>", "WARC-Refers-To-Page-Id": str(refers_to)}
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def decode_record(record: bytes) -> dict:
    """A record's fields, after checks of its version, header lines, lengths, digests and what follows the block."""
    if not record.startswith(b"WARC/1."):
        raise WarcError(f"no WARC version line: {record[:20]!r}")
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon or not key or key != key.strip():
            raise WarcError(f"bad header line {line[:80]!r}")
        fields[key.decode().lower()] = value.strip().decode()
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in fields]
    if missing:
        raise WarcError(f"no {', '.join(missing)}")
    if not fields["content-length"].isdigit():
        raise WarcError(f"bad Content-Length {fields['content-length']!r}")
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {size}, but {len(rest) - 4} bytes follow")
    if "warc-block-digest" in fields and _hex(fields["warc-block-digest"]) != hashlib.sha1(block).hexdigest():
        raise WarcError("the block's digest differs")
    http, blank, payload = block.partition(b"\r\n\r\n")
    if not blank:
        raise WarcError("the HTTP header doesn't end")
    length = next((int(x.split(b":", 1)[1]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), None)
    if fields["warc-type"] == "response":
        if length != len(payload):
            raise WarcError(f"the HTTP header tells of {length} bytes, but {len(payload)} follow")
        if _hex(fields.get("warc-payload-digest", "")) != hashlib.sha1(payload).hexdigest():
            raise WarcError("the payload's digest differs")
    elif fields["warc-type"] == "revisit" and ("warc-refers-to" not in fields or payload):
        raise WarcError("a revisit record without reference, or with a payload")
    return {"fields": fields, "payload": payload, "payload_bytes": length, "payload_digest": _hex(fields.get("warc-payload-digest", ""))}


def _hex(digest: str) -> str:
    kind, colon, value = digest.partition(":")
    if kind.lower() != "sha1" or not colon:
        raise WarcError(f"unknown digest {digest!r}")
    try:
        return base64.b32decode(value, casefold=True).hex() if len(value) == 32 else bytes.fromhex(value).hex()
    except ValueError as e:
        raise WarcError(f"bad digest {digest!r}") from e


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame; the dictionary itself is compressed if that makes it smaller."""
    small = zstandard.ZstdCompressor(level=19).compress(dictionary) if dictionary else b""
    body = small if dictionary and len(small) < len(dictionary) else dictionary
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body


def read_archive(data: bytes) -> Iterator[dict]:
    """The records of an archive, one frame each."""
    view, at, size = memoryview(data), 0, len(data)
    decoder = None
    while at < size:
        if size - at < 8:
            raise WarcError(f"{size - at} bytes are left after the last frame")
        magic, length = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE_MAGIC:
            if at + 8 + length > size:
                raise WarcError("a skippable frame is cut short")
            if magic == DICTIONARY_MAGIC:
                if at:
                    raise WarcError("the dictionary's frame doesn't come first")
                body = bytes(view[8 : 8 + length])
                if body[:4] == struct.pack("<I", FRAME_MAGIC):
                    body = zstandard.ZstdDecompressor().decompress(body)
                if body and body[:4] != struct.pack("<I", TRAINED_MAGIC):
                    raise WarcError("the first frame holds no dictionary")
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body)) if body else None
            at += 8 + length
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        one = (decoder or zstandard.ZstdDecompressor()).decompressobj()
        parts, step = [], 1 << 16
        start = at
        try:
            while not one.eof and at < size:
                parts.append(one.decompress(view[at : at + step]))
                at += step
                step = 1 << 20
        except zstandard.ZstdError as e:
            raise WarcError(f"the frame at byte {start} is damaged: {e}") from e
        if not one.eof:
            raise WarcError(f"the frame at byte {start} is cut short")
        at = min(at, size) - len(one.unused_data)
        yield decode_record(b"".join(parts))


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of payloads, taken by a hash of the id; empty if there are too few."""
    rows = pages.where(F.col("html").isNotNull() & F.col("page_id").isNotNull() & (F.octet_length("html") <= SAMPLE_ROW_BYTES))
    n = rows.count()
    some = [r[0].encode() for r in rows.where(unit_hash("page_id") < min(1.0, SAMPLE_ROWS / max(1, n))).select("html").orderBy("page_id", "html").collect()]
    if len(some) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [t[:4096] for t in some], level=3).as_bytes()
    except zstandard.ZstdError:  # samples too small or too alike
        return b""


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to): of equal payloads of at least MIN_REVISIT bytes the largest page_id is the response.

    Rows with that page_id, repeated ones included, are responses; a null page_id is below all others.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # Only groups with more than one row are joined back. Few of them are broadcast, and no payload is shuffled; else AQE splits hot digests.
    groups = pages.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 and response is not null")
    groups = checkpointed(groups.select(F.col("digest").alias("d"), "response"))
    joined = pages.join(F.broadcast(groups) if groups.count() <= MAX_BROADCAST else groups, (F.col("digest") == F.col("d")) & (F.octet_length("html") >= MIN_REVISIT), "left")
    return joined.select("page_id", "url", "html", "digest", F.when(F.coalesce(F.col("page_id"), F.col("response") - 1) < F.col("response"), F.col("response")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """One record per row into archives under `path`, each of `archive_bytes` and one record at most. Nulls: an empty payload, an empty URI, an id that reads back as null."""
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(train_dictionary(pages))  # at most DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole archives."""
        trained = shared.value
        maker = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_checksum=True)
        frames, size = [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join([dictionary_frame(trained) if trained else b"", *frames])], pa.binary())], names=["archive"])

        for whole in batches:
            for batch in pieces(whole):
                for r in batch.to_pylist():
                    own = {"WARC-Page-Id": "" if r["page_id"] is None else str(r["page_id"])}
                    kind = "response" if r["refers_to"] is None else "revisit"
                    record_id = record_uuid(r["page_id"], r["digest"]) if kind == "response" else str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r['page_id']} {r['url']} {r['digest']}"))
                    frames.append(maker.compress(encode_record(kind, r["url"], record_id, r["html"].encode(), r["digest"], r["refers_to"], own)))
                    size += len(frames[-1])
                    if size >= archive_bytes:
                        yield archive()
                        frames, size = [], 0
        if frames:
            yield archive()

    archives = plan_records(pages).mapInArrow(released(run), "archive binary")
    # The text sink writes a string's bytes as they are, and the separator, an empty frame, after it; each row is a file of its own.
    archives.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", SEPARATOR.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record under `path`: page_id, url, payload (null for a revisit), payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for r in read_archive(data.as_buffer().to_pybytes()):
                    f = r["fields"]
                    revisit = f["warc-type"] == "revisit"
                    rows.append((int(f["warc-page-id"]) if f.get("warc-page-id") else None, f.get("warc-target-uri"), None if revisit else r["payload"], r["payload_bytes"], r["payload_digest"], f["warc-type"], int(f["warc-refers-to-page-id"]) if revisit else None))
                    held += len(r["payload"])
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages into archives in the shared folder and reads the digests back: one row per page.

    A null html is an empty payload, a null page_id stays null and is nobody's response, repeated
    rows stay; of equal payloads the largest page_id is the response, and all rows that have it. An
    empty table gives no rows.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
with p as (
  select page_id, encode(coalesce(html, '')) as payload from pages
), d as (
  select page_id, octet_length(payload)::bigint as payload_bytes, sha1(payload) as payload_digest from p
), g as (
  select *, case when payload_bytes >= {MIN_REVISIT} then max(page_id) over (partition by payload_digest) end as last from d
)
select page_id, payload_bytes, payload_digest, case when page_id < last then 'revisit' else 'response' end as record_type, case when page_id < last then last end as refers_to
from g
"""
