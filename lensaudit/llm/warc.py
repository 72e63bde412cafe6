"""WARC archives compressed with Zstandard, one frame for each record.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary;
every further frame is one record. The reader loads the dictionary, decodes frame by
frame with bounded buffers, and validates version, headers, lengths and digests.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What a part's dictionary is trained on: so many bytes of its first payloads.
SAMPLE_BYTES, DICT_BYTES, DICT_MOST = 1_000_000, 16_384, 1 << 24
MIN_REVISIT = 100
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


class WarcError(ValueError):
    """An archive that breaks the format; the message has the offset of the frame."""


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def page_of(rid: str) -> int | None:
    got = rid[len("<urn:x-page:") :].split(":", 1)[0]
    return int(got) if got else None


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = "2000-01-01T00:00:00Z") -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary from samples; header text alone where they are too few to train on."""
    try:
        return zstd.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstd.ZstdError:
        return make_record(0, "http://example.com/", b"<!DOCTYPE html><html lang=", "0" * 64, 0, True)


def write_archive(records: Iterator[bytes], dictionary: bytes, level: int = 3) -> Iterator[bytes]:
    yield struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary
    packed = zstd.ZstdCompressor(level=level, dict_data=zstd.ZstdCompressionDict(dictionary), write_checksum=True, write_content_size=True)
    for r in records:
        yield packed.compress(r)


def read_archive(stream, chunk: int = 1 << 20, most: int = 1 << 31) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record. Raises WarcError on any fault:
    no dictionary frame, a cut or corrupt frame, bytes after a record in its frame,
    missing or repeated headers, a length or digest that does not hold."""
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICT_MAGIC:
        raise WarcError("at 0: no dictionary frame")
    size = struct.unpack("<I", head[4:])[0]
    if size > DICT_MOST:
        raise WarcError(f"at 0: a dictionary of {size} bytes")
    raw = stream.read(size)
    if len(raw) != size:
        raise WarcError("at 0: the dictionary is cut off")
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary itself may be compressed
        raw = zstd.ZstdDecompressor().decompress(raw, max_output_size=DICT_MOST)
    plain = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw))
    at, rest = 8 + size, b""
    while True:
        rest = rest or stream.read(chunk)
        if not rest:
            return
        frame, parts, total, used = plain.decompressobj(), [], 0, 0
        while not frame.eof:
            rest = rest or stream.read(chunk)
            if not rest:
                raise WarcError(f"at {at}: the frame is cut off")
            try:
                parts.append(frame.decompress(rest))
            except zstd.ZstdError as e:
                raise WarcError(f"at {at}: {e}") from e
            total += len(parts[-1])
            if total > most:
                raise WarcError(f"at {at}: a record of more than {most} bytes")
            used += len(rest)
            rest = frame.unused_data if frame.eof else b""
        yield parse_record(b"".join(parts), at)
        at += used - len(rest)


def parse_record(record: bytes, at: int = 0) -> tuple[dict[str, str], bytes]:
    head, sep, body = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"at {at}: no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            raise WarcError(f"at {at}: header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(fields):
        raise WarcError(f"at {at}: no {', '.join(sorted(missing))}")
    if not fields["content-length"].isdigit() or int(fields["content-length"]) != len(body) - 4 or body[-4:] != b"\r\n\r\n":
        raise WarcError(f"at {at}: Content-Length {fields['content-length']} of {len(body) - 4} bytes")
    block = body[:-4]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise WarcError(f"at {at}: the block's digest does not hold")
    return fields, block


def page_record(fields: dict[str, str], block: bytes) -> dict:
    """What a page's record says: id, payload length and digest, type, and what it refers to."""
    http, sep, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if not sep or not length:
        raise WarcError(f"{fields['warc-record-id']}: no HTTP header")
    if kind == "response" and (int(length[1]) != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
        raise WarcError(f"{fields['warc-record-id']}: the payload's length or digest does not hold")
    return {"page_id": page_of(fields["warc-record-id"]), "payload_bytes": int(length[1]), "payload_digest": digest, "record_type": kind, "refers_to": page_of(fields["warc-refers-to"]) if kind == "revisit" else None}


def write_pages(pages: DataFrame, uri: str) -> list[str]:
    """Write ``pages`` (page_id, url, html) as archives under ``uri``; returns their URIs.

    Of pages with equal payloads of at least MIN_REVISIT bytes, those with the smallest
    page_id are responses and the rest are revisits of it, without payload. Null html is
    an empty payload; a null page_id is never the smallest and pages with only null ids
    are all responses; rows that repeat the smallest page_id are responses too. A null
    url leaves out the target header. An empty table gives archives without records, or none;
    payloads of any length up to 2 GiB, the most a record's block may have, are written whole.
    Other columns are ignored.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    small = rows.where(F.octet_length("payload") >= MIN_REVISIT).select("page_id", "digest")
    first = small.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    again = small.join(first, "digest").where("page_id is null or page_id <> first").groupBy(F.col("page_id").alias("again"), F.col("digest").alias("of")).agg(F.min("first").alias("first"))
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("again")) & (F.col("digest") == F.col("of")), "left")
    rows = rows.select("page_id", "url", "payload", "digest", "first")

    def write(batches):
        def each():
            for b in batches:
                yield from zip(*(b.column(c) for c in ("page_id", "url", "payload", "digest", "first")))

        left, held, size = each(), [], 0
        for row in left:
            held.append(row)
            size += len(row[2].as_py())
            if size >= SAMPLE_BYTES:
                break
        if not held:
            return
        count = 0

        def records():
            nonlocal count
            while held or (row := next(left, None)) is not None:
                page, url, body, digest, first = (x.as_py() for x in (held.pop(0) if held else row))
                count += 1
                yield make_record(page, url, body, digest, first, first is not None)

        dictionary = train([r[2].as_py() for r in held if len(r[2].as_py())])
        name = f"{uri}/part-{TaskContext.get().partitionId():06d}.warc.zst"
        common.put_file(name, write_archive(records(), dictionary))
        yield pa.RecordBatch.from_pydict({"uri": [name], "records": [count]})

    return sorted(r["uri"] for r in rows.mapInArrow(write, "uri string, records long").collect())  # a row for each archive


def read_pages(spark, archives: list[str]) -> DataFrame:
    """A row for each record of ``archives``; one task reads one archive, record by record.

    Repeated pages are records each; no archives give no rows. A record over 2 GiB, a length or header
    that does not fit, or a digest that is not that of its payload is an error."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches):
        for b in batches:
            for i in b.column("id").to_pylist():
                if i >= len(archives):
                    continue
                fs, path = common.open_uri(archives[i])
                out = []
                with fs.open_input_stream(path, compression=None) as f:
                    for fields, block in read_archive(f):
                        out.append(page_record(fields, block))
                        if len(out) == 5_000:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    n = max(1, len(archives))
    return spark.range(0, n, 1, n).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
