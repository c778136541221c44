"""Web archives in Zstandard: a writer that marks repeated payloads, and a checking reader.

An archive starts with a skippable frame that holds a compression dictionary; then each
record is a frame of its own.  Archives are rows of ``archive, content`` in a table that
Spark writes, so any store that Spark reaches will do; :func:`archives_from_files` reads
``*.warc.zst`` files of a store instead, and :func:`save_files` writes them to a mounted
one.  A record is rebuilt from its archive alone, so a lost executor costs only its tasks.

Of pages with equal payloads the one with the largest id is written as response, the
others as revisits that refer to it.  Revisits carry the response's HTTP head and so the
full payload's length, its digest, and no payload.

Record ids hold the page's id and its payload's digest, and those of revisits and of pages
without an id the place of the record, too.  The reader checks version, headers, types,
dates, lengths and digests, and every frame to its end; whatever is wrong is ``Damaged``.

Defined results: a null html is an empty payload; a null url becomes ``about:blank``;
pages without an id are revisits of a page with an id and the same payload, else
responses; rows repeated with the same id are records each, and those with equal payloads
that are responses share a record id; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, schema, small_batches

#: Skippable frame for a dictionary, as the public format for archives in Zstandard has it.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The dictionary is trained on so many different payloads, those with the smallest digests
#: among the ones of so many characters at most.
DICTIONARY_PAGES = 200
DICTIONARY_CHARS = 100_000
DICTIONARY_BYTES = 16_384
#: Digits of a digest that tell whether a payload is near the smallest ones.
DIGITS = 15
TYPES = set("warcinfo response resource request metadata revisit conversion continuation".split())
DATE = re.compile(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:T(\d\d):(\d\d)(?::(\d\d)(?:\.\d{1,9})?)?Z)?)?)?", re.A)
#: Bytes of blocks after which an archive is closed.
ARCHIVE_BYTES = 4_000_000
LEVEL = 3


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str, place: str = "0") -> bytes:
    """One record in full; ``place`` tells records apart that have no id of their own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    own = f":{place}" if revisit or page_id is None else ""
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'none' if page_id is None else page_id}:{digest}{own}>",
        "WARC-Date": date,
        "WARC-Target-URI": quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "about:blank",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}:{digest}>"}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def train(rows: DataFrame, payloads: int) -> bytes | None:
    """A dictionary from a bounded sample of whole pages, or None where they are too few or too short.

    ``rows`` have ``html`` and ``sha``, with ``payloads`` different ones.  Only rows below a bound on the digest, which holds
    about twice the sample whatever the number of rows, are brought together.
    """
    import zstandard

    fits = rows.filter(F.char_length("html").between(1, DICTIONARY_CHARS))
    share = 2 * DICTIONARY_PAGES / max(1, payloads)
    if share < 1:
        fits = fits.filter(F.col("sha") < f"{int(share * 16**DIGITS):0{DIGITS}x}")
    near = fits.groupBy("sha").agg(F.first("html").alias("html")).orderBy("sha").limit(DICTIONARY_PAGES)
    samples = [r["html"].encode("utf-8", "replace") for r in near.collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else None
    except zstandard.ZstdError:
        return None


def archive_start(dictionary: bytes | None) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""


def write_archives(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Rows of ``archive, content`` for ``page_id, url, html``; every page is a record."""
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    # As a table of its own, so that the pages of a hot payload can be split over tasks.
    groups = cut(rows.groupBy(F.col("sha").alias("same")).agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")), "archives-payloads")
    dictionary = train(rows, groups.count())
    joined = rows.join(groups.filter("n > 1"), F.col("sha") == F.col("same"), "left").select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("keeper")), F.col("keeper")).alias("refers_to"))

    def work(frames: Iterator) -> Iterator:
        import pandas as pd
        import zstandard

        start = archive_start(dictionary)
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True, write_content_size=True)
        # No partition's number: partitions that are put together later share one.
        run, k, held, size = uuid.uuid4().hex, 0, [], 0

        def full() -> pd.DataFrame:
            return pd.DataFrame({"archive": [f"pages-{run}-{k:05d}.warc.zst"], "content": [start + b"".join(held)]})

        for f in frames:
            for page_id, url, html, refers_to in zip(f["page_id"], f["url"], f["html"], f["refers_to"]):
                payload = html.encode("utf-8", "replace")
                raw = record(page_id, url, payload, base32_sha1(payload), refers_to, date, f"{run}-{k}-{len(held)}")
                held.append(packer.compress(raw))
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    yield full()
                    k, held, size = k + 1, [], 0
        if held:
            yield full()

    # Ids as strings: pandas would make floats of whole numbers with nulls among them.
    return joined.select(F.col("page_id").cast("string"), F.col("url").cast("string"), "html", F.col("refers_to").cast("string")).mapInPandas(work, schema(archive="string", content="binary"))


class Damaged(ValueError):
    """An archive or a record that breaks the format."""


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its block headers."""
    import zstandard

    try:
        pos = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
        checksum = zstandard.get_frame_parameters(bytes(data[at : at + 18])).has_checksum
    except zstandard.ZstdError as e:
        raise Damaged(f"no frame at byte {at}: {e}") from None
    last = False
    while not last:
        if pos + 3 > len(data):
            raise Damaged(f"the frame at byte {at} is cut off")
        head = int.from_bytes(data[pos : pos + 3], "little")
        last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
        if kind == 3:
            raise Damaged(f"the frame at byte {at} has a block of no known kind")
        pos += 3 + (1 if kind == 1 else size)
    pos += 4 * checksum
    if pos > len(data):
        raise Damaged(f"the frame at byte {at} is cut off")
    return pos


def number(text: str, what: str) -> int:
    """A length: ASCII digits only."""
    if not re.fullmatch(r"[0-9]{1,18}", text):
        raise Damaged(f"{what} is not a number")
    return int(text)


def headers(lines: list[bytes]) -> dict[str, str]:
    """Fields by lower-case name; folded lines belong to the one before."""
    fields: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:
            fields[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        last = name.strip().decode("utf-8", "replace").lower()
        if not colon or not last:
            raise Damaged("a header without a name")
        told = value.strip().decode("utf-8", "replace")
        if last in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-block-digest", "warc-payload-digest") and fields.get(last, told) != told:
            raise Damaged(f"more than one {last}")
        fields[last] = told
    return fields


def check_date(text: str, version: bytes) -> None:
    """A date to the second in version 1.0; any of the standard's precisions in 1.1."""
    found = DATE.fullmatch(text)
    parts = [int(p) for p in found.groups() if p] if found else []
    try:
        if version == b"WARC/1.0" and (len(parts) < 6 or "." in text):
            raise ValueError
        leap = len(parts) == 6 and parts[5] == 60
        datetime(*(parts[:5] if leap else parts), *[1] * max(0, 3 - len(parts)))
    except (ValueError, TypeError):
        raise Damaged("warc-date is not a date") from None


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one whole record, checked."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise Damaged("no version line or no end of the headers")
    fields = headers(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not fields.get(name):
            raise Damaged(f"no {name}")
    if fields["warc-type"] not in TYPES:
        raise Damaged("warc-type is no known one")
    if not re.fullmatch(r"<[^<>\s]+>", fields["warc-record-id"]):
        raise Damaged("warc-record-id is not in angle brackets")
    check_date(fields["warc-date"], lines[0])
    size = number(fields["content-length"], "content-length")
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise Damaged(f"content-length is {size}, the block has {len(rest) - 4} bytes")
    block = rest[:size]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise Damaged("the block doesn't match its digest")
    payload, length = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, found, payload = block.partition(b"\r\n\r\n")
        if not found:
            raise Damaged("no end of the HTTP headers")
        told = headers(http.split(b"\r\n")[1:]).get("content-length")
        length = len(payload) if told is None else number(told, "the HTTP length")
        if fields["warc-type"] == "response" and length != len(payload):
            raise Damaged("the HTTP length isn't the payload's")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "revisit":
        if not fields.get("warc-refers-to") or not digest:
            raise Damaged("a revisit without digest or reference")
        payload = b""
    elif digest and digest != base32_sha1(payload):
        raise Damaged("the payload doesn't match its digest")
    return {"fields": fields, "payload": payload, "payload_bytes": length, "payload_digest": digest or base32_sha1(payload)}


def unpacked(reader, frame: bytes, what: str) -> bytes:
    """The content of one whole frame."""
    import zstandard

    try:
        one = reader.decompressobj()
        out = one.decompress(frame)
    except (zstandard.ZstdError, MemoryError) as e:
        raise Damaged(f"{what}: {e}") from None
    if not one.eof or one.unused_data:
        raise Damaged(f"{what} doesn't end where it should")
    return out


def records_of(content: bytes) -> Iterator[tuple[int, dict]]:
    """Offset and parsed record of each frame of an archive."""
    import zstandard

    data, at, trained = memoryview(content), 0, None
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", data[4:8])[0]
        if 8 + size > len(data):
            raise Damaged("the dictionary is cut off")
        stored, at = bytes(data[8 : 8 + size]), 8 + size
        if stored[:4] == FRAME_MAGIC:  # dictionaries may be compressed themselves
            stored = unpacked(zstandard.ZstdDecompressor(), stored, "the dictionary")
        if len(stored) < 8:
            raise Damaged("the dictionary is too short")
        trained = zstandard.ZstdCompressionDict(stored)
    try:
        reader = zstandard.ZstdDecompressor(dict_data=trained)
    except zstandard.ZstdError as e:
        raise Damaged(f"the dictionary: {e}") from None
    while at < len(data):
        magic = struct.unpack("<I", data[at : at + 4])[0] if at + 8 <= len(data) else 0
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # other skippable frames
            size = struct.unpack("<I", data[at + 4 : at + 8])[0]
            if at + 8 + size > len(data):
                raise Damaged(f"the skippable frame at byte {at} is cut off")
            at += 8 + size
            continue
        end = frame_end(data, at)
        yield at, parse_record(unpacked(reader, bytes(data[at:end]), f"the frame at byte {at}"))
        at = end


def _ref(uri: str | None) -> int | None:
    tail = (uri or "").strip("<>").removeprefix("urn:page:").partition(":")[0]
    return int(tail) if tail.lstrip("-").isdigit() else None


def read_archives(archives: DataFrame, payloads: bool = True, strict: bool = True) -> DataFrame:
    """A row per record of ``archive, content`` rows, in the archives' order of records.

    What breaks the format raises; with ``strict`` off, it gives a row with ``error`` and
    the archive's later records are skipped.
    """
    small_batches(archives.sparkSession)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["archive", "offset", "record_type", "page_id", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload", "error"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for b in batches:
            for archive, content in zip(b.column("archive").to_pylist(), b.column("content")):
                rows: list = []
                try:
                    for at, r in records_of(content.as_py() or b""):
                        f = r["fields"]
                        rows.append((archive, at, f["warc-type"], _ref(f["warc-record-id"]), f.get("warc-target-uri"), _ref(f.get("warc-refers-to")), r["payload_bytes"], r["payload_digest"], r["payload"] if payloads else None, None))
                        if len(rows) >= 256:
                            yield batch(rows)
                            rows = []
                except Damaged as e:
                    if strict:
                        raise
                    rows.append((archive, None, None, None, None, None, None, None, None, str(e)))
                if rows:
                    yield batch(rows)

    out = schema(archive="string", offset="long", record_type="string", page_id="long", target_uri="string", refers_to="long", payload_bytes="long", payload_digest="string", payload="binary", error="string")
    return archives.select("archive", "content").mapInArrow(work, out)


def archives_from_files(spark: SparkSession, path: str) -> DataFrame:
    """``archive, content`` rows of ``*.warc.zst`` files below a path that Spark can read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.zst").load(path)
    return found.select(F.col("path").alias("archive"), "content")


def save_files(archives: DataFrame, folder: str) -> None:
    """Write archives as files into a folder that every executor has mounted."""

    def put(rows) -> None:
        import os

        for r in rows:
            part = os.path.join(folder, f".{r['archive']}.{os.getpid()}")
            with open(part, "wb") as f:
                f.write(r["content"])
            os.replace(part, os.path.join(folder, r["archive"]))

    archives.foreachPartition(put)


def archive_report(pages: DataFrame) -> DataFrame:
    """Write every page into archives in the shared folder, read them back, and report each record."""
    back = read_archives(cut(write_archives(pages), "archives"), payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
