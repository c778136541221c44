"""What the archive reader refuses, record ids, and the sample that dictionaries are trained on."""

import struct
from collections import Counter

import pytest
import zstandard

from tidemark.llm import archives
from tidemark.llm.archives import Damaged, base32_sha1, parse_record, record, records_of

DAY = "2020-01-01T00:00:00Z"


def made(http_length=b"3", date=DAY, kind=None):
    raw = record(5, "u", b"abc", base32_sha1(b"abc"), None, date)
    head, _, block = raw.partition(b"\r\n\r\n")
    block = block[:-4].replace(b"Content-Length: 3", b"Content-Length: " + http_length)
    lines = [x for x in head.split(b"\r\n") if not x.startswith((b"Content-Length", b"WARC-Block-Digest"))]
    lines = [b"WARC-Type: " + kind if kind and x.startswith(b"WARC-Type") else x for x in lines]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block)]) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_sound_records():
    assert parse_record(made())["payload"] == b"abc"
    for date in ("2020", "2020-02", "2020-02-29", "2020-01-01T10:20Z", "2020-01-01T10:20:30.123456789Z", "2016-12-31T23:59:60Z"):
        assert parse_record(made(date=date))["payload_bytes"] == 3
    folded = made().replace(b"WARC-Target-URI: u", b"WARC-Target-URI: u\r\n  v")
    assert parse_record(folded)["fields"]["warc-target-uri"] == "u v"


@pytest.mark.parametrize("length", [b"abc", b"-5", b"+3", b"4", b"", "³".encode(), b"3\r\nContent-Length: 4"])
def test_http_lengths(length):
    with pytest.raises(Damaged):
        parse_record(made(http_length=length))


@pytest.mark.parametrize("date", ["x", "2020-13-01T00:00:00Z", "2021-02-29", "2020-01-01T25:00:00Z", "2020-01-01", "20200101"])
def test_types_and_dates(date):
    with pytest.raises(Damaged):
        parse_record(made(date=date).replace(b"WARC/1.1", b"WARC/1.0"))
    with pytest.raises(Damaged):
        parse_record(made(kind=b"banana"))


def test_frames_and_dictionaries():
    frame = zstandard.ZstdCompressor().compress(made())
    assert len(list(records_of(frame + frame))) == 2
    skip = struct.pack("<II", 0x184D2A50, 4) + b"1234"
    assert len(list(records_of(skip + frame + skip))) == 1
    words = zstandard.train_dictionary(2_000, [b"some words %d in a row " % i * 9 for i in range(200)]).as_bytes()
    packed = zstandard.ZstdCompressor().compress(words)
    inside = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words)).compress(made())
    assert len(list(records_of(struct.pack("<II", archives.DICTIONARY_MAGIC, len(packed)) + packed + inside))) == 1
    for broken in (
        frame + skip[:-1],
        frame + skip[:5],
        frame + b"\0",
        struct.pack("<II", archives.DICTIONARY_MAGIC, len(packed) - 3) + packed[:-3] + inside,
        struct.pack("<II", archives.DICTIONARY_MAGIC, len(packed) + 3) + packed + b"abc" + inside,
        struct.pack("<II", archives.DICTIONARY_MAGIC, 0) + inside,
        inside,
        zstandard.ZstdCompressor().compress(made()[:-1]),
    ):
        with pytest.raises(Damaged):
            list(records_of(broken))


def test_every_cut_and_flip_is_noticed():
    packer = zstandard.ZstdCompressor(write_checksum=True)
    content = packer.compress(made()) + packer.compress(made(kind=b"resource"))
    whole = len(packer.compress(made()))
    for n in range(1, len(content)):
        if n != whole:
            with pytest.raises(Damaged):
                list(records_of(content[:n]))
    for n in range(len(content)):
        flipped = bytearray(content)
        flipped[n] ^= 0xFF
        try:
            assert [r["payload"] for _, r in records_of(bytes(flipped))] == [b"abc", b"abc"] or n >= whole
        except Damaged:
            pass


def test_record_ids(spark):
    rows = [(i % 20 if i % 5 else None, "u", f"payload {i % 7}") for i in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    ids: dict = {}
    refers = set()
    for r in archives.write_archives(pages).collect():
        for _, one in records_of(bytes(r["content"])):
            f = one["fields"]
            ids.setdefault(f["warc-record-id"], []).append((f["warc-type"], one["payload"]))
            refers.add(f.get("warc-refers-to"))
    assert refers - {None} <= set(ids)
    for same in ids.values():  # only equal responses share an id
        assert len(same) == 1 or len(set(same)) == 1 and same[0][0] == "response"
    got = Counter((r.page_id, r.record_type) for r in archives.archive_report(pages).collect())
    assert sum(n for (page, _), n in got.items() if page is None) == 20 and sum(got.values()) == 100


def test_dictionary_sample_is_bounded(spark):
    pages = spark.range(0, 20_000, 1, 40).selectExpr("concat('page number ', id % 9000, repeat(' of many', 20)) as html").selectExpr("html", "sha1(cast(html as binary)) as sha")
    seen = []
    train = zstandard.train_dictionary
    try:
        zstandard.train_dictionary = lambda size, samples: seen.extend(samples) or train(size, samples)
        assert archives.train(pages, 9000)
    finally:
        zstandard.train_dictionary = train
    rows = sorted({(r.sha, r.html) for r in pages.collect()})[: archives.DICTIONARY_PAGES]
    assert seen == [h.encode() for _, h in rows]
