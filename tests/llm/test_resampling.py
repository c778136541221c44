"""Importance resampling against plain strings, sorting and zlib."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tests.oracle import differences
from tidemark.llm import queries, resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text, most):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]


def plain_resample(docs, target, buckets=10_000, most=1, least_words=20, percent=10, seed=2024):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows."""
    bucket = lambda s: zlib.crc32(s.encode()) % buckets
    counts = []
    for texts in ([t for _, t in docs], target):
        c = Counter()
        for t in texts:
            c.update(map(bucket, plain_features(t, most)[1]))
        counts.append(c)
    s, t = counts
    ss, tt = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * ss / ((s[b] + 1) * tt)))
    rows = []
    for i, text in docs:
        n, found = plain_features(text, most)
        weight = sum(gain(bucket(x)) for x in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in rows if r[5] >= least_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


def random_text(rng, n):
    return "".join(rng.choice(["one", "Two", "é", "ÄB", "x9", "日本", "3"]) + rng.choice([" ", "  ", "-", "\n", ".\x00"]) for _ in range(n))


@pytest.mark.parametrize("most", [1, 2, 4])
def test_crcs_of_runs(most):
    rng = random.Random(most)
    features = resampling.Features(most)
    for text in [None, "", " ", "one", "a b", "w" * 5000 + " v " + "é" * 300, *(random_text(rng, k) for k in range(60))]:
        n, found = plain_features(text, most)
        got_n, crcs = features.of(text)
        assert got_n == n and crcs.tolist() == [zlib.crc32(x.encode()) for x in found]


def test_shift_is_what_zero_bytes_do():
    import numpy as np

    tables = resampling.shift_tables(6)
    for j in range(6):
        data = b"some bytes"
        want = zlib.crc32(data + bytes(2**j)) ^ zlib.crc32(bytes(2**j))
        assert int(resampling.times(tables[j], np.array([zlib.crc32(data)], dtype=np.uint32))[0]) == want


@pytest.mark.parametrize("most", [1, 3])
def test_against_plain(spark, most):
    rng = random.Random(5)
    rows = [(i, random_text(rng, rng.randrange(60))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, ". -"), (None, random_text(rng, 30)), (403, "long " * 50_000)]
    rows += [rows[7]] * 40 + [(None, rows[0][1])] * 3
    target = [random_text(rng, 40) for _ in range(20)] + [None, "", "one one one"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as rank", "3 as row", "'t' as n_words").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs, goal, buckets=500, most=most, percent=35)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = plain_resample(rows, target, buckets=500, most=most, percent=35)
    found = Counter(map(tuple, got.collect()))
    assert found == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resampling.resample(docs.limit(0), docs).count() == 0
    assert [tuple(r)[:3] for r in resampling.resample(docs, docs.limit(0)).collect()] == [(1, 2, math.floor(1000 * math.log(10002 / 2 / 10000)))]


def test_equal_scores_go_by_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.range(50).selectExpr("id % 5 as doc_id", f"'{text}' as text")
    got = resampling.resample(docs, docs, percent=100).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 51))
    assert got == sorted(got, key=lambda r: (-r["score"], r["doc_id"], r["rank"]))


def test_whole_query(spark, sf_dir):
    assert differences(queries.op11_resampling(spark, sf_dir), resampling.ORACLE, sf_dir) == []
