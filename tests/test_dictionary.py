"""The dictionary table, lookups of any size, and similar labels against all pairs."""

import difflib
import random

import pytest

from tidemark.operators import labels as N
from tidemark.operators.lookups import lookup
from tidemark.sources import dictionary as D


def texts(rng, n, letters, least, most):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(least, most))) for _ in range(n)]


def damaged(rng, text):
    out = list(text)
    for _ in range(rng.randrange(0, 4)):
        k = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            out.insert(k, rng.choice("AB1"))
        elif out and kind == 1:
            out.pop(min(k, len(out) - 1))
        elif out:
            out[min(k, len(out) - 1)] = rng.choice("XYZ")
    return "".join(out)


@pytest.mark.parametrize("cutoff", [0.5, 0.7, 0.86, 0.95, 1.0])
def test_similar_pairs_are_all_pairs(spark, cutoff):
    rng = random.Random(round(100 * cutoff))
    one = texts(rng, 40, "ABCDEFGH", 1, 12) + texts(rng, 15, "AB", 3, 20) + texts(rng, 15, "ABCDEFGHIJKLMNOP", 20, 50) + ["", "É漢😀AB", "AAAAAAAA", "AAAA"]
    other = [damaged(rng, t) for t in one for _ in range(4)] + texts(rng, 20, "ABCDEFGH", 1, 12) + ["", "É漢AB", "AAAAAAA"]
    want = {(a, b): r for a in set(one) for b in set(other) if a and b and (r := difflib.SequenceMatcher(None, a, b).ratio()) >= cutoff}
    got = N.similar_pairs(spark.createDataFrame([(t,) for t in [*one, None, one[0]]], "a string"), spark.createDataFrame([(t,) for t in [*other, None]], "b string"), cutoff).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.ratio for r in got} == want


def plain_match(label, index):
    import re

    c = re.sub(r"(?i),\s*(serum|plasma|blood)\s*$", "", re.sub(r"[,;:]+$", "", label.strip(" "))).strip(" ")
    squash = lambda t: "".join(x for x in t.upper() if x.isalnum())
    words = c.split()
    if not words:
        return None, "none"
    for k in range(len(words), 0, -1):
        if squash(" ".join(words[:k])) in index:
            return index[squash(" ".join(words[:k]))], "exact" if k == len(words) else "prefix"
    if len(squash(c)) >= 5 and (near := difflib.get_close_matches(squash(c), list(index), n=1, cutoff=0.86)):
        return index[near[0]], "fuzzy"
    return None, "none"


def test_labels_against_plain(spark):
    rng = random.Random(8)
    words = texts(rng, 60, "ABCDEFGHIJ", 3, 9)
    index = {"".join(rng.sample(words, rng.randrange(1, 3))): f"key{k}" for k in range(80)}
    labels = [damaged(rng, a) for a in index for _ in range(3)] + [" ".join(rng.sample(words, 2)) + rng.choice(["", " ,", ", Serum", " extra"]) for _ in range(60)] + ["", "  ", "A", ":;", "AB CD EF"]
    got = N.match_labels(spark.createDataFrame([(x,) for x in [*labels, labels[0], None]], "label string"), spark.createDataFrame(list(index.items()), "alias_norm string, key string")).collect()
    assert {r.label: (r.key, r.match) for r in got if r.label is not None} == {x: plain_match(x, index) for x in labels}
    assert len(got) == len({r.label for r in got}) and {"exact", "prefix", "fuzzy", "none"} == {r.match for r in got}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_by_either_way(spark, how):
    rows = spark.range(500).selectExpr("if(id % 3 = 0, 7, id % 20) as k", "id as v", "map(id, 'x') as `a.m`")
    table = spark.range(5, 15).selectExpr("id as k", "concat('t', id) as name")
    small, large = lookup(rows, table, "k", how), lookup(rows, table, "k", how, most=3, salts=4)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect())) and small.columns == large.columns == ["k", "v", "a.m", "name"]
    assert lookup(rows.limit(0), table, "k", how).count() == 0 and lookup(rows, table.limit(0), "k", how).count() == (500 if how == "left" else 0)


def entry(analyte, version, display, aliases, retired=False, place=0):
    return (analyte, version, retired, place, display, aliases, "u", 1.0, None, 1, "s", None)


def test_versions_and_aliases(spark):
    log = spark.createDataFrame([entry("hct", 1, "Hct", ["PCV", "HCT"], place=2), entry("pcv", 1, "PCV", None, place=1), entry("hct", 2, "Hct gas", ["HCT"], place=2), entry("old", 1, "Old one", ["x"]), entry("old", 3, "Old one", [], retired=True), entry(None, 1, "none", [])], D.SCHEMA)
    at = lambda v: {r.analyte: r.display for r in D.as_of(log, v).collect()}
    assert at(1) == {"hct": "Hct", "pcv": "PCV", "old": "Old one"} and at(2)["hct"] == "Hct gas" and at(None) == {"hct": "Hct gas", "pcv": "PCV"} and at(0) == {}
    index = lambda v: {r.alias_norm: r.key for r in D.alias_index(D.as_of(log, v)).collect()}
    assert index(1) == {"HCT": "hct", "PCV": "pcv", "OLDONE": "old", "X": "old"}
    changes = D.alias_changes(D.alias_index(D.as_of(log, 1)), D.alias_index(D.as_of(log))).collect()
    assert {tuple(r) for r in changes} == {("OLDONE", "old", None), ("X", "old", None), ("HCTGAS", None, "hct")}


def test_rederive(spark):
    log = spark.createDataFrame([entry("pcv", 1, "PCV", ["HCT"], place=1), entry("abg_hct", 2, "Hct (gas)", ["HCT"], place=0), entry("inr", 1, "INR", [])], D.SCHEMA)
    rows = [("HCT", "pcv", "PCV", 1, "a"), ("HCT", "pcv", "PCV", 2, "stays"), ("PCV", "pcv", "as read", 1, "same"), ("nothing", "kept", "Kept", None, "none"), (None, "kept", "Kept", 1, "null"), ("INR ,", "pcv", "PCV", 1, "b")]
    got = D.rederive(spark.createDataFrame(rows, "raw_test string, analyte string, display string, dictionary_version int, tag string"), log, 2)
    assert got.columns == ["raw_test", "analyte", "display", "dictionary_version", "tag"]
    assert {r.tag: (r.analyte, r.display, r.dictionary_version) for r in got.collect()} == {"a": ("abg_hct", "Hct (gas)", 2), "stays": ("pcv", "PCV", 2), "same": ("pcv", "as read", 2), "none": ("kept", "Kept", 2), "null": ("kept", "Kept", 2), "b": ("inr", "INR", 2)}
    assert D.rederive(got, log, 2).exceptAll(got).count() == 0
