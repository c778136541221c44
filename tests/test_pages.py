"""Lines of words against all lines, sheets against a walk, headings cut at labels, dates out of the window, and conflicts."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from tidemark.operators import quality as Q
from tidemark.plans import layout as L

WORDS = "page int, word_no int, text string, left int, top int, width int, height int"


def plain_lines(words):
    """{(page, word_no): line} by comparing each word with the first words of all lines."""
    out = {}
    for page in {w[0] for w in words}:
        firsts = []
        for w in sorted((w for w in words if w[0] == page), key=lambda w: (w[4], w[3], w[1])):
            top, bottom = w[4], w[4] + w[6]
            fits = [k for k, (a, b) in enumerate(firsts) if min(bottom, b) - max(top, a) > 0.6 * min(w[6], b - a)]
            if not fits:
                firsts.append((top, bottom))
            out[page, w[1]] = fits[0] if fits else len(firsts) - 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_lines_against_all_lines(spark, seed):
    rng = random.Random(seed)
    words = [(rng.choice([1, 2, 3, None]), k, "w", rng.randrange(50), rng.randrange(120), 10, rng.choice([0, 5, 10, 12, 40, 110])) for k in range(400)]
    got = L.group_lines(spark.createDataFrame(words, WORDS).repartition(5)).collect()
    assert {(r.page, r.word_no): r.line for r in got} == plain_lines(words) and len(got) == 400


def test_overlap_of_just_the_share_is_another_line(spark):
    words = [(1, 1, "a", 0, 0, 5, 10), (1, 2, "b", 9, 4, 5, 10), (1, 3, "c", 9, 3, 5, 10)]
    assert {r.word_no: r.line for r in L.group_lines(spark.createDataFrame(words, WORDS)).collect()} == {1: 0, 3: 0, 2: 1}
    assert L.group_lines(spark.createDataFrame([], WORDS)).count() == 0


def plain_sheets(items, size):
    """{(patient, analyte): sheet}: a new sheet at a change of analyte once the sheet is full."""
    out = {}
    for p in {i[0] for i in items}:
        own = [i for i in items if i[0] == p]
        first = {a: min(s for _, s, b in own if b == a) for a in {i[2] for i in own}}
        sheet = held = 0
        for a in sorted(first, key=first.get):
            if held >= size:
                sheet, held = sheet + 1, 0
            out[p, a] = sheet
            held += sum(b == a for _, _, b in own)
    return out


def test_sheets_of_patients(spark):
    rng = random.Random(3)
    items = [(rng.choice([1, 2, 3, 4, None]), s, rng.choice(["a", "b", "c", "d", "e", "f", "g", None])) for s in range(300)]
    got = L.batches(spark.createDataFrame(items, "patient_id long, seq long, analyte string").repartition(4), 13, ("patient_id",)).collect()
    assert len(got) == 300 and {(r.patient_id, r.analyte): r.sheet for r in got} == plain_sheets(items, 13)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Sample No: AB1 Collection Date 1 Ack Date 2 Report Date 3", {"sample_no": ": AB1 ", "collected": " 1 ", "acknowledged": " 2 ", "reported": " 3"}),
        ("repot DATE x sample.no y", {"reported": " x ", "sample_no": " y"}),
        ("Ack Date a Ack Date b", {"acknowledged": " a Ack Date b"}),
        ("nothing", {}),
        ("", {}),
    ],
)
def test_headings(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(L.band_segments(F.col("t")).alias("m")).first().m
    assert got == want


def test_sample_numbers_and_null_headings(spark):
    rows = [("Sample .No.\\/SYN1000001A Collection",), ("Sample No AB12",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(L.sample_no(F.col("t")).alias("n"), L.band_segments(F.col("t")).alias("m")).collect()
    assert [r.n for r in got] == ["SYN1000001A", None, None] and not got[2].m


def test_dates_out_of_the_window(spark):
    d = lambda *x: dt.date(2024, *x)
    rows = [(1, 1, d(3, 4), False), (1, 2, d(3, 5), False), (1, 3, d(3, 7), None), (1, 4, d(6, 6), False), (1, 5, d(6, 7), True), (1, 6, None, False), (2, 7, None, False)]
    got = L.within_window(spark.createDataFrame(rows, "patient_id long, seq long, date date, human_verified boolean")).collect()
    assert {r.seq: (r.date, r.date_suspect) for r in got} == {1: (d(3, 4), False), 2: (d(3, 5), False), 3: (d(3, 7), False), 4: (None, True), 5: (d(6, 7), False), 6: (None, False), 7: (None, False)}


def plain_conflicts(rows):
    """(seq, value, needs_review, losers) of rows (seq, a, b, c, value, bad flag) that meet in order."""
    best = None
    for seq, a, b, c, value, bad in rows:
        read = [x for x in (a, b, c) if x is not None]
        new = {"seq": seq, "value": value, "support": (len(set(read)) == 1 and len(read) > 1, len(read)), "review": bad, "lost": []}
        if best is None:
            best = new
            continue
        differ = best["value"] is not None and value is not None and best["value"] != value
        order = (new["support"], not new["review"]) > (best["support"], not best["review"])
        winner, loser = (new, best) if order else (best, new)
        if differ:
            winner["review"] = True
            winner["lost"].append((loser["seq"], loser["value"]))
        best = winner
    return best["seq"], best["value"], best["review"], best["lost"]


def test_conflicts_against_plain(spark):
    rng = random.Random(9)
    rows = []
    for s in range(600):
        value = rng.choice([1.0, 2.0, 5.0, None])
        rows.append((rng.randrange(120), s, value, rng.choice([value, 9.0, None]), rng.choice([value, None]), value, 0.0, 3.0, rng.choice([None, "H", "L"])))
    kinds = "patient_id long, seq long, a double, b double, c double, value double, low double, high double, printed_flag string"
    df = spark.createDataFrame(rows, kinds)
    flags = {r.seq: r.f == "fail" for r in df.select("seq", Q.flag_gate().alias("f")).collect()}
    got = {r.patient_id: (r.seq, r.value, r.needs_review, [(c.seq, c.value) for c in r.conflicts]) for r in Q.dedupe_conflicts(df.repartition(6), ["patient_id"]).collect()}
    want = {p: plain_conflicts([(r[1], r[2], r[3], r[4], r[5], flags[r[1]]) for r in rows if r[0] == p]) for p in {r[0] for r in rows}}
    assert got == want


def test_words_of_recogniser_output(spark, tmp_path):
    head = "level page block par line_num word_no left top width height conf text".split()
    rows = [head, "5 1 1 1 1 1 10 20 30 12 96.5".split() + ['4" tube'], "5 1 1 1 1 2 50 20 30 12 -1".split() + ["box"], "5 1 1 1 1 3 90 20 30 12 88".split() + ["  "], "5 1 1".split(), "5 1 1 1 1 4 99 20 30 12 0".split() + ["mg/dL"]]
    (tmp_path / "page.tsv").write_text("".join("\t".join(r) + "\n" for r in rows))
    got = L.words_from_tsv(spark, str(tmp_path / "page.tsv")).orderBy("word_no").collect()
    assert [(r.page, r.word_no, r.left, r.conf, r.text) for r in got] == [(1, 1, 10, 96.5, '4" tube'), (1, 4, 99, 0.0, "mg/dL")]
