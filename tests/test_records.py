"""Scans with declared schemas, tables written back, the strict gate, sentences and axes."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import words as W
from tidemark.operators import series as S
from tidemark.plans import retrieval
from tidemark.sources import records as R


def put(folder, name, value):
    path = folder / name
    path.write_text(json.dumps(value, indent=1))
    return f"file://{path}"


def test_scans(spark, tmp_path):
    raw = put(tmp_path, "raw.json", {"observations": [{"analyte": "inr", "page": 3, "ocr": {"A": 1.5, "C": None}, "value": 1.5, "bbox": [1, 2, 3, 4]}, {"analyte": "ast"}], "samples": [{"sample_id": "S1", "pages": [3, 4]}]})
    got = R.raw_readings(spark, raw).orderBy("analyte").collect()
    assert [(r.analyte, r.page, r.value, r.bbox) for r in got] == [("ast", None, None, None), ("inr", 3, 1.5, [1, 2, 3, 4])]
    assert got[1].ocr == {"A": 1.5, "C": None} and R.raw_samples(spark, raw).first().pages == [3, 4]
    over = put(tmp_path, "over.json", {"band_timestamps": {"7": {"sample_id": "S7", "collected": "2024-01-02T08:00"}}})
    assert [tuple(r) for r in R.band_overrides(spark, over).select("page", "sample_id").collect()] == [(7, "S7")]
    assert [r.page for r in R.bands(spark, put(tmp_path, "bands.json", [{"page": 1}, {"page": 2}])).orderBy("page").collect()] == [1, 2]
    led = put(tmp_path, "ledger.json", {"verified": {"3:inr": {"value": 1.5, "on": "2024-01-05", "how": "by hand"}}, "notes": ["by hand"]})
    assert tuple(R.ledger(spark, led).first()) == ("3:inr", 1.5, date(2024, 1, 5), "by hand")
    sheets = put(tmp_path, "sheets.json", [{"sheet": 1, "analytes": ["inr", "ast"]}, {"sheet": 2, "analytes": []}])
    assert {tuple(r) for r in R.sheet_analytes(spark, sheets).collect()} == {(1, "inr"), (1, "ast")}
    whole = put(tmp_path, "dataset.json", {"observations": [{"patient_id": 1, "analyte": "inr", "value": 2.0, "reference": {"low": 0.8, "high": 1.2}, "provenance": {"page": 3, "human_verified": True}}]})
    r = R.dataset(spark, whole).first()
    assert r.reference.high == 1.2 and r.provenance.human_verified


def test_absent_is_empty_and_damage_raises(spark, tmp_path):
    gone = f"file://{tmp_path}/gone.json"
    for scan in (R.raw_readings, R.raw_samples, R.dataset, R.bands, R.band_overrides, R.ledger, R.sheet_analytes):
        assert scan(spark, gone).count() == 0
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        R.bands(spark, put(tmp_path, "bad.json", [{"page": "no number"}])).collect()


def test_files_and_saving(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.txt", "b.txt", "c.jpg", "d.jpg"):
        (tmp_path / "in" / name).write_text(f"{name}\nsecond line")
    at = f"file://{tmp_path}/in"
    assert sorted(r.content for r in R.texts(spark, at, "*.txt").collect()) == ["a.txt\nsecond line", "b.txt\nsecond line"]
    assert [r.path[-5:] for r in R.images(spark, at, limit=1).collect()] == ["c.jpg"] and R.images(spark, at).count() == 2
    t = spark.range(3)
    R.save(f"file://{tmp_path}/out", numbers=t, none=t.limit(0))
    assert spark.read.parquet(f"file://{tmp_path}/out/numbers").count() == 3
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        R.save(f"file://{tmp_path}/out", numbers=t)


def test_ledger_of_ties_and_nulls(spark):
    old = spark.createDataFrame([("1:a", 1.0, date(2024, 1, 1), "x"), ("9:z", 9.0, date(2024, 1, 1), "x")], R.MARK.replace("value", "key string, value", 1))
    rows = [(1, "a", 2.0, 5), (1, "a", 3.0, 5), (1, "a", 7.0, 4), (2, "b", None, 1), (None, "c", 1.0, 1), (3, None, 1.0, 1), (4, "d", 4.0, None)]
    targets = spark.createDataFrame(rows, "page int, analyte string, value double, seq int")
    got = {r.key: (r.value, r.how) for r in R.upsert_ledger(old, targets, "y", "2024-02-02").collect()}
    assert got == {"1:a": (3.0, "y"), "9:z": (9.0, "x"), "4:d": (4.0, "y")}
    assert R.upsert_ledger(old, targets.limit(0), "y", "2024-02-02").count() == 2


def test_pass_of_rows_without_readings(spark):
    obs = spark.createDataFrame([(1, 2.0, {"A": 2.0, "C": 9.0}), (2, 2.0, None), (3, None, {"A": 1.0}), (None, 1.0, {"A": 1.0})], "seq int, value double, ocr map<string,double>")
    readings = spark.createDataFrame([(1, 2.0), (1, None), (2, None), (3, 5.0)], "seq int, reading double")
    got = {r.seq: r.ocr for r in R.update_pass(obs, readings).collect()}
    assert got == {1: {"A": 2.0, "C": 2.0}, 2: {"C": None}, 3: {"A": 1.0, "C": 5.0}, None: {"A": 1.0}}
    assert tuple(R.pass_tally(obs, readings).first()) == (3, 1, 1, 1)
    assert tuple(R.pass_tally(obs, readings.limit(0)).first()) == (0, 0, 0, 0)


def test_strict_gate(spark):
    obs = spark.createDataFrame([(1.0, True), (2.0, False), (3.0, None), (None, False)], "value double, verified boolean")
    assert sorted(r.value for r in R.check_verified(obs, "verified").collect()) == [2.0, 3.0]
    with pytest.raises(R.Unverified, match="2 shown"):
        R.check_verified(obs, "verified", strict=True)
    assert R.check_verified(obs.filter("verified"), "verified", strict=True).count() == 0


def test_marks_in_flag_or_interpretation(spark):
    rows = [(1, "a", 1, 1.0, " ch ", None), (1, "a", 2, 1.0, None, "N"), (1, "b", 1, 1.0, None, "\tll"), (1, "c", 1, None, "CH", None), (1, "d", 1, 1.0, "H", "L"), (1, "e", 2, 5.0, "HH", None), (1, "e", 3, None, None, None)]
    obs = spark.createDataFrame(rows, "patient_id int, analyte string, day int, value double, printed_flag string, interpretation string")
    assert {(r.analyte, r.severity) for r in S.critical_flags(obs).collect()} == {("a", "high"), ("b", "critical"), ("e", "critical")}


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_sentences(spark):
    names = lambda *x: F.array(*[F.lit(n) for n in x]) if x else F.array().cast("array<string>")
    assert one(spark, *[W.joined(names(*"abc"[:n])) for n in range(4)]) == ("", "a", "a and b", "a, b and c")
    title = lambda before, n: W.group_title(F.lit(before), F.lit(" remains high"), names(*"abcdef"[:n]))
    assert one(spark, title("", 1), title("", 2), title("See ", 4), title("See ", 5)) == ("a remains high", "2 tests remain high", "See a, b, c and d remains high", "See 5 tests remain high")
    t = lambda *x: F.lit(datetime(*x))
    n = F.lit(None).cast("timestamp")
    got = one(spark, W.span(t(2024, 3, 4), t(2024, 3, 7), F.lit(1), F.lit(4)), W.span(t(2024, 3, 4), t(2024, 4, 1), F.lit(1), F.lit(2)), W.span(n, n, F.lit(2), F.lit(2)), W.span(n, t(2024, 3, 4), F.lit(2), F.lit(5)))
    assert got == ("04-07 Mar", "04 Mar-01 Apr", "day 2", "days 2-5")
    d = lambda *x: F.lit(date(*x))
    got = one(spark, W.date_range(d(2024, 3, 4), d(2024, 3, 11)), W.date_range(d(2024, 3, 4), d(2024, 3, 4)), W.date_range(d(2023, 3, 4), d(2024, 3, 4)), W.date_range(F.lit(None).cast("date"), d(2024, 3, 4)))
    assert got == ("4 to 11 March 2024", "4 March 2024", "4 March 2023 to 4 March 2024", "")
    x = F.lit(None).cast("double")
    assert one(spark, W.tooltip(x, x, x, n, F.lit(None).cast("boolean"), F.lit(None).cast("int")), W.tooltip(F.lit(30.0), F.lit(1.0), F.lit(10.0), n, F.lit(True), F.lit(3))) == ("", "3.0 times the upper limit. Marked as critical by the laboratory. From page 3.")


def test_axes(spark):
    x = F.lit(None).cast("double")
    a, b = one(spark, W.axis(x, x, x, x), W.axis(F.lit(5.0), F.lit(5.0), x, x))
    assert tuple(a) == (0.0, 1.0) and tuple(round(v, 6) for v in b) == (4.97, 5.53)
    assert one(spark, W.log_place(F.lit(0.2), 8.0, 0.0, 90.0), W.log_place(F.lit(8.0), 8.0, 0.0, 90.0)) == (90.0, 0.0)


def test_search_by_concept_and_day(spark):
    chunks = spark.createDataFrame([("k", "creatinine rose slowly"), ("o", "platelets were stable"), ("d", "nothing named here"), ("w", "kidneys looked normal")], "id string, text string")
    dictionary = spark.createDataFrame([("creatinine", "Creatinine", ["creat"], "how the kidneys work")], "analyte string, display string, aliases array<string>, plain string")
    assert ("kidneys", "creatinine") in {tuple(r) for r in retrieval.concept_index(dictionary).collect()}
    days = spark.createDataFrame([("d", "day", 5, date(2024, 1, 5)), ("o", "series", 6, date(2024, 1, 6))], "id string, kind string, day int, date date")
    found = lambda q, **more: [r.id for r in retrieval.search(q, chunks, **more).orderBy("place").collect()]
    assert found("what about the kidneys?") == ["w"]
    assert found("what about the kidneys?", entries=dictionary) == ["w", "k"]
    assert found("kidneys on day 5?", entries=dictionary, chunk_days=days)[0] == "d"
    assert found("anything on 6 January?", chunk_days=days) == ["o"]
    assert found("anything?", chunk_days=days) == []
    said = retrieval.answer("kidneys on day 5?", chunks, lambda m: m[-1]["content"], entries=dictionary, chunk_days=days)
    assert said["ok"] and said["sources"][0] == "d" and "creatinine rose" in said["text"]
