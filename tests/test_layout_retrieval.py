"""Layout, timelines, label matching, retrieval, scans and streams."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.plans import checks as K
from tidemark.plans import layout as L
from tidemark.plans import retrieval as R
from tidemark.streaming import series as T


def test_lines_and_rows(spark):
    w = [(1, 1, "Hemo", 20, 100, 50, 20), (1, 2, "globin", 80, 104, 50, 20), (1, 3, "13.5", 400, 102, 40, 18), (1, 4, "g/dL", 620, 101, 40, 20), (1, 5, "12-16", 800, 99, 60, 20), (1, 6, "Next", 20, 140, 50, 20), (2, 1, "Other", 20, 100, 50, 20)]
    words = spark.createDataFrame(w, "page int, word_no int, text string, left int, top int, width int, height int")
    got = [tuple(r) for r in L.to_rows(L.group_lines(words), 1000).orderBy("page", "line").collect()]
    assert got == [(1, 0, "Hemo globin", "13.5", "g/dL", "12-16"), (1, 1, "Next", "", "", ""), (2, 0, "Other", "", "", "")]


def test_band_pairs_against_greedy(spark):
    rng = random.Random(4)
    rows, want = [], set()
    for p in range(60):
        y, runs = 0, []
        for _ in range(rng.randrange(1, 9)):
            y += rng.randrange(5, 150)
            tall = rng.randrange(5, 30)
            runs.append((y, y + tall - 1, tall))
            y += tall
        rows += [(p, *r) for r in runs]
        k = 0
        while k < len(runs):
            if k + 1 < len(runs) and runs[k + 1][0] - runs[k][1] <= max(30, 3 * runs[k][2]):
                want |= {(p, runs[k][0], "header"), (p, runs[k + 1][0], "sample")}
                k += 2
            else:
                want.add((p, runs[k][0], "unknown"))
                k += 1
    got = L.pair_bands(spark.createDataFrame(rows, "page int, top int, bottom int, tall int")).collect()
    assert {(r.page, r.top, r.kind) for r in got} == want


def test_wrapped_rows(spark):
    rows = [(1, 1, "Total", "", "", ""), (1, 2, "bilirubin", "", "", ""), (1, 3, "Urea", "30", "", "10-40"), (1, 4, "", "", "mg/dL", "")]
    got = L.merge_wrapped(spark.createDataFrame(rows, "page int, line int, test string, result string, unit string, range string")).orderBy("entry").collect()
    assert [(r.test, r.result, r.unit, r.range) for r in got] == [("Total bilirubin", "", "", ""), ("Urea", "30", "mg/dL", "10-40")]


def test_labels(spark):
    aliases = spark.createDataFrame([("HEMOGLOBIN", "hb"), ("TOTALBILIRUBIN", "bili"), ("PT", "pt")], "alias_norm string, key string")
    labels = spark.createDataFrame([("Hemoglobin:",), ("PT control value",), ("Hemoglobln",), ("xyz",), ("",), ("Total Bilirubin, Serum",)], "label string")
    got = {r.label: (r.key, r.match) for r in L.match_labels(labels, aliases).collect()}
    assert got == {"Hemoglobin:": ("hb", "exact"), "PT control value": ("pt", "prefix"), "Hemoglobln": ("hb", "fuzzy"), "xyz": (None, "none"), "": (None, "none"), "Total Bilirubin, Serum": ("bili", "exact")}
    s = spark.createDataFrame([("abcd", "bcde"), (None, "a")], "a string, b string").select(L.similarity(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r.r for r in s] == [0.75, None]


def test_merged_timeline(spark):
    d = lambda *days: [(1, k, date(2024, 3, x)) for k, x in enumerate(days)] + [(1, 99, date(2023, 3, 9))]
    s = spark.createDataFrame(d(1, 10, 11, 12, 14, 20), "patient_id int, seq int, date date")
    assert tuple(L.date_window(s).first()) == (1, date(2024, 3, 10), date(2024, 3, 14))
    at = datetime(2024, 3, 1, 8)
    r = L.repair_aliquots(spark.createDataFrame([(1, "LAB1234567-A", at), (2, "LAB1234567-B", None), (3, "LAB7654321", None), (4, None, None)], "seq int, sample_id string, collected timestamp"))
    assert {(x.seq, x.collected, x.repaired) for x in r.collect()} == {(1, at, False), (2, at, True), (3, None, False), (4, None, False)}


def test_sheets(spark):
    items = [(k, a) for k, a in enumerate("a" * 20 + "b" * 5 + "c" * 3)]
    got = {r.analyte: r.sheet for r in L.batches(spark.createDataFrame(items, "seq int, analyte string")).collect()}
    assert got == {"a": 0, "b": 0, "c": 1}


def test_answers(spark):
    chunks = spark.createDataFrame([("a", "creatinine rose on day two"), ("b", "sodium fell"), ("c", "nothing here")], "id string, text string")
    got = R.answer("How did the creatinine do?", chunks, lambda m: m[1]["content"][:8])
    assert got == {"ok": True, "text": "Sources:", "sources": ["a"]}
    bad = R.answer("sodium?", chunks, lambda m: 1 / 0)
    assert not bad["ok"] and bad["sources"] == ["b"]


def test_dates(spark):
    cases = {"on 6th Mar and Mar 8": [306, 308], "2024-03-06": [306, 603], "6/3": [306], "day after": [], None: None}
    for text, want in cases.items():
        got = spark.createDataFrame([(text,)], "t string").select(R.mentioned_dates(F.col("t")).alias("d")).first().d
        assert got == want


def test_leaks(spark):
    rows = [(1, "a\nmail me@place.org or x@example.org\nMRN: AB12345"), (2, "call 9812345670 or 1111111111"), (3, "0123456789 1234512345"), (6, "x9812345670_y\n+91 9812345671,919812345672 12345678901234"), (4, None), (5, "")]
    got = {(r.doc_id, r.rule): (r.n, r.first_line) for r in K.leaks(spark.createDataFrame(rows, "doc_id int, text string"), "doc_id").collect()}
    assert got == {(1, "e-mail"): (1, 2), (1, "labelled-id"): (1, 3), (2, "phone"): (1, 1), (3, "phone"): (1, 1), (6, "phone"): (3, 1)}


def test_stream_last_of_day(spark, tmp_path):
    kinds = "patient_id long, analyte string, collected timestamp, value double, seq long"
    at = datetime(2024, 1, 1, 8)
    batches = [[(1, "x", at, 1.0, 1), (1, "x", at + timedelta(hours=2), 2.0, 2)], [(1, "x", at + timedelta(days=10), 3.0, 3)], [(1, "x", at, 9.0, 4), (1, "x", at + timedelta(days=20), 4.0, 5)]]
    src = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(src))
        if k == 0:
            stream = spark.readStream.schema(kinds).parquet(str(src))
            q = T.last_of_day(T.without_repeats(stream), late=None).writeStream.outputMode("append").format("memory").queryName("last_of_day_test").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
    q.stop()
    got = {(r.date, r.value) for r in spark.sql("select * from last_of_day_test").collect()}
    assert got == {(date(2024, 1, 1), 2.0), (date(2024, 1, 11), 3.0)}


def test_stream_runs(spark, tmp_path):
    kinds = "patient_id long, analyte string, collected timestamp, value double, seq long"
    at = datetime(2024, 1, 1)
    src = tmp_path / "in"
    spark.createDataFrame([(1, "x", at + timedelta(days=k), float(v), k) for k, v in enumerate([1, 2, 3, 2])], kinds).coalesce(1).write.parquet(str(src))
    q = T.run_states(spark.readStream.schema(kinds).parquet(str(src))).writeStream.outputMode("update").format("memory").queryName("runs_test").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from runs_test").collect()] == [(1, "x", -1, 2)]
