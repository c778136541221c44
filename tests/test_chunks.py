"""Chunks of scores, findings and results in words, and their citations."""

from datetime import datetime

from tidemark.plans import chunks as C


def test_three_kinds(spark):
    day = lambda d: datetime(2024, 1, d, 8)
    rows = [
        (1, "inr", "INR", 1, day(1), "quantity", 1.2, None, 3, 1), (1, "crp", "CRP", 1, day(1), "quantity", 9.0, None, 4, 2),
        (1, "inr", "INR", 3, day(3), "quantity", 2.0, None, 5, 3), (2, "inr", "INR", 1, day(1), "quantity", 1.0, None, 9, 4),
        (1, "culture", "Blood culture", 2, day(2), "qualitative", None, "No growth", 7, 5),
    ]
    obs = spark.createDataFrame(rows, "patient_id long, analyte string, display string, day int, collected timestamp, kind string, value double, text string, page long, seq long")
    scores = spark.createDataFrame([(1, 1, "meld3", (20.0, True, [], "")), (1, 1, "aarc", (None, False, ["lactate", "inr"], "")), (1, 9, "meld3", (None, False, [], ""))], "patient_id long, day int, name string, score struct<value:double,complete:boolean,missing:array<string>,band:string>")
    got = {r.id: r for r in C.score_chunks(scores, obs).collect()}
    assert got["score:1"].text == "Severity scores for day 1: aarc not computed: missing lactate, inr; meld3 = 20.0."
    assert (got["score:1"].pages, got["score:1"].cites) == ([3, 4], "3@2024-01-01 4@2024-01-01")
    assert (got["score:9"].pages, got["score:9"].cites) == ([], "") and "unrecorded inputs" in got["score:9"].text

    found = spark.createDataFrame([("rising-run", "high", 1, "inr", 1, 3), ("meld-escalation", "high", 1, None, 1, 2), ("x", "info", 1, None, None, None)], "rule string, severity string, patient_id long, analyte string, from_day int, to_day int")
    got = {r.id.split(":")[1]: r for r in C.pattern_chunks(found, obs).collect()}
    assert (got["rising-run"].days, got["rising-run"].pages) == ([1, 3], [3, 5])
    assert (got["meld-escalation"].days, got["meld-escalation"].pages, got["meld-escalation"].analytes) == ([1, 2], [3, 4, 7], [])
    assert got["x"].days == [] and got["x"].cites == ""

    (q,) = C.qualitative_chunks(obs).collect()
    assert q.text == "Blood culture result: No growth. Collected 2024-01-02 08:00 (day 2)." and (q.days, q.cites) == ([2], "7@2024-01-02")
    all_kinds = C.score_chunks(scores, obs).unionByName(C.pattern_chunks(found, obs)).unionByName(C.qualitative_chunks(obs))
    assert all_kinds.count() == 6
