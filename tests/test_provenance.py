"""Provenance with all gates, formula cards, and orders of movers and systems."""

from datetime import datetime

from tidemark.operators import quality as Q
from tidemark.plans import daily
from tidemark.plans import views as V

from .test_series import frame

KINDS = "patient_id long, day int, seq long, analyte string, a double, b double, c double, value double, low double, high double, printed_flag string, page long, human_verified boolean"


def test_gates_with_details(spark):
    rows = [
        (1, 1, 1, "pt", 30.0, 30.0, 30.0, 30.0, 10.0, 14.0, "H", 7, True), (1, 1, 2, "pt_mnpt", 15.0, None, None, 15.0, None, None, None, 7, None), (1, 1, 3, "inr", 2.0, 2.0, 20.0, 2.0, 0.8, 1.2, None, 7, False),
        (1, 2, 4, "x", None, None, None, None, 1.0, 2.0, "CH", 8, None), (1, 2, 5, "y", 1.0, 2.0, 400.0, 400.0, 1.0, 5.0, "CL", 8, None), (1, 2, 6, "z", 1.0, 1.0, None, 1.0, 0.5, 5.0, "H", 8, None), (2, 1, 7, "inr", 9.0, 9.0, 9.0, 9.0, None, 20.0, None, 9, None),
    ]
    obs = spark.createDataFrame(rows, KINDS)
    samples = spark.createDataFrame([(1, 1, "pt", 30.0), (1, 1, "pt_mnpt", 15.0), (1, 1, "inr", 2.0), (2, 1, "inr", 9.0), (2, 1, "pt", 30.0), (2, 1, "pt_mnpt", 15.0)], "patient_id long, day int, analyte string, value double")
    got = {r.seq: r for r in Q.with_provenance(obs, samples, ["patient_id", "day"]).collect()}
    gates = lambda s: {k: tuple(v) for k, v in got[s].provenance.gates.items()}
    assert gates(1) == {"ensemble": ("pass", "unanimous"), "flag_consistency": ("pass", "flag H agrees"), "envelope": ("pass", "30.0 is within 0.0 to 300.0"), "arithmetic": ("pass", "agrees with inr")}
    assert gates(2)["ensemble"] == ("weak", "single pass only") and gates(2)["flag_consistency"] == ("skip", "no usable reference range")
    assert gates(3)["ensemble"] == ("weak", "majority 2.0 of [2.0, 20.0]") and gates(3)["flag_consistency"] == ("weak", "no flag printed but value reads H")
    assert gates(4) == {"ensemble": ("fail", "no pass produced a value"), "flag_consistency": ("skip", "no value"), "envelope": ("skip", "no value")}
    assert gates(5)["ensemble"] == ("fail", "no majority among [1.0, 2.0, 400.0]") and gates(5)["envelope"] == ("fail", "400.0 isn't within 0.0 to 300.0")
    assert gates(6)["flag_consistency"] == ("fail", "page says H but value 1.0 reads N") and gates(7)["arithmetic"] == ("fail", "breaks inr")
    assert (got[1].needs_review, got[3].needs_review, got[7].needs_review) == (False, True, True)
    assert (got[4].interpretation, got[4].critical, got[5].interpretation) == ("HH", True, "LL")
    assert got[3].provenance.ocr == {"A": 2.0, "B": 2.0, "C": 20.0} and got[1].provenance.human_verified and not got[2].provenance.human_verified


def test_differential_is_of_the_sample(spark):
    obs = spark.createDataFrame([(1, 1, k, f"s{k}", 25.0, 25.0, 25.0, 25.0, None, None, None, 1, None) for k in range(4)], KINDS)
    samples = obs.select("patient_id", "day", "analyte", "value")
    got = Q.with_provenance(obs, samples, ["patient_id", "day"]).collect()
    assert all(tuple(r.provenance.gates["differential"]) == ("pass", "shares add up") for r in got)
    assert Q.with_provenance(obs.limit(0), samples.limit(0), ["patient_id", "day"]).count() == 0


def test_cards_of_the_latest_day(spark):
    at = datetime(2024, 1, 1)
    rows = [(1, "anc", 1, at, 1, 6.0), (1, "alc", 1, at, 2, 3.0), (1, "anc", 4, at, 3, 8.0), (1, "alc", 4, at, 4, 2.0)]
    cards = {r.name: r for r in daily.formula_cards(daily.daily_scores(spark.createDataFrame(rows, "patient_id long, analyte string, day int, collected timestamp, seq long, value double"))).collect()}
    assert len(cards) == 7 and (cards["nlr"].day, cards["nlr"].value, cards["nlr"].missing) == (4, 4.0, [])
    assert not cards["meld3"].complete and cards["aarc"].notes == [daily.LACTATE_NOTE]


def test_orders(spark):
    p = frame(spark, [10, 20], 1.0, 5.0, 1, "a").unionByName(frame(spark, [10, 5], 1.0, 4.0, 1, "b")).unionByName(frame(spark, [10, 40], 1.0, 4.0, None, "c")).unionByName(frame(spark, [10, 30], 1.0, 4.0, -1, "d"))
    assert [(r.analyte, r.direction) for r in V.directional_movers(p, 2).orderBy("place").collect()] == [("d", "better"), ("a", "worse")]
    folds = [r.last_fold for r in V.systems_by_fold(p).orderBy("place").collect()]
    assert folds == sorted(folds, reverse=True)
