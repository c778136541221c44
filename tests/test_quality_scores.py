"""Voting, gates, corrections and scores on worked cases."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import quality as Q
from tidemark.plans import scores as C


def one(spark, column, **values):
    kinds = {bool: "boolean", float: "double", int: "double", str: "string", type(None): "double"}
    cols = [F.lit(v).cast(kinds[type(v)]).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(column.alias("x")).first()["x"]


def reads(a, b, c):
    return {"a": a, "b": b, "c": c}


@pytest.mark.parametrize("abc, vote, gate", [((1.0, 1.0, 2.0), 1.0, "weak"), ((1.0, 2.0, 2.0), 2.0, "weak"), ((0.0, 2.0, 3.0), 0.0, "fail"), ((None, 2.0, 3.0), 2.0, "fail"), ((None, None, None), None, "fail"), ((5.0, None, None), 5.0, "weak"), ((5.0, 5.0, None), 5.0, "pass"), ((5.0, 5.0, 5.0), 5.0, "pass")])
def test_vote_and_ensemble(spark, abc, vote, gate):
    assert one(spark, Q.vote(*[F.col(x) for x in "abc"]), **reads(*abc)) == vote
    assert one(spark, Q.ensemble_gate(), **reads(*abc)) == gate


def test_choose(spark):
    pick = lambda *abc: one(spark, Q.choose(F.lit(10.0), F.lit(20.0), F.lit(0.0), F.lit(500.0)), **reads(*abc))
    assert pick(15.0, 15.0, 150.0) == 15.0
    assert pick(400.0, 400.0, 15.0) == 15.0  # the majority is not plausible, one other reading is
    assert pick(900.0, 15.0, None) == 15.0
    assert pick(15.0, 16.0, 17.0) == 15.0 and pick(900.0, 901.0, None) == 900.0


def test_decimal_shift(spark):
    rows = [(1, "x", k, v, v, b, None) for k, (v, b) in enumerate([(1.0, 1.0), (1.1, 1.1), (10.0, 1.0), (1.2, None)])]
    df = spark.createDataFrame(rows, "patient_id long, analyte string, seq long, value double, a double, b double, c double")
    assert [(r.seq, r.was, r.value) for r in Q.decimal_shift(df).collect()] == [(2, 10.0, 1.0)]
    assert Q.decimal_shift(df.limit(2)).count() == 0


def test_identities(spark):
    rows = [("s1", "mcv", 90.0), ("s1", "pcv", 45.0), ("s1", "rbc", 5.0), ("s1", "hb", 15.0), ("s1", "mch", 60.0), ("s2", "nlr", 2.0), ("s2", "anc", 4.0), ("s2", "alc", 0.0), ("s3", "protein_total", 7.0), ("s3", "albumin", 4.0), ("s3", "globulin", 3.1)]
    got = {(r.sample, r.analyte): (r.state, r.identity) for r in Q.identity_gate(spark.createDataFrame(rows, "sample string, analyte string, value double"), ["sample"]).collect()}
    assert got == {("s1", "mcv"): ("pass", "mcv"), ("s1", "pcv"): ("pass", "mcv"), ("s1", "rbc"): ("fail", "mch"), ("s1", "hb"): ("fail", "mch"), ("s1", "mch"): ("fail", "mch"),
                   ("s3", "protein_total"): ("pass", "protein"), ("s3", "albumin"): ("pass", "protein"), ("s3", "globulin"): ("pass", "protein")}


def test_units(spark):
    unit = lambda p: one(spark, Q.choose_unit(F.col("p"), F.lit("mg/dL"), ["g/L"]), p=p)
    assert tuple(unit(" MG / dl")) == ("mg/dL", False) and tuple(unit("")) == ("mg/dL", False)
    assert tuple(unit("g/L")) == ("g/L", True) and tuple(unit("??")) == ("mg/dL", False)


def score(spark, build, **values):
    return one(spark, build(**{k: F.col(k) for k in values}), **values)


BASE = {"bilirubin": 2.0, "inr": 1.5, "creatinine": 1.0, "sodium": 137.0, "albumin": 3.5, "female": False, "dialysis": False}


def test_meld3(spark):
    from math import floor, log

    s = score(spark, C.meld3, **BASE)
    assert s.value == floor(4.56 * log(2) + 9.09 * log(1.5) + 6 + 0.5) and s.complete and s.missing == [] and s.band == "10-19"
    assert score(spark, C.meld3, **BASE | {"female": True}).value == floor(1.33 + 4.56 * log(2) + 9.09 * log(1.5) + 6.5)
    assert score(spark, C.meld3, **BASE | {"bilirubin": 50.0, "inr": 9.0, "creatinine": 9.0}).value == 40
    assert score(spark, C.meld3, **BASE | {"bilirubin": 0.1, "inr": 0.5}).value == 6
    assert score(spark, C.meld3, **BASE | {"creatinine": 0.2, "dialysis": True}).value == score(spark, C.meld3, **BASE | {"creatinine": 3.0}).value
    assert score(spark, C.meld3, **BASE | {"sodium": 110.0}).value == score(spark, C.meld3, **BASE | {"sodium": 125.0}).value
    none = score(spark, C.meld3, **BASE | {"sodium": None, "albumin": None})
    assert none.value is None and not none.complete and none.missing == ["sodium", "albumin"] and none.band == ""


def test_other_scores(spark):
    assert score(spark, C.nlr, anc=4.0, alc=0.0).missing == ["alc"] and score(spark, C.nlr, anc=6.0, alc=4.0).value == 1.5
    assert score(spark, C.anion_gap, sodium=140.0, chloride=100.0, bicarbonate=24.0).value == 16.0
    assert score(spark, C.maddrey, pt=18.0, control=12.0, bilirubin=4.4).band == "severe"
    cp = {"bilirubin": 2.0, "albumin": 3.5, "inr": 1.7, "ascites": "none", "encephalopathy": "none"}
    assert score(spark, C.child_pugh, **cp).value == 8 and score(spark, C.child_pugh, **cp).band == "B"
    assert score(spark, C.child_pugh, **cp | {"albumin": 2.7, "ascites": "moderate"}).value == 11
    with pytest.raises(Exception, match="unknown grade"):
        score(spark, C.child_pugh, **cp | {"ascites": "lots"})
    assert score(spark, C.aarc, bilirubin=26.0, creatinine=1.5, inr=2.6, lactate=1.0, encephalopathy="3-4").value == 12
    m = {"bilirubin": 2.0, "inr": 1.5, "creatinine": 2.0, "sodium": 130.0, "dialysis": False}
    i = round(10 * (0.957 * 0.693147 + 0.378 * 0.693147 + 1.12 * 0.405465 + 0.643), 1)
    assert score(spark, C.meld_na, **m).value == int(i + 1.32 * 7 - 0.033 * i * 7 + 0.5)


def test_ranges(spark):
    ref = lambda t: tuple(one(spark, F.struct(*[c.alias(k) for k, c in X.parse_reference(F.col("t")).items()]), t=t))
    assert ref("3.5 - 5.0") == (3.5, 5.0) and ref("3–5") == (3.0, 5.0) and ref("< 40") == (None, 40.0) and ref(">1.5") == (1.5, None) and ref("9 - 2") == (None, None) and ref("") == (None, None)
    val = lambda t: tuple(one(spark, F.struct(*[c.alias(k) for k, c in X.parse_value(F.col("t")).items()]), t=t))
    assert val("12.5 H") == (12.5, "H", None) and val("(CL) 3") == (3.0, "CL", None) and val("- 4") == (-4.0, None, None) and val("1,5") == (1.5, None, None) and val("<0.5") == (0.5, None, "<") and val("none") == (None, None, None)
    assert one(spark, X.fold_outside(F.col("v"), F.col("l"), F.col("h")), v=0.0, l=1.0, h=2.0) is None
    assert one(spark, X.gauge_fold(F.col("v"), F.col("l"), F.col("h")), v=0.0, l=1.0, h=2.0) == 1.0
    assert one(spark, X.heat_fold(F.col("v"), F.col("l"), F.col("h")), v=500.0, l=1.0, h=2.0) == 20.0
    assert one(spark, X.clamp(F.col("v"), 1, 2), v=None) is None
    assert one(spark, X.range_label(F.col("l"), F.col("h")), l=1.5, h=1200.4) == "1.5 to 1200"
