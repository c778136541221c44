"""Findings in words on made series, number formats, and all daily scores against plain Python."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark import fixed_values as X
from tidemark.functions.exprs import general, reference_sentence, signed_percent
from tidemark.operators import series as S
from tidemark.plans import daily, findings
from tidemark.sources import dictionary as D

POINT = "patient_id long, analyte string, day int, value double, collected timestamp, display string, unit string, low double, high double, valence int, headline boolean"
OBS = POINT + ", seq long, printed_flag string, interpretation string"


def at(day, hour=8):
    return dt.datetime(2024, 2, 25, hour) + dt.timedelta(days=day - 1)


def series(analyte, values, low=None, high=None, unit="u", start=1, valence=None, display=None, patient=1, headline=False, gap=1):
    return [(patient, analyte, start + gap * k, None if v is None else float(v), at(start + gap * k), display or analyte.title(), unit, None if low is None else float(low), None if high is None else float(high), valence, headline) for k, v in enumerate(values)]


def found(spark, rows, flags=(), scores=()):
    points = spark.createDataFrame([r for r in rows if r[3] is not None], POINT)
    obs = spark.createDataFrame([(*r, k, dict(flags).get(k), None) for k, r in enumerate(rows)], OBS)
    meld = spark.createDataFrame(list(scores), "patient_id long, day int, score double")
    return findings.findings(points, obs, meld)


def told(spark, *args, **more):
    return {(r.rule, r.analyte, tuple(e.day for e in r.evidence)): r for r in found(spark, *args, **more).collect()}


def test_numbers_like_percent_g(spark):
    rng = random.Random(2)
    xs = [0.0, 1.0, -1.5, 1e-4, 9.9999e-5, 123456.0, 1234567.0, 999999.5, 1e22, -1e-9, 100000.0, 2.3e-300, 1.7e308, 14.0, 2.50, float("inf"), float("nan")] + [rng.choice([1, -1]) * rng.random() * 10 ** rng.randrange(-8, 12) for _ in range(400)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", general(F.col("x")).alias("g"), general(F.col("x"), signed=True).alias("s")).collect()
    assert [(r.g, r.s) for r in got] == [(f"{r.x:g}", f"{r.x:+g}") for r in got]
    whole = [x for x in xs if abs(x) < 1e15] + [0.5, 1.5, 2.5, -0.5, -2.5, -0.2]
    got = spark.createDataFrame([(x,) for x in whole], "x double").select("x", signed_percent(F.col("x")).alias("p")).collect()
    assert [r.p for r in got] == [f"{r.x:+.0f}" for r in got]
    assert spark.createDataFrame([(None, 2.0, 3.0)], "x double, a double, b double").select(general(F.col("x")), reference_sentence(F.col("a"), F.col("b")), reference_sentence(F.col("x"), F.col("b")), reference_sentence(F.col("a"), F.col("x")), reference_sentence(F.col("x"), F.col("x"))).first()[:] == (None, "Reference 2-3.", "Reference upper limit 3.", "Reference lower limit 2.", "")


def test_runs(spark):
    rows = series("urea", [10, 12, 14, 17, 20], 5, 40, "mg/dL", valence=1) + series("albumin", [2, 2.4, 3], valence=-1, unit="") + series("wbc", [9, 8, 7, 7.05, 6, 5, 3]) + series("flat", [5, 5.01, 5.02, 5.0]) + series("small", [100, 103.5, 107.2])
    got = told(spark, rows)
    up = got["rising-run", "urea", (1, 2, 3, 4, 5)]
    assert (up.severity, up.audience, up.headline) == ("high", X.BOTH, "Urea has risen at every check for 4 days.")
    assert up.detail == "10 -> 12 -> 14 -> 17 -> 20 mg/dL (25-29 Feb); +100% over 4 days. Reference 5-40." and [e.value for e in up.evidence] == [10, 12, 14, 17, 20]
    good = got["rising-run", "albumin", (1, 2, 3)]
    assert (good.severity, good.headline, good.detail) == ("info", "Albumin has risen at every check for 2 days - it is moving in the right direction.", "2 -> 2.4 -> 3 (25-27 Feb); +50% over 2 days.")
    assert got["falling-run", "wbc", (1, 2, 3)].audience == X.DOCTOR and ("falling-run", "wbc", (4, 5, 6, 7)) in got
    assert not {k for k in got if k[1] in ("flat", "small") and "run" in k[0]}


def test_deltas(spark):
    rows = series("sodium", [138, 126], 135, 145, "mEq/L", valence=-1) + series("lactate", [1, 1.7, 1.6, 4.5], None, 2, valence=1) + series("slow", [1, 3], gap=2) + series("climb", [1, 1.6, 2.5, 4]) + series("leap", [1, 1.6, 2.5, 9, 10], 0, 3, valence=1)
    got = told(spark, rows)
    salt = got["delta-24h", "sodium", (1, 2)]
    assert salt.headline == "Sodium fell by more than its whole normal range in one day." and salt.severity == "moderate"
    assert salt.detail == "138 -> 126 mEq/L (25-26 Feb); -12 (-9%), range width 10. Reference 135-145."
    sharp = got["delta-24h", "lactate", (3, 4)]
    assert sharp.headline == "Lactate rose by more than half its previous value in one day." and sharp.detail == "1.6 -> 4.5 u (27-28 Feb); +2.9 (+181%). Reference upper limit 2."
    leap = got["delta-24h", "leap", (3, 4)]
    assert leap.severity == "high" and {k[1] for k in got if k[0] == "delta-24h"} == {"sodium", "lactate", "leap"}


def test_crossings(spark):
    rows = series("inr", [1, 2, 1, 3, 1], 0.8, 1.2, headline=True) + series("k", [4, 2], 3, None) + series("free", [1, 9])
    got = told(spark, rows)
    assert got["range-exit", "inr", (1, 2)].headline.endswith("for the first time.") and got["range-exit", "inr", (1, 2)].severity == "high"
    again = got["range-exit", "inr", (3, 4)]
    assert again.headline == "Inr has moved out of the normal range again." and again.detail == "1 -> 3 (above range) u (27-28 Feb). Reference 0.8-1.2."
    back = got["range-return", "inr", (2, 3)]
    assert (back.severity, back.headline, back.detail) == ("info", "Inr is back inside the normal range.", "2 -> 1 (within reference) u (26-27 Feb). Reference 0.8-1.2.")
    low = got["range-exit", "k", (1, 2)]
    assert (low.severity, low.detail) == ("moderate", "4 -> 2 (below range) u (25-26 Feb). Reference lower limit 3.")
    assert not {k for k in got if k[1] == "free" and k[0].startswith("range")}


def test_critical_marks(spark):
    rows = series("k", [4, 7, 6], 3, 5, "mEq/L", display="Potassium") + series("crp", [9, 300], None, 5) + series("none", [1, None])
    got = told(spark, rows, flags=[(1, " ch"), (4, "HH"), (6, "CH")])
    done = got["critical-flag", "k", (2, 3)]
    assert done.severity == "high" and done.headline == X.RESOLVED_HEAD % "potassium"
    assert done.detail == "Potassium 7 mEq/L flagged  ch on day(s) 2; latest 6 mEq/L on day 3 is unflagged; reference 3-5."
    live = got["critical-flag", "crp", (2,)]
    assert (live.severity, live.headline, live.detail) == ("critical", X.CRITICAL_HEAD % "crp", "Crp 300 u flagged HH on day(s) 2.")


def test_score_rises(spark):
    scores = [(1, 1, 20.0), (1, 2, 22.0), (1, 3, 26.0), (1, 6, 40.0), (2, 1, 10.0), (2, 2, 12.0)]
    got = told(spark, series("x", [1]), scores=scores)
    rise = got["meld-escalation", None, (1, 3)]
    assert rise.detail == "MELD 3.0 20 (day 1) -> 26 (day 3), +6 points in 2 day(s)." and len([k for k in got if k[0] == "meld-escalation"]) == 1


def markers(**moves):
    return [r for a, (x, y) in moves.items() for r in series(a, [x, y], 0, 100, "", start=9, valence={"inr": 1, "bilirubin_total": 1, "albumin": -1}.get(a))]


def test_conjunctions(spark):
    three = dict(inr=(1, 2), albumin=(3, 2), bilirubin_total=(4, 8))
    bad = told(spark, markers(**three))["synthetic-failure", "inr", (9, 10, 9, 10, 9, 10)]
    assert bad.severity == "high" and bad.detail == X.FAILURE_GLOSS + " over 04-05 Mar: Inr 1->2, Albumin 3->2, Bilirubin_Total 4->8."
    assert [e.analyte for e in bad.evidence] == ["inr", "inr", "albumin", "albumin", "bilirubin_total", "bilirubin_total"]
    assert not any(k[0] == "synthetic-failure" for k in told(spark, markers(**three | {"albumin": (2, 3)})))
    apart = markers(inr=(1, 2), albumin=(3, 2)) + series("bilirubin_total", [4, 8], start=1)
    assert not any(k[0] == "synthetic-failure" for k in told(spark, apart))
    kidney = told(spark, markers(creatinine=(1, 2), urea=(20, 40), sodium=(140, 130)))
    assert [r.detail for k, r in kidney.items() if k[0] == "renal-cluster"][0].endswith("Sodium 140->130. " + X.RENAL_NOTE)
    gas = told(spark, markers(creatinine=(1, 2), urea=(20, 40), abg_sodium=(140, 130)))
    assert not any(k[0] == "renal-cluster" for k in gas)


def test_infection_oxygen_and_discordance(spark):
    rising = dict(procalcitonin=(1, 2), crp=(5, 9), wbc=(4, 8), neutrophils_pct=(50, 50))
    got = [r for k, r in told(spark, markers(**rising)).items() if k[0] == "infection-cluster"][0]
    assert (got.severity, got.detail) == ("moderate", "3 of 4 infection markers rising: Procalcitonin 1->2, Crp 5->9, Wbc 4->8.")
    assert [r.severity for k, r in told(spark, markers(**rising | {"nlr": (1, 3)})).items() if k[0] == "infection-cluster"] == ["high"]
    falling = markers(procalcitonin=(2, 1), crp=(9, 5), wbc=(8, 4))
    assert [r.severity for k, r in told(spark, falling).items() if k[0] == "infection-improving"] == ["info"]
    odd = [r for k, r in told(spark, falling + markers(inr=(1, 2), bilirubin_total=(4, 8))).items() if k[0] == "discordance"][0]
    assert odd.headline == X.LIVER_WORSE_HEAD and odd.audience == X.DOCTOR and odd.analyte is None and odd.detail == X.LIVER_WORSE_DETAIL % (3, 3, 2, 2)
    other = [r for k, r in told(spark, markers(procalcitonin=(1, 2), crp=(5, 9), inr=(2, 1), albumin=(2, 3))).items() if k[0] == "discordance"][0]
    assert other.detail == X.LIVER_BETTER_DETAIL % (2, 2, 2, 2)
    air = told(spark, series("abg_po2", [50], 80, None, "mmHg", start=1) + series("lactate", [1, 3], 0, 2, "mmol/L", start=9))
    assert air["low-oxygen", "abg_po2", (1,)].detail == "pO2 50 mmHg (25 Feb). Reference lower limit 80."
    assert (air["perfusion", "lactate", (9, 10)].severity, air["perfusion", "lactate", (9, 10)].detail) == ("high", "Lactate 1 -> 3 mmol/L (04-05 Mar). Reference 0-2.")


def test_groups(spark):
    entries = D.as_of(spark.createDataFrame([(a, 1, False, k, d, [], "u", None, None, None, "s", None) for k, (a, d) in enumerate([("a", "Alpha"), ("b", "Beta"), ("c", "Gamma")])], D.SCHEMA))
    rows = [r for a, d in (("b", "Beta"), ("a", "Alpha"), ("c", "Gamma")) for r in series(a, [1, 1.2, 1.5], valence=1, display=d)]
    flags = [(2, "CH"), (5, "CH")]
    got = findings.grouped(found(spark, rows, flags, [(2, 1, 10.0), (2, 2, 20.0)]), entries).orderBy("patient_id", "place").collect()
    assert [(r.patient_id, r.severity, r.title, r.n) for r in got] == [
        (1, "critical", X.CRITICAL_HEAD % "Alpha and Beta", 2),
        (1, "moderate", "3 tests have risen at every check for 2 days.", 3),
        (2, "high", X.MELD_HEAD, 1),
    ]
    assert [i.label for i in got[1]["items"]] == ["Alpha", "Beta", "Gamma"] and findings.grouped(found(spark, rows).limit(0), entries).count() == 0


def test_empty_and_odd(spark):
    assert found(spark, []).count() == 0
    assert found(spark, series("x", [1]) + series("x", [None], start=2)).count() == 0


# --- scores of every day ----------------------------------------------------------------------

def plain_daily(rows):
    """{(patient, day): (values in use, carried)} of (patient, analyte, day, collected, seq, value) rows."""
    out = {}
    for p in {r[0] for r in rows}:
        days = sorted({r[2] for r in rows if r[0] == p})
        last = {(d, a): max((r for r in rows if r[:3] == (p, a, d) and r[5] is not None), key=lambda r: (r[3], r[4]), default=None) for d in days for a in {r[1] for r in rows if r[0] == p}}
        for d in days:
            now = {a: r[5] for (e, a), r in last.items() if e == d and r is not None}
            past = {}
            for a in daily.CARRIED:
                old = [e for (e, b), r in last.items() if b == a and r is not None and e < d]
                if a not in now and old and d - max(old) <= 2:
                    past[a] = (max(old), d - max(old))
            out[p, d] = (now | {a: last[e, a][5] for a, (e, _) in past.items()}, past)
    return out


def test_daily_values_against_plain(spark):
    rng = random.Random(4)
    names = [*daily.CARRIED, "anc", "alc", "pt"]
    rows = []
    for s in range(500):
        day = rng.randrange(1, 15)
        rows.append((rng.randrange(3), rng.choice(names), day, at(day, rng.randrange(3)), s, rng.choice([None, float(rng.randrange(1, 50))])))
    obs = spark.createDataFrame(rows, "patient_id long, analyte string, day int, collected timestamp, seq long, value double").repartition(5)
    got = {(r.patient_id, r.day): (r.vals, {k: tuple(v) for k, v in r.carried_forward.items()}) for r in daily.carried_values(daily.day_values(obs)).collect()}
    assert got == plain_daily(rows)


def test_daily_scores(spark):
    value = lambda a, day, v, s=0: (1, a, day, at(day), s, v)
    rows = [value("bilirubin_total", 1, 8.1), value("inr", 1, 2.89), value("creatinine", 2, 1.2), value("sodium", 3, 130.0), value("albumin", 3, 2.4), value("lactate", 4, 3.0), value("alc", 4, 0.0), value("anc", 4, 5.0), value("pt", 3, 20.0), value("pt_mnpt", 3, 12.0), value("abg_sodium", 3, 140.0), value("abg_chloride", 3, 100.0), value("abg_hco3", 3, 24.0), (1, "wbc", 9, at(9), 1, None)]
    got = {r.day: r for r in daily.daily_scores(spark.createDataFrame(rows, "patient_id long, analyte string, day int, collected timestamp, seq long, value double")).collect()}
    assert set(got) == {1, 2, 3, 4, 9}
    full = got[3]
    raw = 4.56 * math.log(8.1) + 0.82 * 7 - 0.24 * 7 * math.log(8.1) + 9.09 * math.log(2.89) + 11.14 * math.log(1.2) + 1.85 * 1.1 - 1.83 * 1.1 * math.log(1.2) + 6
    assert (full.meld3.value, full.meld3.band, full.meld3.assumptions) == (math.floor(raw + 0.5), "30-39", [daily.ASSUMPTION])
    assert {k: tuple(v) for k, v in full.carried_forward.items()} == {"bilirubin_total": (1, 2), "inr": (1, 2), "creatinine": (2, 1)}
    assert (full.anion_gap.value, full.anion_gap.band) == (16.0, "in-envelope") and (full.maddrey.value, full.maddrey.band) == (44.9, "severe")
    assert full.child_pugh.missing == ["ascites_grade", "encephalopathy_grade"] and full.aarc.notes == [daily.LACTATE_NOTE]
    assert got[4].meld3.missing == ["bilirubin_total", "inr"] and got[4].meld3.value is None and got[4].nlr.missing == ["alc"]
    assert got[2].maddrey.missing == ["pt", "pt_mnpt"] and got[9].carried_forward == {} and got[9].meld_na.missing == ["bilirubin_total", "inr", "creatinine", "sodium"]


def test_daily_scores_of_nothing(spark):
    none = spark.createDataFrame([], "patient_id long, analyte string, day int, collected timestamp, seq long, value double")
    assert daily.daily_scores(none).count() == 0


@pytest.mark.parametrize("days", [1, 3])
def test_tails_are_of_the_record(spark, days):
    rows = series("a", [1, 2, 3]) + series("b", [1, 2], start=1)
    got = findings.patient_tails(spark.createDataFrame(rows, POINT), days).first().tails
    assert [len(got[x].points) for x in "ab"] == [days, max(0, days - 1)] and S.TREND_DAYS == 3
