"""Series operators on small hand-made frames and against plain loops."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.plans import rules
from tidemark.plans import views as V

KINDS = "patient_id long, analyte string, day int, value double, low double, high double, valence int, system string"


def frame(spark, values, low=None, high=None, valence=1, analyte="x", start=1):
    rows = [(1, analyte, start + k, float(v), low, high, valence, "A") for k, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, KINDS)


def runs_plain(values):
    """(direction, points, first, last) of maximal runs of three points and a net of 10 %."""
    out, k = [], 0
    step = lambda a, b: 0 if abs(b - a) < 0.03 * (abs(a) or 1) else (1 if b > a else -1)
    while k < len(values) - 1:
        d = step(values[k], values[k + 1])
        end = k + 1
        while d and end < len(values) - 1 and step(values[end], values[end + 1]) == d:
            end += 1
        if d and end - k >= 2 and abs(values[end] - values[k]) / (abs(values[k]) or 1) >= 0.10:
            out.append((d, end - k + 1, values[k], values[end]))
        k = end
    return sorted(out)


def test_runs_against_loop(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for p in range(150):
        values = [rng.choice([0.0, -1.0, 1.0, 2.0, 2.04, 3.0, 5.0, 5.1]) for _ in range(rng.randrange(1, 12))]
        rows += [(p, "x", d, v, None, None, 1, "A") for d, v in enumerate(values)]
        want[p] = runs_plain(values)
    got = {p: [] for p in want}
    for r in S.monotonic_runs(spark.createDataFrame(rows, KINDS)).collect():
        got[r.patient_id].append((r.dir, r.points, r.first_value, r.last_value))
    assert {p: sorted(v) for p, v in got.items()} == want


def test_run_severity(spark):
    sev = lambda *a, **k: [r.severity for r in S.run_findings(frame(spark, *a, **k)).collect()]
    assert sev([1, 2, 3]) == ["moderate"] and sev([1, 2, 3, 4, 5]) == ["high"]
    assert sev([1, 2, 3], valence=-1) == ["info"] and sev([1, 2, 3], valence=None) == ["info"]
    assert sev([1, 2]) == [] and sev([5, 5, 5]) == [] and sev([100, 101, 102]) == []
    assert len(sev([1, 2, 3, 2, 1])) == 2


def test_jumps(spark):
    jumps = lambda *a, **k: [(r.p_day, r.day, r.severity) for r in S.next_day_jumps(frame(spark, *a, **k)).collect()]
    assert jumps([10, 16]) == [(1, 2, "moderate")] and jumps([10, 12]) == []
    assert jumps([100, 125], low=10.0, high=30.0) == [(1, 2, "moderate")]
    assert jumps([10, 40], low=10.0, high=30.0) == [(1, 2, "high")]
    assert jumps([10, None, 40]) == [] and jumps([40, 10]) == [(1, 2, "info")]
    assert jumps([10, 16, 26]) == []  # a steady climb is a run already
    assert jumps([10, 16, 60]) == [(2, 3, "moderate")]


def test_crossings(spark):
    cross = lambda *a, **k: [(r.rule, r.ordinal) for r in S.range_crossings(frame(spark, *a, **k)).orderBy("day").collect()]
    assert cross([20, 40, 20, 40], low=10.0, high=30.0) == [("range-exit", 1), ("range-return", None), ("range-exit", 2)]
    assert cross([20, 40]) == [] and cross([20, 30, 10], low=10.0, high=30.0) == []


def test_last_of_day_ties(spark):
    at = datetime(2024, 1, 1, 8)
    rows = [(1, "x", 1, at, 1.0, 1), (1, "x", 1, at, 2.0, 2), (1, "x", 1, at - timedelta(hours=1), 3.0, 3), (1, "x", 2, at + timedelta(days=1), None, 4)]
    o = spark.createDataFrame(rows, "patient_id long, analyte string, day int, collected timestamp, value double, seq long")
    assert [r.value for r in S.last_of_day(o).collect()] == [2.0]
    assert [r.value for r in S.last_of_day(o, first_wins=True).collect()] == [1.0]


def test_carry_against_loop(spark):
    rng = random.Random(2)
    rows = [(p, a, d, rng.random(), None, None, 1, "A") for p in range(12) for a in "xy" for d in range(1, 15) if rng.random() < 0.3]
    have = {(p, a, d): v for p, a, d, v, *_ in rows}
    days = {p: {d for q, _, d in have if q == p} for p in range(12)}
    for most in (2, None):
        want = set()
        for p, a in {(p, a) for p, a, _ in have}:
            for d in days[p]:
                back = [x for x in range(d, 0, -1) if (p, a, x) in have and (most is None or d - x <= most)]
                if back:
                    want.add((p, a, d, have[p, a, back[0]], back[0], d - back[0]))
        assert {tuple(r) for r in S.carried(spark.createDataFrame(rows, KINDS), most).collect()} == want


def test_asof_last_of_equal_places(spark):
    left = spark.createDataFrame([(1, 1), (1, 5), (1, 9), (2, 5)], "k long, page long")
    right = spark.createDataFrame([(1, 5, "a", 1), (1, 5, "b", 2), (1, 7, "c", 3)], "k long, page long, found_as string, seq long")
    got = S.asof_backward(left, right, "k", "page", "found_as").collect()
    assert {(r.k, r.page, r.found_as) for r in got} == {(1, 1, None), (1, 5, "b"), (1, 9, "c"), (2, 5, None)}


def test_escalation(spark):
    s = spark.createDataFrame([(1, 1, 10.0), (1, 2, 12.0), (1, 3, 14.0), (2, 1, 10.0), (2, 4, 20.0), (3, 1, 10.0), (3, 2, 12.0)], "patient_id long, day int, score double")
    assert [tuple(r) for r in S.score_escalation(s, 3.0).collect()] == [(1, 4.0, 1, 3, 10.0, 14.0)]


def test_conjunction_and_clusters(spark):
    m = spark.createDataFrame([(1, "a", 1), (1, "b", -1), (2, "a", 1), (2, "b", 1), (3, "a", 1), (3, "b", 1), (3, "c", 1)], "patient_id long, analyte string, dir int")
    assert [r.patient_id for r in S.conjunction(m, {"a": 1, "b": -1}).collect()] == [1]
    assert [(r.patient_id, r.rule) for r in S.clusters(m, ["a", "b", "c"]).collect()] == [(3, "cluster")]


def test_constant_series_have_no_correlation(spark):
    p = frame(spark, [1, 1, 1, 1, 1], analyte="x").unionByName(frame(spark, [1, 2, 3, 4, 5], analyte="y")).unionByName(frame(spark, [2, 4, 6, 8, 10], analyte="z"))
    got = {(r["first"], r["second"]): r["r"] for r in V.correlations(p, ["x", "y", "z"]).collect()}
    assert got == {("y", "z"): 1.0}


def test_filter_and_hash(spark):
    df = spark.createDataFrame([(1, "view", "A", "H"), (2, "click", "A", "N"), (3, "error", "B", "HH")], "day int, analyte string, system string, interpretation string")
    ids = lambda **k: [r.day for r in V.filter_observations(df, **k).orderBy("day").collect()]
    assert ids() == [1, 2, 3] and ids(abnormal=True) == [1, 3] and ids(critical=True) == [3] and ids(text="IE") == [1] and ids(days=[2], groups=["A"]) == [2]
    state = {"days": [1, 3], "analytes": ["view"], "abnormal": True, "text": "a b"}
    assert V.hash_to_state("#" + V.state_to_hash(state)) == state


def test_no_crash_on_empty(spark):
    empty = frame(spark, [1]).limit(0)
    for f in (S.monotonic_runs, S.next_day_jumps, S.range_crossings, S.trends, S.carried, S.movement, V.burden, V.findings):
        assert f(empty).count() == 0
    assert S.steps(frame(spark, [1, 2])).filter(F.col("dir") == 1).count() == 1


def test_all_rules_in_one_shape(spark):
    base = [("inr", [1, 2, 3], 1), ("albumin", [3, 2, 1], -1), ("bilirubin_total", [1, 2, 4], 1), ("creatinine", [1, 2, 3], 1), ("urea", [1, 2, 3], 1), ("sodium", [140, 130, 120], -1), ("crp", [1, 2, 3], 1), ("wbc", [1, 2, 3], 1), ("nlr", [1, 2, 3], 1)]
    p = None
    for a, v, valence in base:
        f = frame(spark, v, analyte=a, valence=valence)
        p = f if p is None else p.unionByName(f)
    obs = p.select("patient_id", "analyte", "day", F.when((F.col("analyte") == "inr") & (F.col("day") == 3), "CH").alias("printed_flag"))
    scores = spark.createDataFrame([(1, 1, 20.0), (1, 2, 30.0)], "patient_id long, day int, score double")
    got = {(r.rule, r.severity) for r in rules.all_findings(p, obs, scores).collect()}
    assert {("synthetic-failure", "high"), ("renal-cluster", "high"), ("infection-cluster", "moderate"), ("critical-flag", "critical"), ("meld-escalation", "high"), ("rising-run", "moderate")} <= got
    heard = {(r.rule, r.analyte) for r in rules.for_audience(rules.all_findings(p, obs, scores), "family").collect()}
    assert ("rising-run", "inr") in heard and ("rising-run", "wbc") not in heard and ("critical-flag", "inr") in heard
    assert rules.all_findings(p.limit(0), obs.limit(0), scores.limit(0)).select(rules.audience().alias("a")).count() == 0
