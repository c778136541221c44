"""Equal rises of a score: which one the operator and the queries report."""

from datetime import datetime
from pathlib import Path

import pytest

from tests.oracle import TABLES, differences
from tidemark import queries_series as Q
from tidemark.operators import series as S

#: Values of one analyte by day; each patient has its largest rise several times.
TIED = {1: {1: 0, 2: 200, 5: 0, 6: 200, 9: 0, 10: 200}, 2: {3: 10, 4: 10, 5: 150}, 3: {1: 20, 2: 180, 3: 180}, 4: {1: 0, 2: 50, 3: 150, 4: 200}}


@pytest.fixture
def tied(spark, tmp_path):
    """The smallest tables, with events in which rises of scores are equal."""
    for t in TABLES:
        if t != "events":
            Path(tmp_path, f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    rows = [(k, datetime(2024, 1, d, 12), p, "view", float(v), '{"k": 1}') for k, (p, d, v) in enumerate((p, d, v) for p, at in TIED.items() for d, v in at.items())]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_all_findings_of_equal_rises(spark, tied):
    assert differences(Q.all_findings(spark, tied), Q.ORACLE["all_findings"], tied) == []
    got = Q.all_findings(spark, tied).filter("rule = 'meld-escalation'").collect()
    assert {(r.patient_id, r.from_day, r.to_day) for r in got} == {(1, 1, 2), (2, 3, 5), (3, 1, 3), (4, 1, 3)}


def test_timeline_of_equal_rises(spark, tied):
    assert differences(Q.all_findings_timeline(spark, tied), Q.ORACLE["all_findings_timeline"], tied) == []


def test_escalation_of_equal_rises(spark, tied):
    assert differences(Q.score_escalation(spark, tied), Q.ORACLE["score_escalation"], tied) == []


def test_escalation_first_or_latest(spark):
    s = spark.createDataFrame([(p, d, float(v)) for p, at in TIED.items() for d, v in at.items()] + [(None, 1, 0.0), (None, 2, 500.0)], "patient_id long, day int, score double")
    of = lambda **k: {(r.patient_id, r.p_day, r.day, r.rise) for r in S.score_escalation(s, 100.0, **k).collect()}
    assert of(first_wins=True) == {(1, 1, 2, 200.0), (2, 3, 5, 140.0), (3, 1, 3, 160.0), (4, 1, 3, 150.0)}
    assert of() == {(1, 9, 10, 200.0), (2, 4, 5, 140.0), (3, 1, 3, 160.0), (4, 2, 4, 150.0)}


def test_escalation_of_scores_too_large_to_tell_apart(spark):
    s = spark.createDataFrame([(1, 1, 0.75), (1, 2, 0.5), (1, 3, 2.0**55)], "patient_id long, day int, score double")
    assert [(r.p_day, r.p_score) for r in S.score_escalation(s, 100.0, first_wins=True).collect()] == [(1, 0.75)]
    assert [(r.p_day, r.p_score) for r in S.score_escalation(s, 100.0).collect()] == [(2, 0.5)]
