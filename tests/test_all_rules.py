"""All ten rules in the ranking, timeline and counts."""

from tidemark import queries_series as Q
from tidemark.plans import rules

from .test_series import frame


def test_critical_and_every_rule(spark, sf_dir):
    got = {r.rule for r in Q.all_findings(spark, sf_dir).select("rule").distinct().collect()}
    assert {"rising-run", "falling-run", "range-exit", "range-return", "delta-24h", "critical-flag", "meld-escalation", "perfusion", "low-oxygen"} <= got
    assert {r.severity for r in Q.all_severity_counts(spark, sf_dir).collect()} == {"critical", "high", "moderate", "info"}
    assert Q.all_findings_ranked(spark, sf_dir).orderBy("place").first().severity == "critical"
    assert Q.all_findings_timeline(spark, sf_dir).filter("severity = 'critical'").count() > 0


def test_perfusion_oxygen_discordance(spark):
    p = None
    for a, v, valence, low, high in [("lactate", [1, 2, 4], 1, 0.5, 3.0), ("abg_po2", [70], -1, 80.0, None), ("crp", [3, 2, 1], 1, None, None), ("wbc", [3, 2, 1], 1, None, None), ("inr", [1, 2, 3], 1, None, None), ("albumin", [3, 2, 1], -1, None, None)]:
        f = frame(spark, v, low, high, valence, a)
        p = f if p is None else p.unionByName(f)
    obs = p.selectExpr("patient_id", "analyte", "day", "null as printed_flag").limit(0)
    scores = p.selectExpr("patient_id", "day", "value as score").limit(0)
    got = {(r.rule, r.severity, r.from_day, r.to_day) for r in rules.all_findings(p, obs, scores).collect()}
    assert {("perfusion", "high", 1, 3), ("low-oxygen", "moderate", 1, 1), ("discordance", "moderate", 1, 3)} <= got
