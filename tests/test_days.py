"""Matrices of more than a month."""

from tidemark.plans import views as V

from .test_series import frame


def test_days_outside_a_month(spark):
    p = frame(spark, [5, *[None] * 39, 30], 1.0, 10.0, start=-2)
    assert {(r.day, r.value) for r in V.by_day(p).collect()} == {(-2, 5.0), (38, 30.0)}
    assert {(r.day, r.fold) for r in V.by_day(V.heat_folds(p), "fold").collect()} == {(-2, 1.0), (38, 3.0)}
