"""The batch operators that have a streaming form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_of_day(stream: DataFrame, late: str | None = "2 days") -> DataFrame:
    """Last reading per patient, analyte and day of a stream of ``patient_id, analyte, collected, value, seq``.

    Days are closed once the watermark has passed them; later readings are dropped.  With
    ``late`` None the stream has a watermark already.
    """
    day = F.window("collected", "1 day")
    best = F.max_by(F.struct("value", "collected", "seq"), F.struct("collected", "seq"))
    g = (stream.withWatermark("collected", late) if late else stream).groupBy("patient_id", "analyte", day).agg(best.alias("o"))
    return g.select("patient_id", "analyte", F.to_date("window.start").alias("date"), "o.value", "o.collected", "o.seq")


def without_repeats(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """A stream without repeated readings that arrive within the lateness."""
    return stream.withWatermark("collected", late).dropDuplicatesWithinWatermark(["patient_id", "analyte", "seq"])


def run_states(stream: DataFrame) -> DataFrame:
    """Per series the direction and length of the run that the latest points are in, updated as points arrive."""
    from collections.abc import Iterator

    import pandas as pd

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, direction, points = state.get if state.exists else (None, 0, 0)
        for f in frames:
            for value in f.sort_values(["collected", "seq"])["value"]:
                if last is None:
                    points = 1
                else:
                    base = abs(last) or 1.0
                    now = 0 if abs(value - last) < 0.03 * base else (1 if value > last else -1)
                    points = points + 1 if now and now == direction else (2 if now else 1)
                    direction = now
                last = float(value)
        state.update((last, direction, points))
        yield pd.DataFrame({"patient_id": [key[0]], "analyte": [key[1]], "direction": [direction], "points": [points]})

    return stream.groupBy("patient_id", "analyte").applyInPandasWithState(step, "patient_id long, analyte string, direction int, points int", "last double, direction int, points int", "update", "NoTimeout")
