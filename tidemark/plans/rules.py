"""All rules over series as findings of one shape, and the audience they are for."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import BOTH, DOCTOR, FAILURE, INFECTION_MARKERS, LIVER_MARKERS, RENAL
from ..functions.words import valence_of
from ..operators import series as S
from . import views as V

SHAPE = ["rule", "severity", "patient_id", "analyte", "from_day", "to_day"]


def shaped(df: DataFrame, rule: str | None = None, **columns: Column) -> DataFrame:
    """``df`` in the shape of a finding; a missing analyte or day is null."""
    given = {"rule": F.lit(rule) if rule else F.col("rule"), "analyte": F.lit(None).cast("string"), "from_day": F.lit(None).cast("int"), "to_day": F.lit(None).cast("int")}
    given |= {c: F.col(c) for c in ("analyte", "from_day", "to_day") if c in df.columns} | columns
    return df.select(*[given.get(c, F.col(c)).alias(c) for c in SHAPE])


def jumps(points: DataFrame) -> DataFrame:
    return shaped(S.next_day_jumps(points), "delta-24h", from_day=F.col("p_day"), to_day=F.col("day"))


def criticals(obs: DataFrame) -> DataFrame:
    return shaped(S.critical_flags(obs), "critical-flag", from_day=F.col("flagged"), to_day=F.col("latest"))


def escalations(scores: DataFrame, least: float = 3.0, first_wins: bool = False) -> DataFrame:
    return shaped(S.score_escalation(scores, least, first_wins=first_wins).withColumn("severity", F.lit("high")), "meld-escalation", from_day=F.col("p_day"), to_day=F.col("day"))


def spanned(found: DataFrame, moves: DataFrame, members: Iterable[str], moving: bool = False) -> DataFrame:
    """Findings of patients with the days that their members' moves cover."""
    part = moves.filter(F.col("analyte").isin(list(members)))
    part = part.filter("dir <> 0") if moving else part
    return found.join(part.groupBy("patient_id").agg(F.min("first_day").alias("from_day"), F.max("last_day").alias("to_day")), "patient_id")


def failure(moves: DataFrame, wanted: dict[str, int] = FAILURE) -> DataFrame:
    return shaped(spanned(S.conjunction(moves, wanted), moves, wanted).withColumn("severity", F.lit("high")), "synthetic-failure")


def renal(moves: DataFrame, wanted: dict[str, int] = RENAL) -> DataFrame:
    return shaped(spanned(S.conjunction(moves, wanted), moves, wanted).withColumn("severity", F.lit("high")), "renal-cluster")


def infection(moves: DataFrame, members: list[str] = INFECTION_MARKERS) -> DataFrame:
    found = spanned(S.clusters(moves, members), moves, members, moving=True)
    return shaped(found.withColumn("rule", F.concat(F.lit("infection-"), F.col("rule"))))


def perfusion(moves: DataFrame, rising: str = "lactate") -> DataFrame:
    """A marker that rises in the window; high if it ends above its range."""
    above = F.when(F.col("last_value") > F.col("high"), "high").otherwise("moderate")
    return shaped(moves.filter((F.col("analyte") == rising) & (F.col("dir") > 0)).withColumn("severity", above), "perfusion", from_day=F.col("first_day"), to_day=F.col("last_day"))


def discordant(moves: DataFrame, one: list[str] = INFECTION_MARKERS, other: list[str] = LIVER_MARKERS, least: int = 2) -> DataFrame:
    """Two groups of markers that move against each other."""
    a = F.col("analyte")
    grouped = moves.withColumn("system", F.when(a.isin(list(one)), "one").when(a.isin(list(other)), "other"))
    return shaped(spanned(S.discordance(grouped, "one", "other", least), moves, [*one, *other]).withColumn("severity", F.lit("moderate")), "discordance")


def low_oxygen(points: DataFrame, low_of: str = "abg_po2") -> DataFrame:
    """A marker whose last value, of however old a day, is below its range."""
    last = points.filter(F.col("analyte") == low_of).groupBy(*S.KEYS).agg(F.max_by(F.struct("value", "low"), "day").alias("p"), F.max("day").alias("from_day"))
    return shaped(last.filter("p.value < p.low").withColumns({"severity": F.lit("moderate"), "to_day": F.col("from_day")}), "low-oxygen")


#: Rules over moves of the last days; a caller may add its own.
MOVE_RULES: list[Callable[[DataFrame], DataFrame]] = [failure, renal, infection, perfusion, discordant]
#: Rules over all points.
POINT_RULES: list[Callable[[DataFrame], DataFrame]] = [low_oxygen]


def series_findings(points: DataFrame, obs: DataFrame) -> DataFrame:
    """Findings of runs, crossings, jumps and critical flags."""
    return shaped(V.findings(points)).unionByName(jumps(points)).unionByName(criticals(obs))


def all_findings(points: DataFrame, obs: DataFrame, scores: DataFrame, move_rules: list[Callable[[DataFrame], DataFrame]] | None = None, point_rules: list[Callable[[DataFrame], DataFrame]] | None = None, least: float = 3.0, first_wins: bool = False) -> DataFrame:
    """Findings of every rule; ``scores`` is ``patient_id, day, score`` of complete scores.

    Of equal rises of a score the finding is the latest, or the first.
    """
    out = series_findings(points, obs).unionByName(escalations(scores, least, first_wins))
    moves = S.trends(points)
    for rule in MOVE_RULES if move_rules is None else move_rules:
        out = out.unionByName(rule(moves))
    for rule in POINT_RULES if point_rules is None else point_rules:
        out = out.unionByName(rule(points))
    return out


#: Rules whose finding says whether a move is good or bad.
JUDGED = ("rising-run", "falling-run", "delta-24h")


def audience(valence: Column | None = None) -> Column:
    """Whom a finding is for: all of them for the doctor, and for the family those but discordance and moves of analytes that have no good direction.

    ``valence`` is the analyte's, by default that of the fixed lists.
    """
    way = valence_of(F.col("analyte")) if valence is None else valence
    alone = (F.col("rule") == "discordance") | (F.col("rule").isin(*JUDGED) & way.isNull())
    return F.when(alone, F.array(*[F.lit(w) for w in DOCTOR])).otherwise(F.array(*[F.lit(w) for w in BOTH]))


def for_audience(found: DataFrame, who: str, valence: Column | None = None) -> DataFrame:
    """The findings that are for somebody (FLT-9)."""
    return found.filter(F.array_contains(audience(valence), who))
