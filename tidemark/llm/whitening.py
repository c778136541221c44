"""Whitening of embeddings by aggregates of all pairs of dimensions.

Entries become whole numbers, ``floor(1024 * c) + 100000``.  One aggregation sums the
dimensions, a second one has a generated SQL expression for the centred product of every
pair of dimensions of the upper triangle.  The covariance that they make is decomposed on
the driver (LAPACK), where only one number for each pair of dimensions comes; rows are
then projected with expressions again.  Vectors of more dimensions than ``AT_ONCE`` pairs
allow take one aggregation for each ``AT_ONCE`` pairs.

The covariance of the projected rows is measured, too, and its largest distance from the
identity is given with every row.

Defined results: rows whose vector is null, empty or holds null, NaN or infinite entries, or
entries of 2^42 or more (their whole numbers would have gaps), take no part, and neither do vectors
of another length than the most frequent one (the longer of equally frequent ones); rows
without an id and repeated rows take part; components whose eigenvalue is 0 to double
precision are left out, so fewer may follow, and none if all rows are equal; where the exact
``deviation`` doesn't fit a long it is null; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations_with_replacement, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Pairs of dimensions in one aggregation.
AT_ONCE = 4_096
#: Entries from here on lose their last places as doubles times ``SCALE``.
TOO_LARGE = float(2**42)
KIND = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(rows: DataFrame, id_name: str, vector_name: str) -> DataFrame:
    """Rows of ``vec_id, x, d``: the whole numbers of vectors that take part, and how many."""
    named = rows.select(F.col(id_name).alias("vec_id"), F.col(vector_name).cast("array<double>").alias("v"))
    good = F.forall("v", lambda c: F.coalesce(F.abs(c) < TOO_LARGE, F.lit(False)))  # NaN is larger than all
    taken = named.filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(good)
    return taken.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"), F.size("v").alias("d"))


def sums(rows: DataFrame, d: int) -> tuple[int, int, int, list[int]]:
    """The number of rows, the least and the largest entry, and the exact sum of each dimension."""
    found = rows.agg(F.count("*"), F.min(F.array_min("x")), F.max(F.array_max("x")), *[F.expr(f"sum(cast(x[{i}] as decimal(18, 0)))") for i in range(d)]).first()
    return found[0], found[1], found[2], [int(s) for s in found[3:]]


def deviation(n: int, least: int, largest: int, total: list[int]) -> str:
    """SQL for the sum over dimensions of ``(n * x - sum)`` squared, null where it doesn't fit a long."""
    if fits(n, least, largest, len(total)):
        return " + ".join(f"({n}L * x[{i}] - {s}L) * ({n}L * x[{i}] - {s}L)" for i, s in enumerate(total))
    gaps = [f"try_cast(cast(x[{i}] as decimal(18, 0)) * cast({n} as decimal(18, 0)) - cast({s} as decimal(38, 0)) as bigint)" for i, s in enumerate(total)]
    parts = [f"try_multiply({g}, {g})" for g in gaps]
    while len(parts) > 1:
        parts = [f"try_add({parts[k]}, {parts[k + 1]})" if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def fits(n: int, least: int, largest: int, d: int) -> bool:
    """Whether no step of a deviation can overflow a long."""
    return n * max(abs(least), abs(largest)) < 2**62 and (n * (largest - least)) ** 2 * d < 2**63


def centred(rows: DataFrame, means: list[float]) -> DataFrame:
    """``vec_id, x`` and columns ``c0, c1, ...`` with the differences from the means."""
    return rows.selectExpr("vec_id", "x", *[f"x[{i}] - double('{m!r}') as c{i}" for i, m in enumerate(means)])


def covariance(rows: DataFrame, n: int, d: int, at_once: int = AT_ONCE):
    """The covariance of ``c0, c1, ...``, whose means are 0."""
    import numpy as np

    out = np.zeros((d, d))
    pairs = combinations_with_replacement(range(d), 2)
    while part := list(islice(pairs, at_once)):
        found = rows.selectExpr(*[f"sum(c{i} * c{j})" for i, j in part]).first()
        for (i, j), s in zip(part, found):
            out[i, j] = out[j, i] = s / n
    return out


def components(v, most: int):
    """Eigenvalues, falling, unit eigenvectors as rows, and shares of the trace, of a covariance."""
    import numpy as np

    values, vectors = np.linalg.eigh(v)
    trace = float(np.trace(v))
    keep = [k for k in range(len(v) - 1, -1, -1) if values[k] > len(v) * np.finfo(float).eps * trace][:most]
    return values[keep], vectors.T[keep], values[keep] / trace if trace > 0 else values[keep]


def whiten(rows: DataFrame, most: int = COMPONENTS, id_name: str = "vec_id", vector_name: str = "embedding") -> DataFrame:
    """Rows of ``vec_id, component, n, deviation, whitened, explained, identity_error``, one for each component."""
    spark = rows.sparkSession
    kind = rows.schema[id_name].dataType.simpleString()
    nothing = spark.createDataFrame([], KIND.replace("vec_id long", f"vec_id {kind}"))
    taken = whole(rows, id_name, vector_name)
    lengths = taken.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    if lengths is None:
        return nothing
    d = lengths["d"]
    taken = taken.filter(F.col("d") == d)
    n, least, largest, total = sums(taken, d)
    middle = centred(taken, [s / n for s in total])
    values, vectors, shares = components(covariance(middle, n, d), most)
    if not len(values):
        return nothing
    each = [[float(w) / float(e) ** 0.5 for w in v] for v, e in zip(vectors, values)]
    projected = middle.selectExpr("vec_id", "x", *[" + ".join(f"c{i} * double('{w!r}')" for i, w in enumerate(v)) + f" as w{k}" for k, v in enumerate(each)])
    pairs = list(combinations_with_replacement(range(len(each)), 2))
    found = projected.selectExpr(*[f"covar_pop(w{i}, w{j})" for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for (i, j), c in zip(pairs, found))
    shown = projected.selectExpr("vec_id", f"{n}L as n", f"{deviation(n, least, largest, total)} as deviation", "inline(array(" + ", ".join(f"struct({k + 1} as component, w{k} as whitened, double('{float(s)!r}') as explained)" for k, s in enumerate(shares)) + "))", f"double('{float(error)!r}') as identity_error")
    return shown.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
