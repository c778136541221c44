"""Nearest neighbours by a block matrix join with quantised tiles.

Queries and candidates are dealt into blocks by a hash of their ids, and each pair of a
query block and a candidate block is one task's tile.  Within a tile both sides are
quantised to signed bytes with one scale a vector.  The tile of code products gives each
inner product up to an error that is bounded by the vectors' norms and the norms of what
quantisation left over (Cauchy-Schwarz).  A candidate survives if its upper bound reaches
the k-th largest lower bound of its query; survivors are computed again from the original
numbers in double precision.  Each tile sends at most k rows per query, and heaps merge
the tiles' sorted lists.

So results are exact; the codes only save work.  Blocks have a fixed number of rows, so a
tile's memory doesn't depend on the input.  Equal vectors in a block are looked at once:
of their ids only the k + 1 smallest can matter.  The vectors of one block travel once
per block of the other side.

Defined results: vectors that are null, zero, empty or hold null, NaN or infinite
components take no part, and neither do rows without an id; vectors of different lengths
are not compared; an id in several rows counts once per query, with its best score;
products beyond the largest double are infinite, and those of infinite terms of both signs count as
negative infinity.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import runs_of, schema, small_batches

QUERY_ROWS = 2_048
CANDIDATE_ROWS = 32_768
MOST_PARTITIONS = 20_000
#: Queries of a tile that are multiplied at a time.
STRIPE = 128


def usable(rows: DataFrame, id_name: str, vector_name: str) -> DataFrame:
    """Rows of ``vec_id, v, dim`` whose vectors take part."""
    v = F.col("v")
    good = F.size(v) > 0
    good &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    good &= F.exists(v, lambda x: x != 0)
    # Single precision travels as it is; tiles widen it.
    kind = "array<float>" if rows.schema[vector_name].dataType.simpleString() == "array<float>" else "array<double>"
    named = rows.select(F.col(id_name).cast("long").alias("vec_id"), F.col(vector_name).cast(kind).alias("v"))
    return named.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(good).withColumn("dim", F.size("v"))


def quantise(m):
    """Codes in -127..127 (as floats, so that products are exact sums in BLAS), scales, norms and left-over norms."""
    import numpy as np

    scale = np.abs(m).max(axis=1) / 127
    codes = np.rint(m / scale[:, None]).astype(np.int8)
    shown = codes * scale[:, None]
    return codes, scale, np.sqrt((shown * shown).sum(axis=1)), np.sqrt((m * m).sum(axis=1)), np.sqrt(((m - shown) ** 2).sum(axis=1))


def distinct_vectors(ids, m):
    """Distinct vectors, and for each its sorted ids."""
    import numpy as np

    m = m + 0.0  # one zero
    view = np.ascontiguousarray(m).view(np.dtype((np.void, m.dtype.itemsize * m.shape[1]))).ravel()
    _, first, group = np.unique(view, return_index=True, return_inverse=True)
    order = np.lexsort((ids, group))
    edges = np.searchsorted(group[order], np.arange(len(first) + 1))
    sorted_ids = ids[order]
    return m[first], [np.unique(sorted_ids[a:b]) for a, b in zip(edges, edges[1:])]


def best_of_tile(q_ids, q, c_ids, c, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """For each query id of a tile its nearest candidates, as sorted (-score, id)."""
    import numpy as np

    with np.errstate(over="ignore", invalid="ignore"):
        yield from _best_of_tile(q_ids, q, c_ids, c, k)


def _best_of_tile(q_ids, q, c_ids, c, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    import numpy as np

    c, groups = distinct_vectors(c_ids, c)
    repeated = len(set(c_ids.tolist())) < sum(map(len, groups))  # one id with several vectors
    c_codes, c_scale, c_shown, c_norm, c_left = quantise(c)
    kind = np.float32 if c.shape[1] <= 1024 else np.float64  # sums of products of codes stay below 2**24
    turned = c_codes.T.astype(kind)
    found: dict[int, list] = {}
    for at in range(0, len(q), STRIPE):
        part = q[at : at + STRIPE]
        codes, scale, _, norm, left = quantise(part)
        product = codes.astype(kind) @ turned
        # <q, c> = <q', c'> + <q', c - c'> + <q - q', c>, primes for what the codes show
        shown = np.sqrt(((codes * scale[:, None]) ** 2).sum(axis=1))
        for j in range(len(part)):
            own = int(q_ids[at + j])
            middle = product[j] * (scale[j] * c_scale)
            error = (shown[j] * c_left + left[j] * c_norm) * (1 + 1e-9) + 1e-12 * norm[j] * c_norm
            need = min(len(middle), 2 * k + 2 if repeated else k + 1)  # one place for the query's own vector
            low = middle - error
            limit = np.partition(low, len(low) - need)[len(low) - need]
            # Bounds of products beyond the largest double tell nothing.
            bounded = not repeated and bool(np.isfinite(error + np.abs(middle)).all())
            keep = np.flatnonzero(middle + error >= limit) if bounded else np.arange(len(middle))
            exact = np.add.accumulate(c[keep] * part[j], axis=1)[:, -1]  # one fixed order of summation
            exact = np.where(np.isnan(exact), -np.inf, exact)
            best: dict[int, float] = {}
            for g in np.argsort(-exact, kind="stable"):
                score = float(exact[g])
                if not repeated and len(best) >= k and -score > -min_score:
                    break
                ids = groups[keep[g]]
                for i in ids if repeated else ids[: k + 1]:
                    i = int(i)
                    if i != own and (i not in best or best[i] < score):
                        best[i] = score
                if not repeated and len(best) >= k:
                    min_score = score
            mine = heapq.nsmallest(k, ((-s, i) for i, s in best.items()))
            if own in found:  # the same id in several rows
                both: dict[int, float] = {}
                for s, i in [*found[own], *mine]:
                    both[i] = min(s, both.get(i, s))
                mine = heapq.nsmallest(k, ((s, i) for i, s in both.items()))
            found[own] = mine
    yield from found.items()


def blocks(n: int, rows: int) -> int:
    return max(1, -(-n // rows))


def nearest(vectors: DataFrame, is_query: Column, k: int, id_name: str = "vec_id", vector_name: str = "embedding", query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """Rows of ``query_id, rank, vec_id, score``: the ``k`` largest inner products of each query.

    ``is_query`` is a condition on ``vec_id``.  Nearest first, ties to the smaller id.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    good = usable(vectors, id_name, vector_name)
    counts = good.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    n_c, n_q = blocks(counts["n"], candidate_rows), blocks(counts["q"], query_rows)
    # Small inputs are spread over all cores too.
    n_c = max(n_c, min(spark.sparkContext.defaultParallelism, blocks(counts["n"], 512)))

    def to_tile(side: str, own: int, other: int) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id", F.lit(side)), F.lit(own))
        each = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        rows = good.filter(is_query) if side == "q" else good
        rows = rows.select("vec_id", "v", "dim", block.alias("own"), each.alias("other"))
        qb, cb = ("own", "other") if side == "q" else ("other", "own")
        tile = F.format_string("%d:%d:%d", F.col("dim"), F.col(qb).cast("int"), F.col(cb).cast("int"))
        return rows.select(tile.alias("tile"), F.lit(side).alias("side"), "vec_id", "v")

    sides = to_tile("q", n_q, n_c).unionByName(to_tile("c", n_c, n_q))
    # A partition may get many tiles; they are worked through one at a time.
    dealt = sides.repartition(min(n_q * n_c, MOST_PARTITIONS), "tile").sortWithinPartitions("tile", "side")

    def tiles(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for run in runs_of(frames, "tile"):
            query = (run["side"] == "q").to_numpy()
            if not query.any() or query.all():
                continue
            m = np.stack(run["v"].to_numpy()).astype(np.float64)
            ids = run["vec_id"].to_numpy()
            out = [(q, [i for _, i in best], [-s for s, _ in best]) for q, best in best_of_tile(ids[query], m[query], ids[~query], m[~query], k)]
            yield pd.DataFrame(out, columns=["query_id", "ids", "scores"])

    lists = dealt.mapInPandas(tiles, schema(query_id="long", ids="array<long>", scores="array<double>"))

    def merge(frames: Iterator) -> Iterator:
        import pandas as pd

        for run in runs_of(frames, "query_id"):
            merged, seen, out = heapq.merge(*[[(-s, i) for s, i in zip(a, b)] for a, b in zip(run["scores"], run["ids"])]), set(), []
            for s, i in islice(((s, i) for s, i in merged if not (i in seen or seen.add(i))), k):
                out.append((run["query_id"].iloc[0], len(out) + 1, i, -s))
            yield pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])

    return lists.repartition("query_id").sortWithinPartitions("query_id").mapInPandas(merge, schema(query_id="long", rank="int", vec_id="long", score="double"))


ORACLE = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT * FROM (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM pairs)
WHERE rank <= 20
"""
