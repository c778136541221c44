"""Near copies by a chosen-path join on word shingles.

All pairs of texts whose shingle sets have a Jaccard similarity of at least 0.8 are
found, up to a recall of ``RECALL`` for a pair just at the threshold; every pair that is
reported was compared exactly.

* Texts with equal shingle sets are one class; only one text of a class goes on.
* A run starts with all sets in one bucket.  Each set in a bucket samples one of its
  shingles by a hash that depends on the run and on the bucket's path, and sets that chose
  the same shingle share a bucket of the next level.  Two sets of similarity J stay
  together with probability J at each level.
* A bucket of at most ``SMALL`` sets is compared by brute force; larger ones are split
  again, down to ``DEPTH`` levels.  What is still large then is a group of near copies.
  It is compared in tiles of two blocks of at most ``TILE`` sets, so that no task holds a
  group; the work is spread evenly, but grows with the square of such a group.
* The number of runs follows from the recall, the threshold and the depth.
* A pair that meets in several buckets counts in the smallest bucket only.  Tiles send one
  row per set: how many documents it is linked to, and an edge to the first set of its
  linked component.  Pairs are never sent.
* Components come from edges by alternating star contractions, each written as a table.

Results per document: ``class_id``, the smallest document id of its component;
``n_links``, the number of other documents at or above the threshold; ``exact_id``, the
smallest id with an equal shingle set; ``n_copies``, the number of documents with it.

Defined results: texts without words link to nothing and are classes of their own;
repeated rows count as separate documents with equal sets; a class whose documents all
lack an id has null ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, cut, discard, map_rows, packed, runs_of, schema, small_batches, text_of, unpacked
from .shingles import WordHashes, mixed, shingle_set

THRESHOLD = (4, 5)
DEPTH = 3
SMALL = 64
TILE = 512
RECALL = 0.9999
COLUMNS_AT_ONCE = 8_192


def runs_for(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold was together on the last level at least once."""
    stay = (THRESHOLD[0] / THRESHOLD[1]) ** depth
    return math.ceil(math.log(1 - recall) / math.log(1 - stay))


def paths(shingles, runs: int):
    """Bucket ids of a set: one row per level, one column per run."""
    import numpy as np

    at = mixed(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    out = []
    for _ in range(DEPTH):
        least = at.copy()
        for r in range(runs):  # shingles are mixed already; a seeded multiplication orders them anew
            least[r] = ((shingles ^ at[r]) * (at[r] | np.uint64(1))).min()
        at = mixed(at * np.uint64(0xE7037ED1A0B428DB) + least)
        out.append(at.view(np.int64))
    return out


def keyed(docs: DataFrame, runs: int) -> DataFrame:
    """Per document a 128-bit digest of its shingle set, the number of shingles, and bucket ids by level."""
    small_batches(docs.sparkSession)

    def work(frames: Iterator) -> Iterator:
        import xxhash

        hashes = WordHashes()
        for f in frames:
            rows = []
            for text in f["text"]:
                s = shingle_set(text, hashes)
                if not len(s):
                    rows.append((0, 0, 0, None, None, None))
                    continue
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                rows.append(((d >> 64) - 2**63, (d & 2**64 - 1) - 2**63, len(s), *(p.tolist() for p in paths(s, runs))))
            names = ["d1", "d2", "n", "k1", "k2", "k3"]
            yield f[["doc_id", "mark"]].assign(**{c: list(v) for c, v in zip(names, zip(*rows) if rows else [[]] * 6)})

    text = text_of(docs)
    rows = docs.select("doc_id", F.xxhash64(text).alias("mark"), text.alias("text"))
    return map_rows(rows, work, ["doc_id"], mark="long", d1="long", d2="long", n="long", k1="array<long>", k2="array<long>", k3="array<long>")


def leaves(classes: DataFrame) -> DataFrame:
    """Rows of ``d1, d2, bucket, size``: sets in the buckets that are to be compared."""
    runs = F.explode(F.arrays_zip("k1", "k2", "k3")).alias("k")
    rows = classes.select("d1", "d2", runs).select("d1", "d2", "k.k1", "k.k2", "k.k3")
    out = None
    for level in range(1, DEPTH + 1):
        key = f"k{level}"
        # As a table of its own, so that a hot bucket's rows on the other side can be split over tasks.
        sizes = cut(rows.groupBy(key).agg(F.count("*").alias("size")).filter("size > 1"), f"copies-sizes{level}")
        shared = cut(rows.join(sizes, key), f"copies-level{level}")
        done = F.lit(True) if level == DEPTH else F.col("size") <= SMALL
        here = shared.filter(done).select("d1", "d2", F.col(key).alias("bucket"), "size")
        out = here if out is None else out.unionByName(here)
        rows = shared.filter(~done).drop("size")
    signs = out.groupBy("bucket").agg(F.bit_xor("d1").alias("x1"), F.bit_xor("d2").alias("x2"), F.bit_xor(F.xxhash64("d1", "d2")).alias("x3"), F.first("size").alias("size"))
    once = signs.groupBy("x1", "x2", "x3", "size").agg(F.min("bucket").alias("bucket")).select("bucket")
    return cut(out.join(once, "bucket"), "copies-buckets")


def overlaps(sets: list):
    """Matrix of the numbers of shared elements of sorted arrays without repeats."""
    import numpy as np

    b = len(sets)
    if b <= 4:
        out = np.zeros((b, b), dtype=np.int64)
        for i in range(b):
            out[i, i] = len(sets[i])
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    owner = np.repeat(np.arange(b), [len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    column = np.cumsum(shared) - 1
    keep = shared[inverse]
    owner, column = owner[keep], column[inverse[keep]]
    out = np.zeros((b, b), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = int(shared.sum())
    for at in range(0, total, COLUMNS_AT_ONCE):
        a, z = np.searchsorted(column, [at, at + COLUMNS_AT_ONCE])
        m = np.zeros((b, min(COLUMNS_AT_ONCE, total - at)), dtype=np.float32)
        m[owner[a:z], column[a:z] - at] = 1
        out += m @ m.T
    return out.astype(np.int64)


def compare(sets: list, blocks, copies, others: list, bucket: int):
    """Linked documents per set, and the first set of its linked component, for one tile.

    ``blocks`` tells the two blocks apart where a tile has two; ``others`` are the sets'
    buckets, for counting a pair only in its smallest one.
    """
    import numpy as np

    b = len(sets)
    sizes = np.array([len(s) for s in sets])
    same = overlaps(sets)
    up, down = THRESHOLD
    linked = (up + down) * same >= up * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(linked, False)
    if blocks is not None:
        linked &= blocks[:, None] != blocks[None, :]
    earlier = [np.array([x for x in o if x < bucket], dtype=np.int64) for o in others]
    if linked.any() and sum(map(len, earlier)):
        linked &= overlaps([np.sort(e) for e in earlier]) == 0
    links = (linked * copies[None, :]).sum(axis=1)
    label = np.arange(b)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], b).min(axis=1, initial=b))
        new = new[new]
        if (new == label).all():
            return links, label
        label = new


def tiles_of(rows: DataFrame) -> DataFrame:
    """Rows dealt to tiles: one tile for a small bucket, else one for every two blocks."""
    blocks = F.ceil(F.col("size") / TILE).cast("int")
    own = F.when(blocks > 1, F.pmod(F.xxhash64("d1", "d2"), blocks.cast("long")).cast("int")).otherwise(0)
    dealt = rows.withColumn("block", own).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tile = F.concat_ws(":", F.col("bucket").cast("string"), F.least("block", "with").cast("string"), F.greatest("block", "with").cast("string"))
    return dealt.withColumn("tile", tile).withColumn("two", F.col("block") != F.col("with"))


def with_texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Classes with one text each, that of their pick, however many rows repeat it."""
    text = text_of(docs)
    texts = docs.select(F.col("doc_id").alias("t_id"), F.xxhash64(text).alias("t_mark"), text.alias("text"))
    found = known.join(texts, F.col("pick.doc_id").eqNullSafe(F.col("t_id")) & (F.col("pick.mark") == F.col("t_mark")))
    # Rows that repeat a pick are one before they are sent on.
    return found.groupBy("d1", "d2").agg(F.first("copies").alias("copies"), F.first("buckets").alias("buckets"), F.min("text").alias("text"))


def linked_sets(docs: DataFrame, classes: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows of ``node, links, root`` from all tiles; nodes name classes by their digests."""
    lists = buckets.groupBy("d1", "d2").agg(F.collect_set("bucket").alias("buckets"))
    with_text = with_texts(docs, classes.select("d1", "d2", "copies", "pick").join(lists, ["d1", "d2"]))
    dealt = tiles_of(buckets).join(with_text, ["d1", "d2"]).select("tile", "bucket", "block", "two", "d1", "d2", "copies", "buckets", "text")

    def work(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        hashes = WordHashes()
        out: list = []
        for run in runs_of(frames, "tile"):
            run = run.sort_values(["d1", "d2"], kind="stable")
            names = [f"{a & 2**64 - 1:016x}{b & 2**64 - 1:016x}" for a, b in zip(run["d1"].tolist(), run["d2"].tolist())]
            sets = [shingle_set(t, hashes) for t in run["text"]]
            blocks = run["block"].to_numpy() if run["two"].any() else None
            links, label = compare(sets, blocks, run["copies"].to_numpy(), run["buckets"].tolist(), int(run["bucket"].iloc[0]))
            out += [(names[i], int(links[i]), names[label[i]]) for i in np.flatnonzero(links)]
            if len(out) > 5_000:
                yield pd.DataFrame(out, columns=["node", "links", "root"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["node", "links", "root"])

    return dealt.repartition("tile").sortWithinPartitions("tile").mapInPandas(work, schema(node="string", links="long", root="string"))


def components(edges: DataFrame) -> DataFrame:
    """Rows of ``node, root`` with the smallest node of each connected component.

    Large-star and small-star steps in turn; a node's neighbours are never gathered, only
    their minimum.  Nodes without edges don't appear.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "components")
    was = mark(e)
    while True:
        near = both(e)
        # As tables of their own, so that a hot root's rows on the other side can be split over tasks.
        least = cut(near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "components-least")
        large = cut(near.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "components")
        least2 = cut(large.groupBy("u").agg(F.min("v").alias("m")), "components-least")
        star = large.join(least2, "u")
        small = cut(star.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least2.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "components")
        for old in (e, least, large, least2):
            discard(old)
        e = small
        now = mark(e)
        if now == was:
            break
        was = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def facts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Per class of equal sets: ``d1, d2, exact_id, copies, pick, root, links``; equal roots are one group of near copies."""
    named = keys.filter("n > 0")
    pick = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark")
    classes = cut(named.groupBy("d1", "d2").agg(F.min("doc_id").alias("exact_id"), F.count("*").alias("copies"), F.min(pick).alias("pick"), *[F.first(k).alias(k) for k in ("k1", "k2", "k3")]), "copies-classes")
    found = cut(linked_sets(docs, classes, leaves(classes)), "copies-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    digits = [F.lpad(F.lower(F.hex(c)), 16, "0") for c in ("d1", "d2")]
    facts = classes.select("d1", "d2", "exact_id", "copies", "pick", F.concat(*digits).alias("node")).join(links, "node", "left").join(groups, "node", "left")
    return facts.withColumn("root", F.coalesce("root", "node"))


def near_copies(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """Rows of ``doc_id, class_id, n_links, exact_id, n_copies`` for every document."""
    docs = docs.select("doc_id", "text")
    keys = cut(keyed(docs, runs_for(recall)), "copies-keys")
    facts = cut(facts_of(docs, keys), "copies-groups")
    # As a table of its own, so that a large group's rows on the other side can be split over tasks.
    first = cut(facts.groupBy("root").agg(F.min("exact_id").alias("class_id")), "copies-first")
    facts = cut(facts.join(first, "root").select("d1", "d2", "exact_id", "copies", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "copies-facts")
    joined = keys.select("doc_id", "d1", "d2", "n").join(facts, ["d1", "d2"], "left")
    alone = F.col("n") == 0
    return joined.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("doc_id")).otherwise(F.col("exact_id")).alias("exact_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"))


def keep_one(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """``docs``, all columns, with one row of each group of near copies: the smallest id, then the smallest hash of the text.

    Rows without an id come last in their group.  Rows that repeat an id with texts that are no copies all stay.  Texts without
    words are no copies; of rows that repeat such a text with an id one stays.
    """
    texts = docs.select("doc_id", "text")
    keys = cut(keyed(texts, runs_for(recall)), "copies-keys")
    facts = facts_of(texts, keys)
    chosen = facts.groupBy("root").agg(F.min("pick").alias("pick")).select(F.col("pick.doc_id").alias("tm_id"), F.col("pick.mark").alias("tm_is")).distinct()
    own = packed(docs, "doc_id", "text")
    text = text_of(own)
    marked = own.withColumns({"tm_mark": F.xxhash64(text), "tm_blank": F.coalesce(F.btrim(text, F.lit(SPACE_CHARS)) == "", F.lit(True))})
    kept = marked.filter("not tm_blank").join(chosen, F.col("doc_id").eqNullSafe(F.col("tm_id")) & (F.col("tm_mark") == F.col("tm_is")), "left_semi")
    one = kept.unionByName(marked.filter("tm_blank and doc_id is not null"))
    ordered = [F.col(f"tm_rest.c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text") and "map<" not in docs.schema[i].dataType.simpleString()]
    # By partial sums and not by a window, so that a text that many rows repeat is no task of its own.
    one = one.groupBy("doc_id", "tm_mark", "text").agg(F.min_by("tm_rest", F.struct(F.lit(0), *ordered)).alias("tm_rest"))
    back = unpacked(docs.columns, "doc_id", "text")
    return one.select(*back).unionByName(marked.filter("tm_blank and doc_id is null").select(*back))
