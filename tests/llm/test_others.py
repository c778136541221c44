"""Neighbours, archives, extraction, near copies and the pipeline."""

import base64
import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.brute import plain_copies
from tidemark.llm import archives, copies, extraction, neighbours, queries
from tidemark.llm.common import cut, table

# --- neighbours ---


def plain_nearest(rows, k, is_query):
    good = []
    for i, v in rows:
        if i is None or not v or any(x is None or x != x or abs(x) == float("inf") for x in v) or not any(v):
            continue
        good.append((i, v))
    out = {}
    for q, a in good:
        if is_query(q):
            best = out.setdefault(q, {})
            for c, b in good:
                if c != q and len(a) == len(b):
                    s = 0.0
                    for x, y in zip(a, b):
                        s += x * y
                    best[c] = max(s, best.get(c, float("-inf")))
    return {(q, n + 1, c, s) for q, best in out.items() for n, (s, c) in enumerate(sorted(((s, c) for c, s in best.items()), key=lambda x: (-x[0], x[1]))[:k])}


@pytest.mark.parametrize("repeat", [False, True])
def test_neighbours_plain(spark, repeat):
    rng = random.Random(9)
    v = lambda: [rng.randrange(-3, 4) / 2 for _ in range(8)]
    rows = [(i, v()) for i in range(300)] + [(i, [1.0] * 8) for i in range(300, 500)]
    rows += [(600, None), (601, []), (602, [0.0] * 8), (603, [1.0, None] * 4), (604, [float("nan")] * 8), (605, [float("inf")] * 8), (None, v()), (620, [1.0, 2.0]), (640, [2.0, 1.0])]
    rows.append(rows[20])
    if repeat:
        rows += [(20, v()), (21, v()), (20, v())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as rank")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20, query_rows=9, candidate_rows=64)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == plain_nearest(rows, 20, lambda i: i % 20 == 0)
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


# --- archives ---


def pages_frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as archive", "1 as refers_to")


def test_archives_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, f"http://h/{i}?q=é x\r\ny", "<p>" + " ".join(rng.choice(["a", "bé", "ccc"]) for _ in range(rng.randrange(300)))) for i in range(300)]
    rows += [(1000 + i, None, "same") for i in range(40)] + [(2000, "u", None), (2001, "u", ""), (3000, "u", "long " * 400_000), (None, None, "same"), (7, "again", rows[7][2])]
    df = pages_frame(spark, rows)
    made = cut(archives.write_archives(df), "test")
    back = archives.read_archives(made).collect()
    assert len(back) == len(rows) and not any(r.error for r in back)
    want = {h or "" for _, _, h in rows}
    assert {bytes(r.payload).decode() for r in back if r.record_type == "response"} == want
    keeper = {}
    for i, _, h in rows:
        if i is not None:
            keeper[h or ""] = max(i, keeper.get(h or "", i))
    expected = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        k = keeper[h or ""]
        expected[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == k else "revisit", None if i == k else k] += 1
    assert Counter(map(tuple, archives.archive_report(df).collect())) == expected
    assert archives.archive_report(df.limit(0)).count() == 0


def test_archives_files_and_damage(spark, tmp_path):
    df = pages_frame(spark, [(i, "u", f"text {i} " * 50) for i in range(60)])
    made = archives.write_archives(df).coalesce(1)
    archives.save_files(made, str(tmp_path))
    files = archives.archives_from_files(spark, str(tmp_path))
    assert archives.read_archives(files).count() == 60
    content = bytes(made.first()["content"])
    records = list(archives.records_of(content))
    assert int.from_bytes(content[:4], "little") == archives.DICTIONARY_MAGIC and len(records) >= 1
    raw = archives.record(5, "u", b"abc", archives.base32_sha1(b"abc"), None, "2020-01-01T00:00:00Z")
    assert archives.parse_record(raw)["payload"] == b"abc"
    for bad in (raw[:-1], raw.replace(b"abc", b"abd"), raw.replace(b"WARC/1.1", b"WARX/1.1"), re.sub(rb"Content-Length: \d+\r\nWARC", b"WARC", raw, count=1).replace(b"WARC-Date: 2020-01-01T00:00:00Z\r\n", b""), raw + b"x"):
        with pytest.raises(archives.Damaged):
            archives.parse_record(bad)
    for broken in (content[:-3], content[: records[0][0] + 4] + content[records[0][0] + 40 :], content[:6]):
        with pytest.raises(archives.Damaged):
            list(archives.records_of(broken))
    loose = archives.read_archives(spark.createDataFrame([("x", bytearray(content[:-3]))], "archive string, content binary"), strict=False).collect()
    assert loose[-1].error and len(loose) == len(records)


# --- extraction ---


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("plain  text\n\tonly", "plain text only"),
        ("<article><h1>A &amp; B</h1><p>One<br>two<p>Three &lt;b&gt; </article><footer>no</footer>", "A & B\n\nOne two\n\nThree <b>"),
        ("<nav>menu</nav><main><p>Body</p></main><aside>side</aside><script>var x='<p>no</p>'</script><style>p{}</style>", "Body"),
        ("<div class='cookie-notice'>take them</div><div id=main><p>First long paragraph, with commas, enough of it.</p><p>Second long paragraph, with commas, enough.</p></div><div class=comments><p>A comment, which is long, and full, of commas, really.</p></div>", "First long paragraph, with commas, enough of it.\n\nSecond long paragraph, with commas, enough."),
        ("<article><p><b>Bold<p>Next</b> one</article>", "Bold\n\nNext one"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\n\nb\n\nc\n\nd"),
        ("<article><p>x</p><form><input value=1>f</form><div hidden>h</div><div class=ad>ad</div></article>", "x"),
        ("<p>a < b && c</p>", "a < b && c"),
        ("<article><p title='a>b'>in</p><!-- <p>not</p> --></article>", "in"),
    ],
)
def test_extraction(page, text):
    assert extraction.main_text(page) == text


def test_extraction_odd_pages(spark):
    rng = random.Random(3)
    for _ in range(500):
        extraction.main_text("".join(rng.choice(["<p>", "</p>", "<div class='", "'>", "<b", ">", "x, y ", "</b>", "<td>", "</table>", "&amp", "<!--", "<script>", "\"", "<article>", "</div>"]) for _ in range(rng.randrange(40))))
    deep = "<div>" * 30_000 + "<p>" + "word, " * 100 + "</p>"
    assert extraction.main_text(deep).startswith("word, word")
    rows = [(1, None, None), (2, "u", "<p>t</p>"), (2, "u", "<p>t</p>"), (None, "u", "<article>" + "<p>long text here</p>" * 5000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = extraction.extract(df).collect()
    assert Counter((r.page_id, r.n_chars) for r in got) == Counter([(1, 0), (2, 1), (2, 1), (None, 5000 * 16 - 2)])
    assert extraction.extract(df.limit(0)).count() == 0


# --- near copies ---


def rows_with_copies(rng, n, bases=6):
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randrange(30, 120))] for _ in range(bases)]
    rows = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    return rows


def test_copies_plain(spark):
    rng = random.Random(11)
    rows = rows_with_copies(rng, 220) + [(1000, None), (1001, ""), (1002, "two words"), (1003, "Two, words!"), (1004, " \n"), (1005, "z " * 40_000), (None, "two words"), (None, "lonely text of no one else at all"), (5, "lonely text of no one else at all")]
    rows.append(rows[3])
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as class_id", "2 as n_links", "3 as size")
    want = plain_copies(rows)
    got = Counter(tuple(r) for r in copies.near_copies(docs, recall=0.999999).collect())
    assert got == Counter((rows[i][0], *v) for i, v in want.items())
    assert copies.near_copies(docs.limit(0)).count() == 0
    kept = copies.keep_one(docs)
    assert kept.columns == docs.columns


def test_copies_large_group_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(copies, "TILE", 16)
    monkeypatch.setattr(copies, "SMALL", 8)
    rows = rows_with_copies(random.Random(12), 150, bases=1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_copies(rows)
    got = {r.doc_id: (r.class_id, r.n_links, r.exact_id, r.n_copies) for r in copies.near_copies(docs, recall=0.999999).collect()}
    assert got == {rows[i][0]: v for i, v in want.items()}


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"n{a:04d}", f"n{a + 1:04d}") for a in range(200)] + [(f"m{rng.randrange(60):03d}", f"m{rng.randrange(60):03d}") for _ in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.root for r in copies.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {x: root(x) for x in list(parent)}


# --- pipeline ---


def test_pipeline_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = cut(stage(spark, docs, sf_dir), "stage")
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == table(spark, sf_dir, "documents").columns
        if k == 2:
            ids = [r.doc_id for r in docs.select("doc_id").collect()]
            assert len(ids) == len(set(ids))
            again = copies.near_copies(docs).filter("n_links > 0").count()
            assert again == 0
    assert n * 0.6 < counts[0] <= n and counts[1] == counts[0] and counts[2] <= counts[1] and counts[4] == counts[3] > 0
    assert corpus_pipeline.run(spark, sf_dir).count() == counts[-1]


def test_pipeline_odd_rows(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, text_lines array<int>, kept boolean, at timestamp"
    good = " ".join(f"w{i}" for i in range(70))
    rows = [(1, None, None, None, None, None, None, None), (2, good, "en", None, 3, [1], True, None), (2, good, "en", None, 3, [1], True, None), (None, good + " x", None, "s", None, None, None, None), (4, "", "en", "s", 0, [], None, None)]
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 1
    empty = tmp_path / "empty"
    spark.createDataFrame([], kinds).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_registry():
    import __spark_entry__ as e

    names = list(e.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
