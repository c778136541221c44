"""Stages keep extra columns whatever they are called; repeated ids count once; training samples are bounded."""

from pyspark.sql import functions as F

from tidemark.llm import copies, language, lines, mixing, quality

NAMES = "tm_id tm_mark tm_lost tm_n_lines tm_n_dropped tm_size tm_source tm_turn tm_turns tm_row tm_rest tm_none tm_blank tm_is tm_key tm_bucket tm_rank tm_total tm_target tm_run none c0 c2 h b mark place lost pick root".split()
ODD = "a.b`c"


def frame(spark):
    rows = [(i, f"shared line of many documents\n{' '.join(f'w{i}x{k}' for k in range(60))}", "en", "s" if i % 3 else None) for i in range(12)]
    rows += [(20, rows[0][1] + " end", "en", "s"), (None, rows[1][1], "en", "s"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = [F.lit(f"{n}!").alias(n) for n in NAMES] + [F.lit("odd").alias(ODD), F.create_map(F.lit(1), F.lit("m")).alias("as_map")]
    return docs.select(docs.columns), docs.select(extra[0], *docs.columns[:2], *extra[1:], *docs.columns[2:])


def check(plain, wide, columns):
    assert wide.columns[: len(columns)] == columns
    got = wide.collect()
    core = ["doc_id", "text", "lang", "source"]
    assert sorted(str(tuple(r[c] for c in core)) for r in got) == sorted(str(tuple(r[c] for c in core)) for r in plain.collect())
    for r in got:
        assert all(r[n] == f"{n}!" for n in NAMES) and r[ODD] == "odd" and r["as_map"] == {1: "m"}


def test_stages_keep_columns_of_any_name(spark):
    plain, wide = frame(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    check(lines.drop_repeated_lines(plain), lines.drop_repeated_lines(wide), wide.columns)
    assert lines.drop_repeated_lines(wide).columns[-2:] == ["tm_n_lines_", "tm_n_dropped_"]
    check(copies.keep_one(plain), copies.keep_one(wide), wide.columns)
    check(mixing.mixed_documents(plain), mixing.mixed_documents(wide), wide.columns)
    check(quality.keep_good(plain, labels), quality.keep_good(wide, labels), wide.columns)


def test_rows_without_ids_are_shuffled(spark):
    docs = spark.range(4000).selectExpr("cast(null as long) as doc_id", "concat('word ', id) as text", "'s' as source")
    keys = mixing.sized(docs)
    assert keys.select(*mixing._keys(keys, 2)).select("tm_bucket").distinct().count() > 200
    assert mixing.mix_report(docs).filter("taken = size").count() == 4000


def test_repeated_ids_count_once(spark):
    rates = [(i, "en", False, 0.0 if i % 2 else 9.0) for i in range(600)]
    labels = [(i, i % 2) for i in range(600)]
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, lang string, base_failed boolean, badness double")
    marks = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    want = quality.fit(docs(rates), marks(labels))
    assert want["en"] is not None
    assert quality.fit(docs(rates + [rates[1]] * 500), marks(labels + [labels[1]] * 500)) == want
    few = [r for r in rates if r[0] < 40]
    assert quality.fit(docs(few), marks(labels[:40])) == {"en": None}
    assert quality.fit(docs(few * 30), marks(labels[:40] * 30)) == {"en": None}


def test_training_sample_is_bounded(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'de', 'en') as lang", "'word' as text")
    again = docs.unionByName(spark.range(2000).selectExpr("5L as doc_id", "'en' as lang", "'word' as text"))
    counts = lambda **more: sorted(tuple(r) for r in language.training_counts(again, train_docs=50, **more).collect())
    assert counts() == [("de", "word", 50), ("en", "word", 50)]
    assert counts(train_chars=120) == [("de", "word", 30), ("en", "word", 30)] and counts(train_chars=3) == []
