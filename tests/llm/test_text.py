"""Quality rules, line dedup, mixing, language and licenses."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.oracle import differences
from tidemark.llm import language, licenses, lines, mixing, quality, queries
from tidemark.llm.common import table

DOC = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("name", ["op6_line_dedup", "op8_mixing", "op1_nearest_neighbours"])
def test_against_sql(spark, sf_dir, name):
    assert differences(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], sf_dir) == []


# --- quality ---


def plain_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {w for w, n in Counter(windows).items() if n > 1}
    marked = {i + k for i, w in enumerate(windows) if w in many for k in range(3)}
    return len(marked)


def test_measures_against_plain():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab#| \n\t!é") for _ in range(rng.randrange(120)))
        words = text.encode().split()
        n, chars, symbols, dup, repeats, failed, _ = quality.measures(text)
        seen, again = set(), 0
        for line in text.split("\n"):
            again += bool(line.encode().split()) and line in seen
            seen.add(line)
        assert n == len(words) and repeats == plain_repeats(words) and dup == again
        assert chars == sum(len(w.decode()) for w in words) and symbols == sum(c in "#*$%&|<>" for c in text)
        assert failed == (n < 50 or 100 * repeats > 50 * n)


def test_binomial():
    from math import comb

    for n, x, p in [(10, 0, 0.1), (50, 3, 0.05), (200, 10, 0.02), (30, 29, 0.9), (5, 5, 0.3)]:
        want = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1))
        assert quality.binomial_at_most(x, n, p) == pytest.approx(want, abs=1e-9)


def test_choice_is_safe():
    size = len(quality.CUTOFFS) + 1
    clean = [0] * (size - 1) + [2000]
    bad = [50] + [0] * (size - 1)
    assert quality.choose({"x": (clean, bad)}) == {"x": quality.CUTOFFS[0]}
    assert quality.choose({"x": ([0] * (size - 1) + [20], bad)}) == {"x": None}  # too few labels
    assert quality.choose({"x": ([100] + [0] * (size - 2) + [1900], bad)}) == {"x": None}  # would lose 5 %
    rng = random.Random(2)
    wrong = 0
    for _ in range(200):  # the true rate of false rejection is 2 %, twice what is allowed
        lost = sum(rng.random() < 0.02 for _ in range(1500))
        wrong += quality.choose({"x": ([lost] + [0] * (size - 2) + [1500 - lost], bad)})["x"] is not None
    assert wrong <= 0.05 * 200


def test_quality_rows(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, good, "en", "a"), (3, good, "en", "a"), (None, "|| " * 90, "en", None), (5, good + " x" * 90_000, "en", "s")]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as n_words", "true as kept")
    labels = spark.createDataFrame([(3, 1, 0), (3, None, 0), (None, 0, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    got = {(r.doc_id, r.n_words): r.kept for r in quality.quality_report(docs, labels).collect()}
    assert got == {(1, 0): False, (2, 0): False, (3, 80): True, (None, 90): False, (5, 90080): False}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 3]
    assert quality.quality_report(docs.limit(0), labels.limit(0)).count() == 0


def test_quality_on_data(spark):
    sf = "/root/testdata/sf0.1"
    got = quality.quality_report(table(spark, sf, "documents"), table(spark, sf, "labels"))
    j = got.join(table(spark, sf, "labels"), "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in j}
    assert share[1] >= 0.99 and share[0] < 0.5


# --- lines ---


def plain_lines(rows):
    keys = {}
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for x in (t or "").split("\n"):
            keys.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        kept = []
        for x in (t or "").split("\n"):
            ids = keys[key(x)]
            named = [d for d in ids if d is not None]
            if len(key(x)) >= 10 and len(ids) > 1 and i != (min(named) if named else None):
                continue
            kept.append(x)
        out.append((i, "\n".join(kept), len((t or "").split("\n")), len((t or "").split("\n")) - len(kept)))
    return sorted(out, key=str)


def test_lines_plain(spark):
    rng = random.Random(5)
    pool = ["a long enough line", "A LONG enough Line  ", "short", "", "Ünicode line é with", "ünicode line é with", "\tanother shared line\x0b", "x" * 12]
    rows = [(rng.choice([*range(12), None]), "\n".join(rng.choice(pool) for _ in range(rng.randrange(6)))) for _ in range(40)]
    rows = list({i: t for i, t in rows}.items()) + [(100, None), (101, "one two three four\n" * 4000)]
    rows.append(rows[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as lost", "'x' as mark", "2 as tm_other")
    got = lines.drop_repeated_lines(docs)
    out = sorted(((r.doc_id, r.text or "", r.tm_n_lines, r.tm_n_dropped) for r in got.collect()), key=str)
    assert out == plain_lines(rows)
    assert lines.drop_repeated_lines(docs.limit(0)).count() == 0


# --- mixing ---


def test_mixing_sums(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    rows += [(5000, None, "en", "z"), (5001, "", "en", "z"), (5002, "w " * 3, "en", "tiny"), (7, "w w", "en", "a"), (7, "w w", "en", "a")]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as size", "2 as taken")
    got = mixing.mix_report(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    assert len(mixing.mix_report(docs).collect()) == len(rows)
    by = {}
    for r in got:
        s = by.setdefault(r.source, [r.source_size, r.target, 0, r.size])
        s[2] += r.taken
        assert r.size == 0 or r.taken % r.size == 0 and r.taken <= 3 * r.size
    total = sum(s[0] for s in by.values())
    assert sum(s[1] for s in by.values()) == pytest.approx(total)
    for size, target, taken, _ in by.values():
        assert 0 <= target <= 3 * size
        assert abs(taken - target) <= 40
    again = mixing.mix_report(docs.repartition(7))
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, mixing.mix_report(docs).collect()))
    assert mixing.mix_report(docs.limit(0)).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.taken // r.size if r.size else 1 for r in mixing.mix_report(docs).collect())


def test_targets_stop_and_reshare(spark):
    rows = [(i, "w " * 10, "en", s) for i, s in enumerate(["a"] * 900 + ["b"] * 10 + ["c"] * 10)]
    got = {r.source_size: r.target for r in mixing.mix_report(spark.createDataFrame(rows, DOC)).collect()}
    assert got[9000] == pytest.approx(9200 - 2 * 300) and got[100] == 300.0


# --- language ---


def plain_sum(pieces, table, word):
    text = language.MARK + word
    names = {n: table[k] for k, n in enumerate(pieces.names)}

    def total(at):
        if at == len(text):
            return 1.0
        out = 0.0
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in names:
                out += names[text[at:end]] * total(end)
        return out if text[at] in names else out + language.UNKNOWN * total(at + 1)

    return total(0)


def test_forward_sums_all_segmentations():
    from math import log

    p = language.Pieces(queries.piece_model())
    a = language.learn(p, {"the": 9, "thing": 3, "then": 2})
    b = language.learn(p, {"der": 9, "nder": 2, "über": 4})
    s = language.Scorer(queries.piece_model(), ["x", "y"], [a, b])
    for word in ("the", "thing", "qqq", "über", "日本"):
        assert s.word(word) == pytest.approx([log(plain_sum(p, a, word)), log(plain_sum(p, b, word))])
    assert s.word("the" * 40)[0] > s.word("the" * 40)[1]


def test_language_rows(spark):
    rng = random.Random(6)
    en, de = ["the", "and", "thing", "with"], ["der", "und", "nicht", "ein"]
    rows = [(i, " ".join(rng.choice(en if i % 2 else de) for _ in range(20)), "en" if i % 2 else "de", "s") for i in range(200)]
    rows += [(900, None, "en", "s"), (901, "123 ½ !!", "de", "s"), (None, "the and thing", None, None), (902, "the " * 30_000, None, "s"), (1, rows[1][1], "en", "s")]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as score", "true as held_out_x")
    got = language.predict(docs, queries.piece_model()).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[900].lang_pred == by[901].lang_pred == "und" and by[902].lang_pred == "en" and by[None].lang_pred == "en"
    assert all(by[i].lang_pred == ("en" if i % 2 else "de") for i in range(200)) and all(0 <= r.score <= 1 for r in got)
    assert not by[None].held_out
    assert language.predict(docs.limit(0), queries.piece_model()).count() == 0
    assert {r.lang_pred for r in language.predict(docs.withColumn("lang", F.lit(None).cast("string")), queries.piece_model()).collect()} == {"und"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    j = language.predict(docs, queries.piece_model()).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert j.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.98


# --- licenses ---


def plain_licenses(text, templates):
    w = licenses.WORDS.findall((text or "").lower())
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = set()
    for name, t in templates.items():
        v = licenses.WORDS.findall(t.lower())
        want = {tuple(v[i : i + 5]) for i in range(len(v) - 4)}
        n = len(v) - 4
        if any(5 * len(want & set(grams[i : i + n])) >= 4 * len(want) for i in range(max(1, len(grams) - n + 1))):
            out.add(name)
    return out


def test_licenses(spark):
    rng = random.Random(8)
    rows = [(1, None), (2, ""), (3, "too few words"), (None, licenses.TEMPLATES["mit"])]
    for i in range(10, 150):
        name = rng.choice(list(licenses.TEMPLATES))
        words = licenses.TEMPLATES[name].split()
        if len(words) > 40 and i % 3 == 0:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join([f"a{rng.random()}" for _ in range(rng.randrange(60))] + words + [f"b{rng.random()}" for _ in range(rng.randrange(60))])))
    rows.append((500, "word soup here again " * 10_000 + licenses.TEMPLATES["gpl-notice"] + " and more" * 9_000))
    rows.append(rows[-2])
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as license", "2 as share")
    got = Counter((r.doc_id, r.license) for r in licenses.find_licenses(docs).collect())
    want = Counter((i, name) for i, t in rows for name in plain_licenses(t, licenses.TEMPLATES))
    assert got == want
    assert licenses.find_licenses(docs.limit(0)).count() == 0
