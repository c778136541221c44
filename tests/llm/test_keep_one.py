"""Which row of a group of near copies stays, with missing and repeated ids."""

from tidemark.llm import copies


def test_missing_and_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    near = a.replace("a39", "other")
    rows = [
        (None, b, "x"), (None, b, "y"), (None, b, "x"),  # copies without ids
        (1, a, "x"), (None, near, "x"), (1, a, "x"),  # an id beats none; a repeated row
        (2, near, "x"), (2, c, "x"),  # one id, two texts: one is a copy of 1, the other of nothing
        (3, c + " end", "x"), (4, d, "x"),
        (5, "", "x"), (5, "", "x"), (5, None, "x"), (None, " ", "x"), (None, " ", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(repr, (tuple(r) for r in copies.keep_one(docs).collect())))
    want = [(None, b, "x"), (1, a, "x"), (2, c, "x"), (4, d, "x"), (5, "", "x"), (5, None, "x"), (None, " ", "x"), (None, " ", "x")]
    assert got == sorted(map(repr, want))
