import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pieces
from tidemark.llm.queries import piece_model


@pytest.fixture(scope="module")
def both():
    return pieces.PieceCodec(piece_model()), sentencepiece.SentencePieceProcessor(model_file=piece_model())


BOTH = None


def same(ours, lib, text):
    want = lib.encode(text, add_eos=True)
    assert ours.encode(text) == want, repr(text)
    assert ours.decode(want) == lib.decode(want), repr(text)


@pytest.mark.parametrize("text", ["", " ", "  ", "a", " a", "a ", "Hello  world ", "a\n\nb\tc", "\x00", "▁x ▁", "</s><s><unk><0x0A>", "①ﬁ　x", "👩‍👩‍👧 é", "e" * 5000, "ab" * 3000, " " * 300, "don't, e.g. x.com/%%%###!!", "\r\n\x0b\x0c"])
def test_cases(both, text):
    same(*both, text)


def test_random_pieces(both):
    ours, lib = both
    rng = random.Random(7)
    names = list(ours.ids)
    for _ in range(3000):
        same(ours, lib, "".join(rng.choice(names) for _ in range(rng.randrange(12))).replace("▁", rng.choice(["▁", " "])))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    global BOTH
    text = text.encode("utf-8", "ignore").decode()
    BOTH = BOTH or (pieces.PieceCodec(piece_model()), sentencepiece.SentencePieceProcessor(model_file=piece_model()))
    same(*BOTH, text)


def test_backtracking_needed_is_exact(both):
    ours, lib = both
    rng = random.Random(3)
    letters = "aeinorst"
    for _ in range(2000):
        same(ours, lib, "".join(rng.choice(letters) for _ in range(rng.randrange(30))))


def test_documents(spark, both):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x\ny"), (5, "long " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as ids")
    got = sorted(map(tuple, pieces.digest_documents(docs, piece_model()).collect()), key=str)
    lib = both[1]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_eos=True)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids))))
    assert got == sorted(want, key=str)
    assert pieces.digest_documents(docs.limit(0), piece_model()).count() == 0
    assert {tuple(r) for r in pieces.encode_documents(docs, piece_model()).selectExpr("doc_id", "size(ids)", "decoded = coalesce(decoded, '')").collect()} >= {(1, 1, True)}
