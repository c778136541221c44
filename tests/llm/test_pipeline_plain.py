"""The whole pipeline against plain Python on the smallest tables."""

import hashlib
from collections import Counter

import sentencepiece

import corpus_pipeline
from tests.llm.brute import plain_copies
from tests.llm.test_text import plain_lines, plain_repeats
from tidemark.llm import quality
from tidemark.llm.common import table
from tidemark.llm.queries import piece_model


def plain_targets(totals):
    """Targets by sharing, stopping at three times the size, and sharing the excess again."""
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    budget = sum(totals.values())
    stopped = set()
    while True:
        free = [s for s in order if s not in stopped]
        left = budget - sum(3 * totals[s] for s in stopped)
        level = left / sum(weight[s] for s in free) if free else 0.0
        over = {s for s in free if 3 * totals[s] * sum(weight[x] for x in free) <= left * weight[s]}
        if not over:
            return order, {s: float(3 * totals[s]) if s in stopped else weight[s] * level for s in order}
        stopped |= over


def plain_mix(rows):
    """Times that each (id, source, size) row is taken."""
    totals = Counter()
    for _, source, size in rows:
        totals[source] += size
    order, target = plain_targets(dict(totals))
    items, turns = [], Counter({i: 1 for i, _, size in rows if not size})
    for rank, s in enumerate(order):
        run = 0
        keyed = sorted((hashlib.md5(f"{i}:mix".encode()).hexdigest(), i, size) for i, source, size in rows if source == s)
        for key, i, size in keyed:
            run += size
            items += [((turn * totals[s] + run) / target[s], rank, turn, key, i, size) for turn in range(3) if size and target[s] and turn * totals[s] + run - size < target[s]]
    left = sum(totals.values())
    for *_, i, size in sorted(items):
        left -= size
        if left < 0:
            break
        turns[i] += 1
    return turns


def test_pipeline_against_plain_python(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in table(spark, sf_dir, "documents").collect()]
    assert set(quality.fit(quality.measured(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")).values()) <= {None}  # too few labels here
    good = []
    for i, text, _, source in docs:
        words = (text or "").encode().split()
        if len(words) >= 50 and 100 * plain_repeats(words) <= 50 * len(words):
            good.append((i, text, source))
    source = {i: s for i, _, s in good}
    lined = [(i, text) for i, text, *_ in plain_lines([(i, t) for i, t, _ in good])]
    groups = plain_copies(lined)
    kept = {lined[k][0]: lined[k][1] for k, v in groups.items() if v[0] == lined[k][0] or not lined[k][1].split()}
    turns = plain_mix([(i, source[i], len(t.encode().split())) for i, t in kept.items()])
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for i, n in turns.items():
        ids = lib.encode(kept[i], add_eos=True)
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids))] += n
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == +want
