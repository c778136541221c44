"""Plain versions of operators, for small tables."""

from __future__ import annotations

import string


def plain_shingles(text):
    words = []
    for w in (text or "").encode().split():
        shown = w.decode().lower()
        words.append(shown.strip(string.punctuation) or shown)
    if not words:
        return frozenset()
    k = min(5, len(words))
    return frozenset((k, *words[i : i + k]) for i in range(len(words) - k + 1))


def plain_copies(rows):
    """{row number: (class_id, n_links, exact_id, n_copies)} of (doc_id, text) rows."""
    sets = [plain_shingles(t) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    links = {i: set() for i in range(len(rows))}
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in holders[x]:
                shared[j] = shared.get(j, 0) + 1
        for j, k in shared.items():
            if j != i and 5 * k >= 4 * (len(s) + len(sets[j]) - k):
                links[i].add(j)
    label, out = {}, {}
    for i in range(len(rows)):
        if i in label:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        for j in group:
            label[j] = min(ids, default=None)
    for i, s in enumerate(sets):
        same = [j for j in links[i] if sets[j] == s] + [i]
        ids = [rows[j][0] for j in same if rows[j][0] is not None]
        out[i] = (label[i], len(links[i]), min(ids, default=None), len(same))
    return out
