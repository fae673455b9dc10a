"""Mixing against a plain walk along each source's order."""

import hashlib
import math
import re
from collections import Counter

import pytest

from adsift.llm import mixing

# Extra columns, one of them named like a column of the operator.
SCHEMA = "doc_id long, text string, source string, size string, taken int"


def size_of(text):
    return len([w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w])


def brute(rows, weights=(3, 1, 2), share=1.5, most=2):
    docs = [(i, s, size_of(t)) for i, t, s in rows]
    sizes = Counter()
    for _, s, n in docs:
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    free, left, target = set(names), share * sum(sizes.values()), {}
    while free:
        whole = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / whole > most * sizes[s]}
        if not above:
            target |= {s: left * weight[s] / whole for s in free}
            break
        for s in above:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in above)
        free -= above
    taken = []
    for s in names:
        key = lambda d: hashlib.md5(f"{'' if d[0] is None else d[0]}:mix".encode()).hexdigest()
        own = sorted((d for d in docs if d[1] == s), key=lambda d: (key(d), d[0] is not None, d[0] or 0, d[2]))
        budget = math.floor(target[s] + 1e-9)
        got = [0] * len(own)
        while budget > 0 and sizes[s]:
            for k, d in enumerate(own):
                now = min(d[2], budget)
                got[k] += now
                budget -= now
        taken += [(d[0], d[2], sizes[s], target[s], g) for d, g in zip(own, got)]
    return taken


ROWS = [(i, "w " * (i * 7 % 23), ["b", "a", None, "ü", "B", "a", "a"][i % 7]) for i in range(150)]
ROWS += [(7, "w w w", "a"), (7, "w w w", "a"), (7, "w", "a"), (None, "x y", "a"), (None, None, None),
         (900, "", "empty"), (901, None, "empty"), (902, " \n\t", "a"), (903, "long " * 3000, "b")]


def same(ours, theirs):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[4])
    ours, theirs = sorted(ours, key=key), sorted(theirs, key=key)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3]) and a[4] == b[4]


def run(spark, rows, **shares):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    found = mixing.mix(docs.repartition(3), **shares)
    return [tuple(r) for r in found.select("doc_id", "size", "source_size", "target", "taken").collect()]


@pytest.mark.parametrize("rows", [ROWS, [], [(1, None, None)], [(1, "a b", "s"), (2, "c", "t")]])
def test_as_a_plain_walk(spark, rows):
    same(run(spark, rows), brute(rows))


def test_other_shares_and_reruns(spark):
    first = run(spark, ROWS, share=0.5, weights=(1, 5), max_epochs=1)
    same(first, brute(ROWS, (1, 5), 0.5, 1))
    same(first, run(spark, ROWS, share=0.5, weights=(1, 5), max_epochs=1))


def test_sources_come_out_at_their_targets(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA)
    targets = {r[2]: math.floor(r[3]) for r in brute(ROWS)}
    sums = Counter()
    for r in brute(ROWS):
        sums[r[2]] += r[4]
    assert sums == targets
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words, longest = Counter(), {}
    for r in mixed.collect():
        words[r["source"]] += size_of(r["text"])
    by_source = {}
    for i, t, s in ROWS:
        longest[s] = max(longest.get(s, 0), size_of(t))
    for (_, _, s), r in zip(ROWS, ROWS):
        by_source.setdefault(s, 0)
        by_source[s] += size_of(r[1])
    wanted = {s: next(r[3] for r in brute(ROWS) if r[2] == n) for s, n in by_source.items() if n}
    for s, goal in wanted.items():
        assert math.floor(goal) <= words[s] < goal + longest[s] * 4


def test_mixed_documents_are_taken_as_often_as_counted(spark):
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    times = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    assert times == Counter({r[0]: math.ceil(r[4] / r[1]) for r in brute(rows) if r[4]})
