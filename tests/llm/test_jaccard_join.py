"""The similarity join against comparing all pairs."""

import random
import re

import pytest

from adsift.llm import jaccard_join

SCHEMA = "doc_id long, text string, set string, c int"


def shingles(text, size):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower) if x]
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None and sets[i]:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(
        ((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)),
        key=str,
    )


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)


def ours(spark, rows, size, percent):
    found = jaccard_join.similar_groups(table(spark, rows), size, percent)
    return sorted((tuple(r) for r in found.collect()), key=str)


def corpus(seed):
    """Clusters of edits, chains, common passages, copies, short and odd texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("xyz") + str(rng.randint(0, 9))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(15, 120))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.randint(1, 12)):
            edit = list(base)
            for _ in range(rng.randint(0, 4)):
                edit[rng.randrange(len(edit))] = word()
            texts.append(" ".join(edit))
            if rng.random() < 0.5:
                base = edit  # a chain
    texts += [" ".join(passage)] * 3 + [" ".join(passage[k:]) for k in range(6)]
    texts += [None, "", " \t\n", "one", "One", "one two", "ONE  two", "é É", "É é", "a a a a a a", "a a a a"]
    rows = list(enumerate(texts))
    return rows + [(3, texts[40]), (5, texts[5]), (None, texts[7]), (None, "alone null id"), (-4, texts[9])]


@pytest.mark.parametrize("seed,size,percent", [(1, 4, 85), (2, 5, 80), (3, 3, 60)])
def test_groups_are_those_of_all_pairs(spark, seed, size, percent):
    rows = corpus(seed)
    assert ours(spark, rows, size, percent) == brute(rows, size, percent)


def test_large_groups_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(400):
        edit = list(base)
        for _ in range(i % 9):  # two heavy edits may be linked through light ones only
            edit[rng.randrange(200)] = f"v{rng.randint(0, 10**6)}"
        rows.append((1000 + i, " ".join(edit)))
    assert ours(spark, rows, 4, 85) == brute(rows, 4, 85)


def test_no_rows_and_no_links(spark):
    assert ours(spark, [], 4, 85) == []
    rows = [(1, "a b c d e f"), (2, "g h i j k l"), (3, None)]
    assert ours(spark, rows, 4, 85) == brute(rows, 4, 85)


def test_one_of_each_group_stays(spark):
    rows = corpus(4)
    docs = table(spark, rows)
    kept = jaccard_join.one_of_each_group(docs, 4, 85)
    assert kept.columns == docs.columns
    left = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    groups, expected = {}, []
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    label = {i: c for i, _, c in brute(numbered, 4, 85)}
    for k, (doc, text) in enumerate(rows):
        if shingles(text, 4):
            groups.setdefault(label[k], []).append((doc is None, doc or 0, text))
        else:
            expected.append((doc, text))
    assert len(left) == len(expected) + len(groups)
    least = [min(g)[:2] for g in groups.values()]
    assert sorted(str(d) for d, _ in left) == sorted(
        [str(d) for d, _ in expected] + [str(None if none else d) for none, d in least]
    )


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["v"]: r["label"] for r in jaccard_join.components(edges).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
