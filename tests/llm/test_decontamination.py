"""Winnowing against looking up every window."""

import hashlib
import random
import re

import pytest

from adsift.llm import decontamination, queries

DOCS = "doc_id long, text string, words string, start int"
ITEMS = "item_id long, text string, length int"


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower) if w]


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    lengths = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        listed = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((doc, len(w), len(hit), len([x for x in found if x is not None]),
                    hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    draw = lambda n: [rng.choice("abcdefgh") + rng.choice(["", "1", "é", "Ü"]) for _ in range(n)]
    items = [(k, " ".join(draw(rng.randint(12, 40)))) for k in range(8)]
    items += [(20, "one"), (21, "Two, words!"), (22, "three of them 3"), (22, "three of them 3"),
              (23, ""), (24, None), (25, "--- !!"), (None, "no item id here at all"),
              (26, "a a a a a a a a a a a a a a")]
    docs = []
    for k in range(60):
        w = draw(rng.randint(0, 80))
        if k % 3 == 0:
            span = words(items[rng.randrange(8)][1])
            at = rng.randrange(len(span))
            w[5:5] = span[at : at + rng.randint(8, 14)]
        docs.append((k, rng.choice([" ", "\n", ", ", "--"]).join(w).upper() if k % 2 else " ".join(w)))
    docs += [(100, None), (101, ""), (102, "ONE"), (103, "x two words y"), (104, "three of them 34"),
             (105, "a " * 500), (106, "No item id HERE at all."), (None, "one"), (None, "one"), (None, None),
             (3, docs[3][1]), (3, docs[6][1]), (107, "z " * 4000 + items[0][1] + " z" * 4000)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_no_window_is_missed(spark, tmp_path, monkeypatch, seed):
    docs, items = corpus(seed)
    tables = {
        "documents": spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS).repartition(3),
        "benchmark": spark.createDataFrame([(*i, 5) for i in items], ITEMS),
    }
    monkeypatch.setattr(queries, "read_table", lambda spark, sf, name: tables[name])
    found = queries.op3_decontaminate(spark, "")
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs, items)
    kept = decontamination.clean_documents(tables["documents"], tables["benchmark"])
    assert kept.columns == tables["documents"].columns
    clean = [d for d, r in zip(docs, [brute([d], items)[0] for d in docs]) if not r[5]]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(clean, key=str)


@pytest.mark.parametrize("docs,items", [([], [(1, "a b")]), ([(1, "a b c")], []), ([(1, "a")], [(1, None)])])
def test_empty_tables(spark, docs, items):
    left = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS)
    right = spark.createDataFrame([(*i, 5) for i in items], ITEMS)
    found = decontamination.find_overlaps(left, right).collect()
    assert [(r["doc_id"], r["n_hit"], r["items"]) for r in found] == [(d[0], 0, []) for d in docs]


def test_a_full_bitmap_changes_nothing(spark):
    docs, items = corpus(3)
    left = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS)
    right = spark.createDataFrame([(*i, 5) for i in items], ITEMS)
    few = decontamination.find_overlaps(left, right, bits=64).collect()
    many = decontamination.find_overlaps(left, right).collect()
    assert sorted(map(str, few)) == sorted(map(str, many))
