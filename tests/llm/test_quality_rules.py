"""Counts and adaptive fences against plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from adsift.llm import quality_rules

SCHEMA = "doc_id long, lang string, source string, text string, kept string, w int"


def counts(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(hit), len(lines))


def brute(rows, least):
    data = []
    for i, lang, source, text in rows:
        n, chars, symbols, dup, repeat, lines = counts(text)
        failed = n < 50 or 100 * repeat > 50 * n
        rates = (symbols / max(chars, 1), dup / max(lines, 1), repeat / max(n, 1), chars / max(n, 1))
        data.append((i, lang, source, (n, chars, symbols, dup, repeat), failed, rates))
    names = quality_rules.RATES

    def fence(group, k):
        values = sorted(d[5][k] for d in group if d[5][k] > 0 or names[k] not in quality_rules.SPARSE)
        if not values:
            return 0, None
        at = lambda q: values[max(math.ceil(len(values) * q), 1) - 1]
        spread = max(quality_rules.SPREAD * (at(0.75) - at(0.5)), quality_rules.EPSILON[names[k]])
        return len(values), at(0.75) + spread

    good = [d for d in data if not d[4]]
    out = []
    for d in data:
        kept = not d[4]
        for k in range(4):
            _, limit = fence(good, k)
            for group in ([g for g in good if g[1] == d[1]], [g for g in good if g[1:3] == d[1:3]]):
                n, own = fence(group, k)
                if n >= least and own is not None:
                    limit = min(own, quality_rules.MOST_ABOVE * limit)
            kept = kept and (limit is None or d[5][k] <= limit)
        out.append((d[0], d[1], d[2], *d[3], d[4], kept))
    return sorted(out, key=str)


def corpus(n):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None, "s1"])
        w = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 9) + str(rng.randint(0, 30)) for _ in range(rng.randint(40, 120))]
        for _ in range(rng.choice([0, 0, 1, 2, 30])):
            w[rng.randrange(len(w))] += rng.choice("#*$%&|<>é")
        if i % 9 == 0:
            w += w[:15]
        if i % 13 == 0:
            w[10:50] = ["\nsame line here\n"] * 3
        rows.append((i, lang, source, " ".join(w)))
    odd = [None, "", " \n\t", "a", "a a", "a a a", "a a a a", "a b a b a b", "x " * 3000, "\n\nq\nq\n q\n",
           "é😀 #|<" * 30, "one two three four " * 30]
    return rows + [(1000 + k, "en", "s1", t) for k, t in enumerate(odd)] + [(None, None, None, None), (1, "en", "s1", "word twice " * 40)] * 2


@pytest.mark.parametrize("n,least", [(160, 100), (160, 12), (0, 100)])
def test_as_plain_python(spark, monkeypatch, n, least):
    monkeypatch.setattr(quality_rules, "LEAST_ROWS", least)
    rows = corpus(n)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    ours = sorted((tuple(r) for r in quality_rules.judge(docs).collect()), key=str)
    assert ours == brute(rows, least)


def test_empty_table(spark):
    assert quality_rules.judge(spark.createDataFrame([], SCHEMA)).collect() == []


def _text(rng, length, symbols=0):
    words = ["".join(rng.choice("abcdefghij") for _ in range(length + rng.randint(-2, 2))) for _ in range(80)]
    return " ".join(words) + " #" * symbols


def test_fences_follow_language_and_source(spark):
    """What is long for one language is usual in another; no constant tells them apart."""
    rng = random.Random(8)
    rows = [(i, lang, "s", _text(rng, length), "x", 1) for i, (lang, length) in enumerate([("a", 5), ("b", 7)] * 150)]
    rows += [(900, "a", "s", _text(rng, 7), "x", 1), (901, "b", "s", _text(rng, 7), "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs).collect()}
    assert kept[901] and not kept[900]
    table = quality_rules.fences(quality_rules.with_rates(quality_rules.measures(docs))).collect()
    fence = {r["l"]: r["long_rate_fence"] for r in table if r["gid"] == 0}
    assert fence["b"] - fence["a"] > 1.5
    # The sketch's spread, not the epsilon, made both.
    assert all(r["long_rate_fence"] - r["long_rate_upper"] > quality_rules.EPSILON["long_rate"] for r in table)


def test_a_source_of_junk_does_not_lift_its_own_fence(spark):
    rng = random.Random(9)
    rows = [(i, "a", f"s{i % 4}", _text(rng, 5), "x", 1) for i in range(600)]
    rows += [(1000 + i, "a", "junk", _text(rng, 5, 20 + i % 60), "x", 1) for i in range(150)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(kept[i] for i in range(600)) >= 595
    assert not any(kept[1000 + i] for i in range(150))


def test_very_long_text(spark):
    rng = random.Random(10)
    rows = [(0, "a", "s", " ".join(_text(rng, 5) for _ in range(2500)), "x", 1)]
    row = quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).first()
    assert row["n_words"] == 200_000 and row["kept"]
