"""Spelling variants against deletion neighbourhoods in plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from adsift.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, word int, n string"
WORDS = "word string, n long"


def counted(rows):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def brute(counts):
    gaps, near = defaultdict(set), defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            rest = w[:k] + w[k + 1 :]
            gaps[k, rest].add(w)
            if rest in counts:
                near[w].add(rest)
                near[rest].add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in counts.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= 10 * n:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {
        (w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None)
        for w, n in counts.items()
    }


def rows_of(df):
    found = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(found) == len({r["word"] for r in found})
    return {tuple(r) for r in found}


def variants(n, seed, alphabet="abé"):
    """Words of few letters, so that many are near, with counts over several decades."""
    draw = random.Random(seed)
    words = {"".join(draw.choice(alphabet) for _ in range(draw.randint(7, 8))) for _ in range(n)}
    return {w: int(2 * 10 ** draw.uniform(0, 6)) for w in sorted(words)}


@pytest.mark.parametrize(
    "limits",
    [{}, {"tile": 16}, {"tile": 16, "broadcast_blocks": 0}, {"pieces": 1, "tile": 64}, {"pieces": 7}],
)
def test_groups_equal_brute_force(spark, limits):
    counts = variants(900, 1)
    words = spark.createDataFrame(list(counts.items()), WORDS)
    want = brute(counts)
    assert rows_of(spelling.variant_groups(words, **limits)) == want
    assert any(form and root != form for _, form, root, *_ in want)


def test_long_way_of_forms(spark):
    # Each word is near the next only, and a tenth as frequent.
    words = ["aaaaaaa" + "b" * k for k in range(9)]
    counts = {w: 2 * 10**k for k, w in enumerate(words)}
    got = rows_of(spelling.variant_groups(spark.createDataFrame(list(counts.items()), WORDS)))
    assert got == brute(counts)
    assert {root for _, _, root, *_ in got} == {words[-1]}


def test_ties_and_ratio(spark):
    counts = {"aaaaaab": 20, "aaaaaac": 20, "aaaaaaa": 2, "ccccccc": 3, "cccccccc": 29}
    got = {r[0]: r for r in rows_of(spelling.variant_groups(spark.createDataFrame(list(counts.items()), WORDS)))}
    assert got["aaaaaaa"] == ("aaaaaaa", "aaaaaab", "aaaaaab", 2, 2, 20)
    assert got["ccccccc"] == ("ccccccc", None, "ccccccc", 3, 1, None)


def test_long_words_are_exact(spark):
    # Squared lengths beyond what single precision holds.
    long = "ab" * 4000
    counts = {long: 2, long + "a": 50, long[:-1] + "c": 3, long[::-1]: 2}
    got = rows_of(spelling.variant_groups(spark.createDataFrame(list(counts.items()), WORDS)))
    assert got == brute(counts)


def test_documents(spark):
    draw = random.Random(5)
    words = list(variants(60, 2)) + ["NATION", "Straßenbahn", "ÀÉÎÕÜßø", "naïveté"]
    rows = [(i, " ".join(draw.choices(words, k=200))) for i in range(60)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (90, None), (91, ""), (92, "x" * 50_000 + " " + "x" * 50_000)]
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], SCHEMA)
    assert rows_of(spelling.spelling_variants(docs)) == brute(counted(rows))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert spelling.spelling_variants(none).count() == 0
    short = spark.createDataFrame([(1, "few short words", 1, "c")], SCHEMA)
    assert spelling.spelling_variants(short).count() == 0


def test_large_blocks_are_dealt_out(spark):
    # One block of 300 words; no unit has more than two tiles' words.
    words = spark.createDataFrame([(f"aaaaaa{chr(a)}{chr(b)}", 2) for a in range(97, 117) for b in range(97, 112)], WORDS)
    units = spelling.unit_entries(spelling.block_entries(words), tile=32)
    largest = units.groupBy("unit").count().agg(F.max("count")).first()[0]
    assert 32 < largest <= 4 * 32


def test_one_edit():
    assert spelling.one_edit("abc", "abd") and spelling.one_edit("abc", "abcd")
    assert spelling.one_edit("abc", "xabc") and not spelling.one_edit("abc", "abc")
    assert not spelling.one_edit("abc", "acb") and not spelling.one_edit("abc", "bacd")
