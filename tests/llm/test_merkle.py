"""Manifests and proofs against a tree of plain lists."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from adsift.llm import merkle

# Extra columns, some named like columns of the operator.
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, key string, leaf int, step string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    doc_id, _, source, lang, n_chars = row
    return h("".join(part(v) for v in (doc_id, source, lang, n_chars, text)))


def tree_of(hashes):
    """The top and, for each leaf, the siblings before and after it on its way up."""
    ways, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for way, a in zip(ways, at):
            start = a // 3 * 3
            way.append(("".join(hashes[start:a]), "".join(hashes[a + 1 : start + 3])))
        at = [a // 3 for a in at]
        hashes = [h("".join(hashes[i : i + 3])) for i in range(0, len(hashes), 3)]
    return hashes[0], ways


def brute(rows):
    sources = defaultdict(list)
    for row in rows:
        doc_id, text, source = row[:3]
        now = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            now = text.replace("\n", "")
        sources[source].append((doc_id, leaf_of(row, text), leaf_of(row, now)))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        sources[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    trees = [tree_of([leaf for _, leaf, _ in sources[s]]) for s in names]
    root, tops = tree_of([top for top, _ in trees])
    found = []
    for s, (subroot, ways), top in zip(names, trees, tops):
        for (doc_id, leaf, now), way in zip(sources[s], ways):
            for before, after in way + top:
                now = h(before + now + after)
            proof = h("".join(before + after for before, after in way + top))
            found.append((doc_id, leaf, subroot, root, proof, now, now == root))
    return found


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "k", 1, "s") for r in rows], SCHEMA)
    got = [tuple(r) for r in merkle.prove_documents(docs).collect()]
    by = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(got, key=by) == sorted(brute(rows), key=by)
    return got


def make(n, sources, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        source = sources[min(int(draw.expovariate(1) * 2), len(sources) - 1)]
        text = draw.choice(["a\nb", "plain", "\n\n", f"line {i}\nmore é", None, ""])
        rows.append((i, text, source, draw.choice(["en", None]), draw.choice([i, None])))
    return rows


def test_proofs_equal_brute_force(spark):
    got = check(spark, make(300, ["web", "é", None, "a", "Z", "books"]))
    assert {True, False} == {r[-1] for r in got}


def test_repeated_rows_and_null_ids(spark):
    rows = make(40, ["web", "a"])
    rows += [rows[3]] * 4 + [(None, "x\ny", "web", "en", 3), (None, "x\ny", None, None, None), (None, None, None, None, None)]
    rows += [(5, "another text\nwith that id", "a", "en", 1)]
    check(spark, rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10])
def test_small_trees(spark, n):
    check(spark, [(i, "t\n", "one", "en", 2) for i in range(n)])


def test_a_source_for_each_row(spark):
    check(spark, [(i, "t\nu", f"s{i}", "en", 2) for i in range(14)])


def test_long_text(spark):
    check(spark, [(i, "long line é\n" * 100_000, "one", "en", 2) for i in range(3)])


def test_empty_and_absent_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.prove_documents(none).collect() == []
    assert merkle.build(merkle.document_leaves(none)).root is None
    bare = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    rows = [tuple(r) for r in merkle.prove_documents(bare).collect()]
    assert sorted(rows) == sorted(brute([(1, "a", None, None, None), (2, "b", None, None, None)]))


def test_hot_nodes_are_salted(spark):
    # All 4,000 leaves pass the nodes near the root, but no key of the climb has many.
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("one").alias("source"), F.lit("t").alias("text")
    )
    manifest = merkle.build(merkle.document_leaves(docs))
    rows = merkle.climb(manifest)
    assert rows.groupBy("next", "salt").count().agg(F.max("count")).first()[0] < 40
    assert merkle.proofs(manifest).where("verified").count() == 4000


def test_the_row_limit_of_recursion_is_left_as_it_was(spark):
    name = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(name, "77")
    try:
        check(spark, make(50, ["web", "a"]))
        assert spark.conf.get(name) == "77"
    finally:
        spark.conf.unset(name)
