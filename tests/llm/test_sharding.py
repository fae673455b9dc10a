"""Extendible hashing against splitting buckets one bit at a time."""

import hashlib
from collections import Counter

import pytest

from adsift.llm import sharding

SCHEMA = "doc_id long, text string, hash int, cell string"


def bits_of(doc, text):
    inner = "" if text is None else hashlib.md5(text.encode()).hexdigest()
    digest = hashlib.md5(f"{'' if doc is None else doc}:{inner}".encode()).hexdigest()
    return bin(int(digest[:15], 16))[2:].zfill(60)


def brute(rows, limit):
    out = []

    def split(bucket, prefix):
        if sum(len((t or "").encode()) for _, t in bucket) <= limit:
            out.extend((d, t, f"b{prefix}") for d, t in bucket)
        elif len(prefix) == 60:
            page = max(1, limit // max(1, max(len((t or "").encode()) for _, t in bucket)))
            out.extend((d, t, f"b{prefix}-{k // page}") for k, (d, t) in enumerate(bucket))
        else:
            for bit in "01":
                part = [r for r in bucket if bits_of(*r).startswith(prefix + bit)]
                if part:
                    split(part, prefix + bit)

    if rows:
        split(rows, "")
    return sorted(out, key=str)


ROWS = [(i, "x" * (i * 37 % 400)) for i in range(300)]
ROWS += [(7, "same row " * 5)] * 40 + [(8, "é" * 700), (9, "y" * 5000), (9, None), (None, None), (None, ""),
         (None, "null id"), (10, ""), (10, "")]


@pytest.mark.parametrize("rows,limit", [(ROWS, 1000), (ROWS, 150), (ROWS, 1 << 20), ([], 10), ([(1, "abc")], 2)])
def test_as_splitting_bit_by_bit(spark, rows, limit):
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA).repartition(3)
    found = sharding.assign_shards(docs, limit)
    assert found.columns == [*docs.columns, "shard"]
    ours = sorted(((r["doc_id"], r["text"], r["shard"]) for r in found.collect()), key=str)
    assert ours == brute(rows, limit)
    sizes, members = Counter(), Counter()
    for _, text, shard in ours:
        sizes[shard] += len((text or "").encode())
        members[shard] += 1
    assert all(n <= limit or members[s] == 1 for s, n in sizes.items())


def test_shards_are_written_whole(spark, tmp_path):
    docs = spark.createDataFrame([(*r, 1, "c") for r in ROWS], SCHEMA)
    sharding.write_shards(sharding.assign_shards(docs, 1000), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(str((r["doc_id"], r["text"])) for r in back.collect()) == sorted(str(r) for r in ROWS)


def test_rows_that_differ_in_other_columns_only_share_the_limit(spark):
    rows = [(7, "same row " * 5, k % 5, None if k % 3 else "c") for k in range(90)] + [(8, "other", 1, "c")] * 3
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    ours = sharding.assign_shards(docs, 150).collect()
    assert sorted((r["doc_id"], r["text"], r["shard"]) for r in ours) == brute([r[:2] for r in rows], 150)
    assert Counter(tuple(r)[:4] for r in ours) == Counter(rows)
    sizes = Counter()
    for r in ours:
        sizes[r["shard"]] += len(r["text"])
    assert max(sizes.values()) <= 150
