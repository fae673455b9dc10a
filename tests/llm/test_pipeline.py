"""The pipeline, stage by stage, against brute-force versions."""

import math
from collections import Counter

import corpus_pipeline
from adsift.llm.common import read_table
from conftest import SMALL

import test_decontamination
import test_jaccard_join
import test_mixing


def rows_of(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def test_stages(spark):
    docs = read_table(spark, SMALL, "documents")
    columns, left = docs.columns, [docs]
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        done = step(spark, left[-1], SMALL)
        assert done.columns == columns if k < 4 else set(columns) <= set(done.columns)
        left.append(corpus_pipeline.stage(done, "test-stage"))
    raw, good, single, clean, mixed, sharded = map(rows_of, left)

    truth = {r["doc_id"]: r["quality"] for r in read_table(spark, SMALL, "labels").collect()}
    kept = {r[0] for r in good}
    assert sum((i in kept) == bool(q) for i, q in truth.items()) >= 0.97 * len(truth)

    label = {i: c for i, _, c in test_jaccard_join.brute([r[:2] for r in good], 5, 80)}
    assert sorted(r[0] for r in single) == sorted(set(label.values()))

    items = [(r["item_id"], r["text"]) for r in read_table(spark, SMALL, "benchmark").collect()]
    dirty = {r[0] for r in test_decontamination.brute([r[:2] for r in single], items) if r[5]}
    assert dirty and sorted(r[0] for r in clean) == sorted(r[0] for r in single if r[0] not in dirty)

    taken = test_mixing.brute(clean)
    assert Counter(r[0] for r in mixed) == Counter({r[0]: math.ceil(r[4] / r[1]) for r in taken if r[4]})

    assert Counter(r[0] for r in sharded) == Counter(r[0] for r in mixed)
    sizes, limit = Counter(), corpus_pipeline.sharding.LIMIT
    for r in left[-1].collect():
        assert r["n_bytes"] == len(r["text"].encode())
        sizes[r["shard"]] += r["n_bytes"]
    assert max(sizes.values()) <= limit


def test_run_is_all_stages(spark):
    assert set(read_table(spark, SMALL, "documents").columns) < set(corpus_pipeline.run(spark, SMALL).columns)


def test_odd_documents_pass_through(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, _id int"
    rows = [(i, f"plain text number {i} " * (i % 30), "en", f"s{i % 3}", 10, "x", 1) for i in range(60)]
    rows += [(None, None, None, None, None, None, None), (5, "", None, None, None, None, None),
             (6, rows[6][1], "en", "s0", 10, "x", 1), (70, "word " * 40000, "en", "s1", 200000, "x", 1)]
    for table, data, kinds in (
        ("labels", [(i, int(i % 5 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, "some words of a benchmark item"), (None, None)], "item_id long, text string"),
    ):
        spark.createDataFrame(data, kinds).write.parquet(str(tmp_path / f"{table}.parquet"))
    for these in (rows, []):
        docs = spark.createDataFrame(these, schema)
        for k, (_, step) in enumerate(corpus_pipeline.STAGES):
            docs = corpus_pipeline.stage(step(spark, docs, str(tmp_path)), "test-odd")
        assert {"shard_", "n_bytes"} < set(docs.columns)
        assert bool(docs.count()) == bool(these)
