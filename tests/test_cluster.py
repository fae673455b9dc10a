"""Registered queries on a cluster of its own processes, whose checkpoint folder is a bare path."""

import json
import os
import pathlib
import subprocess
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pyspark
import pytest

import __spark_entry__ as spec

# All that write a table and read it again, but for the fits of models; what these share, the
# feature table, is in assembled_features.
STAGED = [
    "best_threshold", "bootstrap_weights", "calibration_folds", "calibration_sample", "category_encode_v1",
    "category_encode", "class_weights", "classification_metrics", "dedup_postings", "fraud_trigger_index",
    "file_order_keys", "index_stats", "label_job_keyless", "label_job_text_ids", "assembled_features",
]

# Those that fit models; the boosted trees are fitted once for three of them.
MODELS = [
    "lr_stationarity", "calibration_balance", "cross_fitted_rows", "calibrated_scores", "feature_importance",
    "gbt_scores", "gain_importance", "importance_sums",
]

RUN = """
import json, sys
from pyspark.sql import SparkSession
import __spark_entry__ as spec
shared, sf, *names = sys.argv[1:]
conf = {
    "spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "1g", "spark.checkpoint.dir": shared,
    "spark.sql.shuffle.partitions": "2", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1",
}
spark = SparkSession.builder.config(map=conf).getOrCreate()
found = {}
for name in names:
    try:
        found[name] = sorted([str(x) for x in r] for r in spec.queries()[name](spark, sf).collect())
    except Exception as error:
        found[name] = f"{type(error).__name__}: {error}"[:500]
open(f"{shared}/found.json", "w").write(json.dumps(found))
spark.stop()
"""


def _documents(path):
    words = "python sql salary fee remote urgent hiring whatsapp office team data report".split()
    texts = [" ".join(words[(i * j + j) % len(words)] for j in range(1, 9 + i % 30)) for i in range(90)]
    table = {"doc_id": pa.array(range(1, 91), pa.int64()), "text": [None if i % 41 == 7 else t for i, t in enumerate(texts)]}
    pq.write_table(pa.table(table), path / "documents.parquet")


def _on_a_cluster(path, names):
    """The folder of the tables, and what the queries give there; an error as its text."""
    sf, shared, home = (path / n for n in ("sf", "shared", "home"))
    for folder in (sf, shared, home / "work", path / "local"):
        folder.mkdir(parents=True)
    _documents(sf)
    # The executors' logs go to the folder work of Spark's home.
    for part in pathlib.Path(pyspark.__file__).parent.iterdir():
        if part.name != "work":
            (home / part.name).symlink_to(part)
    env = os.environ | {
        "SPARK_HOME": str(home), "SPARK_LOCAL_DIRS": str(path / "local"), "SPARK_LOCAL_IP": "127.0.0.1",
        "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable, "PYTHONDONTWRITEBYTECODE": "1",
        "PYSPARK_SUBMIT_ARGS": "--driver-memory 1g pyspark-shell",
        "PYTHONPATH": os.path.dirname(os.path.abspath(spec.__file__)),
    }
    for name in list(env):
        if name.startswith("PYSPARK_GATEWAY"):
            del env[name]
    command = [sys.executable, "-c", RUN, str(shared), str(sf), *names]
    subprocess.run(command, env=env, cwd=path, check=True, timeout=600)
    return str(sf), json.loads((shared / "found.json").read_text())


def test_staged_queries_on_a_cluster_with_a_bare_checkpoint_path(spark, tmp_path):
    sf, found = _on_a_cluster(tmp_path, STAGED)
    here = {n: sorted([str(x) for x in r] for r in spec.queries()[n](spark, sf).collect()) for n in STAGED}
    assert all(here.values())
    assert found == here


@pytest.mark.slow
def test_model_queries_on_a_cluster_with_a_bare_checkpoint_path(spark, tmp_path):
    sf, found = _on_a_cluster(tmp_path, MODELS)
    assert not {n: f for n, f in found.items() if isinstance(f, str)}
    # Counts and checks; scores and importances may differ in their last digits.
    for name in ("lr_stationarity", "calibration_balance", "cross_fitted_rows"):
        assert found[name] == sorted([str(x) for x in r] for r in spec.queries()[name](spark, sf).collect()), name
    split = spec.queries()["stratified_split"](spark, sf).where("split = 'test'").collect()
    for name in ("calibrated_scores", "gbt_scores"):
        assert sorted(int(r[0]) for r in found[name]) == sorted(r["job_id"] for r in split), name
    assert found["feature_importance"] and found["gain_importance"]
    # The forest lists features that no tree uses, the boosted trees do not.
    assert found["importance_sums"] == [
        ["GradientBoosting", "True", "True", "1.0", "True"], ["RandomForest", "False", "True", "1.0", "True"],
    ]
