import random

import pytest
from pyspark.sql import functions as F

from adsift.sources import postings, records, storage
from conftest import column, posting_rows


def test_csv_scan_with_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "jobs.csv"
    path.write_text(
        'Job Title,Company Name,Job Description,Recruiter Email,Extra\n'
        'Analyst,"Acme, Inc","line one\nline ""two""",a@b.c,1\n'
        "Clerk,N/A,null,,2\n"
    )
    df = postings.tolerant_schema(
        postings.scan_postings(spark, str(path), "csv", multi_line=True)
    )
    rows = df.orderBy("Extra").collect()
    assert rows[0]["company_name"] == "Acme, Inc"
    assert rows[0]["job_description"] == 'line one\nline "two"'
    assert rows[1]["company_name"] is None and rows[1]["job_description"] is None
    # Columns the file lacks get their default.
    assert rows[0]["company_size"] == "Unknown" and rows[0]["skills_required"] == ""
    assert rows[0]["salary_range"] is None
    keyed = postings.surrogate_key(df)
    assert column(keyed, "job_title") == ["Analyst", "Clerk"]


def test_null_tokens_are_not_trimmed(spark):
    names = ["NA", " NA ", "nan", "none", "None", "", "x"]
    df = postings.tolerant_schema(posting_rows(spark, [{"company_name": n} for n in names]))
    assert column(df, "company_name") == [None, " NA ", None, "none", None, None, "x"]


def test_surrogate_key_is_consecutive_in_file_order(spark, tmp_path):
    source = spark.range(0, 1000, 1, 7).select(F.col("id").alias("place"))
    source.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert df.rdd.getNumPartitions() > 1
    keyed = postings.surrogate_key(df)
    rows = sorted((r["job_id"], r["place"]) for r in keyed.collect())
    assert [i for i, _ in rows] == list(range(1, 1001))
    # Rows of a file follow each other; the files are read in some order.
    breaks = sum(b[1] != a[1] + 1 for a, b in zip(rows, rows[1:]))
    assert breaks < 7
    kept = postings.surrogate_key(keyed)
    assert kept is keyed


def test_default_label(spark):
    df = posting_rows(spark, [{}])
    assert column(postings.default_label(df), "fake_label") == [0]
    given = df.withColumn("fake_label", F.lit(1))
    assert column(postings.default_label(given), "fake_label") == [1]


def test_dedup_treats_nulls_as_equal(spark):
    one = {"job_id": 1, "job_title": "a"}
    df = posting_rows(spark, [one, one, {**one, "job_title": None}, {**one, "job_title": None}])
    assert postings.dedup_postings(df).count() == 2
    assert tuple(postings.dedup_counts(df).first()) == (4, 2)
    assert tuple(postings.dedup_counts(df.where("false")).first()) == (0, 0)


def test_dedup_moves_only_rows_that_may_have_copies(spark):
    df = posting_rows(spark, [{"job_id": i % 90, "job_description": f"text {i % 90}"} for i in range(100)])
    assert postings.dedup_postings(df).count() == 90
    plan = postings._digest_counts(df)._jdf.queryExecution().executedPlan().toString()
    exchange = next(line for line in plan.splitlines() if "Exchange" in line)
    assert "digest" in exchange and "job_description" not in exchange


def test_profile_and_samples(spark):
    df = posting_rows(spark, [{"job_description": "x " * 900}, {}, {"job_description": "c"}])
    profile = {r["column_name"]: r for r in postings.input_profile(df).collect()}
    assert profile["job_description"]["null_count"] == 1
    assert profile["job_id"]["row_count"] == 3 and profile["job_id"]["position"] == 0
    samples = postings.description_samples(df).collect()
    assert [(r["job_id"], r["word_count"], len(r["sample"])) for r in samples] == [
        (0, 900, 1000), (1, 1, 3),
    ]
    assert postings.description_samples(df.drop("job_description")).count() == 0


def test_staging_needs_a_shared_folder_on_a_cluster(spark):
    class Context:
        master = "yarn"

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        storage.scratch_dir(Session())
    assert storage.scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_a_finished_job_leaves_no_staged_table(spark, tmp_path, monkeypatch):
    import os

    from adsift.sources import storage

    monkeypatch.setattr(storage, "scratch_dir", lambda spark: str(tmp_path))
    with storage.staged_job():
        assert storage.stage(spark.range(5), "five").count() == 5
        assert os.listdir(tmp_path / "adsift")
    assert not os.listdir(tmp_path / "adsift")


def test_scratch_dir_leaves_the_session_as_it_is(spark):
    from adsift.sources import storage

    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Fake:
        def __init__(self, master, **conf):
            self.conf = Conf(conf)
            self.sparkContext = type("C", (), {"master": master})()

    key = storage.CHECKPOINT_CONF
    fake = Fake("local[4]")
    assert storage.scratch_dir(fake) == storage.scratch_dir(fake) and not fake.conf
    assert storage.scratch_dir(Fake("local-cluster[2,1,1024]", **{key: "file:///s/"})) == "file:///s"
    for bad in (Fake("spark://host"), Fake("spark://host", **{key: "/tmp/x"})):
        with pytest.raises(ValueError):
            storage.scratch_dir(bad)


class _Cluster:
    """A session of a cluster with what Spark makes of its checkpoint folder."""

    master = "spark://host"

    def __init__(self, spark, conf, own):
        self.conf, self.own, self.sparkContext = dict(conf), own, self
        self.range, self.read, self.defaultParallelism = spark.range, spark.read, 3

    def getCheckpointDir(self):
        return self.own


def test_bare_checkpoint_paths_are_of_the_file_system_that_spark_takes(spark, tmp_path):
    bare = {storage.CHECKPOINT_CONF: "/shared/x"}
    assert storage.scratch_dir(_Cluster(spark, bare, "hdfs://name/shared/x/1-2")) == "hdfs://name/shared/x"
    assert storage.scratch_dir(_Cluster(spark, {}, "hdfs://name/other/1-2")) == "hdfs://name/other"
    mounted = _Cluster(spark, {storage.CHECKPOINT_CONF: str(tmp_path)}, f"file:{tmp_path}/1-2")
    assert storage.scratch_dir(mounted) == f"file://{tmp_path}"
    assert list((tmp_path / "adsift").iterdir()) == []


def test_a_folder_that_only_one_machine_sees_is_refused(spark, tmp_path):
    """Here no task's rows can be read again."""

    class Elsewhere(_Cluster):
        def __init__(self, *args):
            super().__init__(*args)
            self.read = type("Read", (), {
                "schema": lambda self, _: self, "parquet": lambda self, _: spark.range(1),
            })()

    with pytest.raises(ValueError, match="share"):
        storage.scratch_dir(Elsewhere(spark, {}, f"file:{tmp_path}/1-2"))


def test_first_copies_are_numbered_in_file_order(spark, tmp_path):
    """Files of different sizes, read in splits of any size, copies near and far."""
    draw = random.Random(6)
    titles = [f"title {draw.randint(0, 400)}" for _ in range(1500)] + [None, None]
    for name, a, b in (("a", 0, 40), ("b", 40, 1200), ("c", 1200, 1300), ("d", 1300, len(titles))):
        with open(tmp_path / f"{name}.csv", "w") as f:
            f.write("Job Title,Company Name\n")
            f.writelines(f"{'' if t is None else t},x\n" for t in titles[a:b])
    want = list(dict.fromkeys(titles))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1k", "7k", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = postings.scan_postings(spark, str(tmp_path), "csv", keep_order=True)
            unique = postings.dedup_postings(df)
            rows = postings.surrogate_key(unique).orderBy("job_id").collect()
            assert [r["job_id"] for r in rows] == list(range(1, len(want) + 1))
            assert [r["job_title"] for r in rows] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_places_in_parquet_files(spark, tmp_path):
    spark.range(300).withColumn("x", F.col("id") % 50).coalesce(1).write.parquet(str(tmp_path / "p"))
    df = postings.scan_postings(spark, str(tmp_path / "p"), keep_order=True)
    rows = postings.surrogate_key(postings.dedup_postings(df.drop("id"))).orderBy("job_id").collect()
    assert [(r["job_id"], r["x"]) for r in rows] == [(i + 1, i) for i in range(50)]
    # Keys that are there stay, and the place goes.
    assert postings.surrogate_key(df.withColumnRenamed("id", "job_id")).columns == ["job_id", "x"]


@pytest.mark.parametrize("size", ["300b", "4k", "1m"])
def test_records_that_span_lines_and_splits(spark, tmp_path, size):
    """As Spark's own reader, which takes a file as one task, whatever the split size."""
    draw = random.Random(7)
    fields = ["plain", 'say ""hi""', "two\nlines", "a,b", "", "\n\n", "é" * 30, '""', "x\r\ny", "long\nline" * 20]

    def field():
        text = draw.choice(fields)
        return f'"{text}"' if any(c in text for c in ',"\n') or draw.random() < 0.3 else text

    for name, n in (("a", 15), ("b", 1), ("c", 30)):
        with open(tmp_path / f"{name}.csv", "w", newline="") as f:
            f.write('Job Title,"Company\nName",Extra\n')
            f.write("\n".join(f"{name}{i},{field()},{field()}" for i in range(n)) + "\n" * (name == "a"))
    want = spark.read.csv(str(tmp_path), header=True, multiLine=True, escape='"')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = records.read_csv(spark, str(tmp_path), "place")
        rows = got.orderBy("place").collect()
        assert records.csv_records(spark, str(tmp_path)).select("path", "start").distinct().count() > (3 if size[-1] == "b" else 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got.columns[:3] == want.columns
    assert [r["Job Title"] for r in rows] == [f"{f}{i}" for f, n in (("a", 15), ("b", 1), ("c", 30)) for i in range(n)]
    assert sorted(map(str, (tuple(r)[:3] for r in rows))) == sorted(map(str, (tuple(r) for r in want.collect())))


def test_records_that_end_with_both_characters(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'Job Title,Extra\r\n"x\r\ny",\r\nz,1\r\n\r\n')
    rows = records.read_csv(spark, str(tmp_path), "place").orderBy("place").collect()
    assert [tuple(r)[:2] for r in rows] == [("x\r\ny", None), ("z", "1")]
