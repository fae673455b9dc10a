from adsift.plans.queries import labelled, postings
from adsift.streaming.labels import read_postings_stream, write_labelled_stream
from conftest import SMALL


def test_stream_labels_equal_batch_labels(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    postings(spark, SMALL).repartition(3, "job_id").write.parquet(source)
    write_labelled_stream(read_postings_stream(spark, source), out, "t").awaitTermination()
    names = ["job_id", "num_flags", "triggered_rules", "fake_label_tuned"]
    got, batch = spark.read.parquet(out).select(names), labelled(spark, SMALL).select(names)
    assert got.count() == 200 and got.exceptAll(batch).count() == 0

    # A second run finds nothing new.
    write_labelled_stream(read_postings_stream(spark, source), out, "t").awaitTermination()
    assert spark.read.parquet(out).count() == 200
