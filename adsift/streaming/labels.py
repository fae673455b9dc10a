"""Labelling postings as they arrive.

The rules look at one posting at a time, so the batch operators run unchanged
on a stream and keep no state; only the file source and sink differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from adsift.operators import labeling
from adsift.sources import postings
from adsift.sources.storage import scratch_dir


def read_postings_stream(
    spark: SparkSession, path: str, schema: T.StructType = postings.POSTING_SCHEMA
) -> DataFrame:
    """New parquet files of a folder, as a stream of postings."""
    return spark.readStream.schema(schema).parquet(path)


def label_stream(stream: DataFrame) -> DataFrame:
    return labeling.tune_label(labeling.label_postings(postings.tolerant_schema(stream)))


def write_labelled_stream(stream: DataFrame, out: str, name: str) -> StreamingQuery:
    """Append labelled postings; stops once all present files are done."""
    log = f"{scratch_dir(stream.sparkSession)}/adsift/streams/{name}"
    return (
        label_stream(stream)
        .writeStream.format("parquet")
        .option("checkpointLocation", log)
        .trigger(availableNow=True)
        .start(out)
    )
