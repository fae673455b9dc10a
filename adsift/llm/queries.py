"""The registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adsift.llm import (
    decontamination,
    jaccard_join,
    kneser_ney,
    language_id,
    merkle,
    mixing,
    quality_model,
    quality_rules,
    sharding,
    spelling,
    token_counts,
    url_filter,
    warc,
)
from adsift.llm.common import read_table

#: Words of the language model's longest n-grams.
LM_ORDER = 3

URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def _id_hash():
    """crc32 of the id as text; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = _id_hash() % 4 == 2
    names, prototypes = language_id.fit_prototypes(language_id.training_rows(docs, ~held_out))
    found = language_id.identify(docs, names, prototypes)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_overlaps(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sharded = sharding.assign_shards(docs)
    return sharded.select("doc_id", sharding.row_bytes(sharded).alias("n_bytes"), "shard")


def op5_token_counts(
    spark: SparkSession, sf_dir: str, model: str = "piece_bpe_32k.model"
) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    counted = token_counts.count_tokens(docs, public_tokenizers.path(model))
    return counted.withColumn("over_limit", token_counts.over_limit(F.col("n_tokens")))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return kneser_ney.score_documents(docs, _id_hash() % 10 == 0, order=LM_ORDER)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(read_table(spark, sf_dir, "documents"), words=4, percent=85)


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read_table(spark, sf_dir, "documents"))
    return judged.drop("lang", "source")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"))


def op12_merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.prove_documents(read_table(spark, sf_dir, "documents"))


def op13_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(read_table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_mix_sources,
        op3_decontaminate,
        op4_shards,
        op5_token_counts,
        op6_lm_scores,
        op7_url_filter,
        op8_jaccard_join,
        op9_quality_model,
        op10_quality_rules,
        op11_spelling_variants,
        op12_merkle_proofs,
        op13_warc_revisits,
    )
}
