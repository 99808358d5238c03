"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import (
    chat, classifier, clusters, decontaminate, importance, jaccard, language, mixing, quality, secrets, sharding, substrings, warc,
)
from kbspark.llm.common import scan


def op1_warc(spark: SparkSession, root: str) -> DataFrame:
    return warc.archived_pages(scan(spark, root, "pages", "page_id", "url", "html"), min_bytes=0)


def op2_quality(spark: SparkSession, root: str) -> DataFrame:
    return quality.judge(scan(spark, root, "documents", "doc_id", "text", "lang", "source"))


def op3_secrets(spark: SparkSession, root: str) -> DataFrame:
    return secrets.report(scan(spark, root, "documents", "doc_id", "text"))


def op4_jaccard(spark: SparkSession, root: str) -> DataFrame:
    return jaccard.similarity_groups(scan(spark, root, "documents", "doc_id", "text"))


def op5_mixing(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mixed(scan(spark, root, "documents", "doc_id", "text", "source"))


def op6_substrings(spark: SparkSession, root: str) -> DataFrame:
    return substrings.report(scan(spark, root, "documents", "doc_id", "text"))


def op7_classifier(spark: SparkSession, root: str) -> DataFrame:
    return classifier.classify(
        scan(spark, root, "documents", "doc_id", "text"), scan(spark, root, "labels", "doc_id", "quality"))


def op8_sharding(spark: SparkSession, root: str) -> DataFrame:
    return sharding.shard(scan(spark, root, "documents", "doc_id", "text"))


def op9_chat(spark: SparkSession, root: str) -> DataFrame:
    return chat.formatted_conversations(scan(spark, root, "conversations", "conv_id", "turn", "role", "text"))


def op10_decontamination(spark: SparkSession, root: str) -> DataFrame:
    return decontaminate.report(
        scan(spark, root, "documents", "doc_id", "text"), scan(spark, root, "benchmark", "item_id", "text"))


def op11_importance(spark: SparkSession, root: str) -> DataFrame:
    return importance.resample(
        scan(spark, root, "documents", "doc_id", "text"), scan(spark, root, "benchmark", "text")).select(
        *[F.col(c).cast("long").alias(c) for c in ("doc_id", "n_features", "weight", "score", "rank")])


def op12_clusters(spark: SparkSession, root: str) -> DataFrame:
    return clusters.cluster(scan(spark, root, "embeddings", "vec_id", "embedding"))


def op13_language(spark: SparkSession, root: str) -> DataFrame:
    return language.identify(scan(spark, root, "documents", "doc_id", "text", "lang"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_quality": op2_quality,
    "op3_secrets": op3_secrets,
    "op4_jaccard": op4_jaccard,
    "op5_mixing": op5_mixing,
    "op6_substrings": op6_substrings,
    "op7_classifier": op7_classifier,
    "op8_sharding": op8_sharding,
    "op9_chat": op9_chat,
    "op10_decontamination": op10_decontamination,
    "op11_importance": op11_importance,
    "op12_clusters": op12_clusters,
    "op13_language": op13_language,
}
