"""A training-corpus pipeline of five stages; each is written as Parquet and read again as the next one's input.

Columns besides those of `documents` are carried through every stage unchanged, whatever their names;
only `topic`, `n_tokens`, `weight`, `probability` and `kept` are the last stage's own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, jaccard_join, mixing, quality_mil, secret_scan
from lodestar.llm.common import shared_dir, stored, table


def _row_key() -> Column:
    """Tells rows apart that differ in doc_id or text, null or not. Rows that agree in both are one document."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull())


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(docs: DataFrame) -> DataFrame:
    """`docs` with every column that is not one of OWN under a plain name of its own, so that none meets a column of an operator."""
    return docs.toDF(*(c if c in OWN else f"carried{i}" for i, c in enumerate(docs.columns)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from their own labels that are not held out.

    Null and empty texts are scored like any other; rows without doc_id too, but nothing is learned
    from them. Repeated rows get one score each. A score at the threshold is accepted.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality_mil.fit(docs, labels.where(~quality_mil.held_out()))
    apart = _apart(docs)
    return quality_mil.score(apart, model).where("predicted = 1").select(apart.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: the one with the smallest doc_id; of several with that id (or none with an id) one by hash.

    Rows without doc_id take part like all others; of rows that agree in doc_id and text one stays.
    Null and empty texts and texts without words are linked with nothing and stay.
    """
    apart = _apart(docs)
    keyed = apart.withColumn("_key", _row_key())
    ids = keyed.groupBy("_key").agg(F.first("doc_id").alias("id"))
    found = jaccard_join.components(keyed.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "component_id").distinct()
    named = stored(found.join(ids, "_key"), "pipeline-components")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_key")).alias("x")).select(F.col("x._key").alias("_key"))
    gone = named.select("_key").join(first, "_key", "left_anti")
    return keyed.join(gone, "_key", "left_anti").dropDuplicates(["_key"]).select(apart.columns).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark passages. Rows without doc_id are judged like all others; null and empty texts have no words and stay; repeated rows go or stay together."""
    apart = _apart(docs)
    keyed = apart.withColumn("_key", _row_key())
    found = decontaminate.match(keyed.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = found.where(decontaminate.contaminated()).select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(bad, "_key", "left_anti").select(apart.columns).toDF(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts redacted, and runs that were not read to the end. Null and empty texts and texts without secrets stay as they are; repeated rows are each redacted."""
    return secret_scan.redact(_apart(docs)).toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn to the raked weights, with topic, n_tokens, weight and probability. Null and empty texts are drawn like their cell; rows with one doc_id together."""
    docs = docs.drop("topic", "n_tokens", "weight", "probability", "kept")
    return mixing.weigh(_apart(docs)).where("kept").drop("kept").toDF(*docs.columns, "topic", "n_tokens", "weight", "probability")


STAGES = [
    ("quality classifier", quality),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("mixing to target weights", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}/{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
