"""From raw documents to packed batches: STAGES in order, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm import buckets, langmix, ngramjoin, tempering, toxic
from varve.llm.common import table
from varve.llm.merkle import numbered
from varve.session import checkpointed

REPEAT_LIMIT = 1.25


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window scores below the threshold; learned from the labelled ones of ``docs``."""
    model = toxic.fit(*toxic.training_sample(docs, table(spark, sf_dir, "labels")))
    return toxic.score_texts(docs, model).filter(F.col("score") < toxic.THRESHOLD).select("row.*")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which some learned language is found; texts without letters go."""
    return langmix.identify(docs, langmix.learn(docs)).filter(F.col("lang") != langmix.UNKNOWN).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that n-gram links connect: that of the least key. Rows without words are in no group and stay.

    A row's key is its doc_id; rows whose doc_id is null, negative or repeated, which name no row, have
    negative keys of their own, numbered in order of doc_id and text.
    """
    repeated = checkpointed(docs.filter("doc_id >= 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    named = rows.filter("doc_id >= 0").join(repeated, "doc_id", "left_anti").withColumn("key", F.col("doc_id"))
    others = rows.filter("doc_id is null or doc_id < 0").unionByName(rows.join(repeated, "doc_id", "left_semi"))
    spread = F.monotonically_increasing_id()  # so that a row repeated without end is not one task
    others = numbered(checkpointed(others.withColumn("tree", F.lit("")).withColumn("spread", spread)), ["doc_id", "text", "spread"]).withColumn("key", F.col("pos") - F.col("n"))
    keyed = named.select("key", "text", "row").unionByName(others.select("key", "text", "row"))
    linked = ngramjoin.link_documents(keyed.select(F.col("key").alias("doc_id"), "text"))
    gone = linked.filter("component_id < doc_id").select(F.col("doc_id").alias("key"))
    return keyed.join(gone, "key", "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the tempered mixture of sources takes them."""
    return tempering.mix_sources(docs, repeat_limit=REPEAT_LIMIT).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches of all that is left."""
    return buckets.pack_buckets(docs)


STAGES = [("toxicity", drop_toxic), ("language", keep_languages), ("near_copies", drop_near_copies), ("mixture", mix), ("packing", pack)]
# the first two stages are trained models and the third an iterative closure: tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
