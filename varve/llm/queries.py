"""The registered corpus queries, each a thin digest of its operator's output, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm import align, buckets, capfilter, chat, checks, factor, hamming, huffman, langmix, merkle, ngramjoin, shards, tempering, toxic
from varve.llm.common import table
from varve.session import checkpointed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = dict(checks.SQL)


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted, written and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = r"\### Assistant: </turn> ok"  # fixed value: the conversation the contract adds
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(trap).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("t")).select("conv_id", "t.*")
    return chat.read_chats(checkpointed(chat.format_chats(turns.unionByName(extra))))


@query
def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.hilbert_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit(shards.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


@query
def op6_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = tempering.mix_sources(table(spark, sf_dir, "documents"), repeat_limit=1.25)
    return mixed.select("row.doc_id", "row.source", F.col("tokens").alias("n_tokens"), F.round("weight", 9).alias("weight"), "epoch", "block", "block_rank")


@query
def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.pack_buckets(table(spark, sf_dir, "documents"))


@query
def op10_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = huffman.scratch_path(spark)
    huffman.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return huffman.read_tokens(spark, path)


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxic.fit(*toxic.training_sample(docs, table(spark, sf_dir, "labels")))
    scored = toxic.score_texts(docs, model, keep=["doc_id"]).select("row.doc_id", "score")
    return scored.select("doc_id", toxic.is_held_out().alias("held_out"), "score", (F.col("score") >= toxic.THRESHOLD).cast("int").alias("predicted"))


@query
def op5_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langmix.identify(docs.select("doc_id", "text"), langmix.learn(docs.select("doc_id", "text", "lang")), keep=["doc_id"]).select("row.doc_id", "lang", "score", "mix")
    return found.select("doc_id", toxic.is_held_out().alias("held_out"), F.col("lang").alias("lang_pred"), "score", F.size("mix").alias("n_langs"))


@query
def op9_cap_filter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilter.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op4_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest sign codes of every vector whose id is divisible by 50, itself included."""
    codes = hamming.sign_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return hamming.top_k(codes.filter(F.col("id") % 50 == 0), codes, k=10).select("query_id", "vec_id", "distance", "rank")


@query
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document by crc32 is read back with its A-Z lower-cased."""
    fields = ("doc_id", "source", "lang", "n_chars")
    low = F.translate("text", checks.UPPER, checks.UPPER.lower())
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.record_hash(*fields, low))
    proofs = merkle.manifest(table(spark, sf_dir, "documents"), merkle.record_hash(*fields, "text"), F.col("lang"), "doc_id", changed)
    return proofs.select("row.doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query
def op12_factor_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = factor.fit(*factor.training_examples(docs, table(spark, sf_dir, "labels")))
    scored = factor.score_texts(docs, model, keep=["doc_id"]).select("row.doc_id", "score")
    return scored.select("doc_id", factor.is_held_out().alias("held_out"), "score", (F.col("score") >= factor.THRESHOLD).cast("int").alias("predicted"))


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
