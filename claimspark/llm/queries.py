"""Registered queries of the corpus operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimspark.llm.alignment import align
from claimspark.llm.ann import nearest
from claimspark.llm.bpe import bpe_encode
from claimspark.llm.common import table
from claimspark.llm.exact_dedup import exact_dedup
from claimspark.llm.line_dedup import line_dedup
from claimspark.llm.merkle import verified_manifest
from claimspark.llm.mixing import mix
from claimspark.llm.ngram_join import ngram_join
from claimspark.llm.quality import fit, held_out, score
from claimspark.llm.sharding import shard
from claimspark.llm.suffix_dedup import suffix_dedup
from claimspark.llm.url_filter import url_filter
from claimspark.llm.warc import round_trip

URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def op1_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter(table(spark, sf, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op2_ann_forest(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe(spark: SparkSession, sf: str) -> DataFrame:
    rows = bpe_encode(table(spark, sf, "documents").select("doc_id", "text"), tokenizer_path(), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join(table(spark, sf, "documents"))


def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents"))


def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = suffix_dedup(table(spark, sf, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_warc(spark: SparkSession, sf: str) -> DataFrame:
    return round_trip(spark, table(spark, sf, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup(table(spark, sf, "documents"))


def op10_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = line_dedup(table(spark, sf, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("line_count").alias("n_lines"), F.col("lines_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op11_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    rows = align(table(spark, sf, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"), digest=True)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op12_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return shard(table(spark, sf, "documents"))


def op13_merkle(spark: SparkSession, sf: str) -> DataFrame:
    return verified_manifest(table(spark, sf, "documents")).drop("steps")


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_ann_forest, op3_bpe, op4_ngram_join, op5_mixing, op6_quality, op7_suffix_dedup, op8_warc, op9_exact_dedup, op10_line_dedup, op11_tokenizer_alignment, op12_sharding, op13_merkle)}
