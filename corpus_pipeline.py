"""From raw documents to token ids: classify, drop repeated lines, drop near copies, mix, encode.

Every stage takes NULL ids, sources and texts, repeated rows and empty tables, and keeps the columns of ``documents`` (the last one apart).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimspark.llm.bpe import bpe_encode
from claimspark.llm.common import table
from claimspark.llm.line_dedup import line_dedup
from claimspark.llm.mixing import mixed_documents
from claimspark.llm.ngram_join import one_of_each
from claimspark.llm.quality import fit, score
from claimspark.llm.queries import tokenizer_path
from claimspark.session import materialise


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with the length of the present text, where they have that column."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled documents of ``docs``.

    NULL and empty texts are scored by the bias alone; repeated rows and rows that share an id are judged row by row.
    """
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, keep_text=True).filter("predicted = 1").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one has; rows with a NULL id are one document, the last. A NULL text becomes empty."""
    return _counted(line_dedup(docs).select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near copies, NULL ids last; rows without words all stay."""
    return one_of_each(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document once for each time it is taken, with the words taken then; rows without words are not taken."""
    return _counted(mixed_documents(docs).select(*docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix; a NULL or empty text has none."""
    rows = bpe_encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path())
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_quality), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources), ("BPE encoding and decoding", encode),
]

ORACLE_SQL = None  # the classifier, the draws of the mix and the encoding are not expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
