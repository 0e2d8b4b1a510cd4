"""Policy index payloads: landed JSON documents of the form ``{"data": [record, ...]}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from claimspark.sources.paths import exists
from claimspark.sources.sinks import write_table

RECORD_FIELDS = [
    "document_id", "document_version", "document_display_id", "title", "document_status", "status",
    "effective_date", "retirement_date", "last_updated", "updated_on", "contractor_name_type", "url",
]
# Numbers in the payload are read as their text.
RECORD = T.StructType([T.StructField(f, T.StringType()) for f in RECORD_FIELDS])
PAYLOAD = T.StructType([T.StructField("data", T.ArrayType(RECORD))])


def _records(payloads: DataFrame, data: Column, policy_type: str) -> DataFrame:
    """One row per record; a payload without a record list stops the job."""
    message = f"CMS returned an invalid {policy_type} policy index."
    checked = F.when(data.isNull(), F.raise_error(F.lit(message)).cast(PAYLOAD["data"].dataType)).otherwise(data)
    return payloads.select(F.inline(checked))


def read_payloads(spark: SparkSession, path: str | list[str], policy_type: str) -> DataFrame:
    """Records of landed payload files; each file is one JSON document."""
    return _records(spark.read.schema(PAYLOAD).option("multiLine", True).json(path), F.col("data"), policy_type)


def parse_payloads(df: DataFrame, column: str, policy_type: str) -> DataFrame:
    """Records of payloads held in a text column."""
    return _records(df, F.from_json(F.col(column), PAYLOAD)["data"], policy_type)


def save_policy_index(index: DataFrame, target: str) -> int:
    return write_table(index, target)


def load_policy_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The saved index, or None when there is none."""
    return spark.read.parquet(path) if exists(spark, path) else None
