"""JSON documents, translation lines and feature files: fixed schemas, unreadable input set aside."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versewell.sources.storage import shared_folder

QUIZ = "id long, name string, attempts array<struct<no: long, at: string, overall: long>>, broken string"


def scratch_path(spark: SparkSession) -> str:
    """A new place in the shared checkpoint folder."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def read_json(spark: SparkSession, path: str, schema: str, corrupt: str = "broken", many_lines: bool = False) -> DataFrame:
    """Documents of a fixed schema; those that can't be read are left out."""
    docs = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).option("multiLine", many_lines).json(path)
    return docs.where(F.col(corrupt).isNull()).drop(corrupt)


def last_by_id(lines: DataFrame, key: str, order: str) -> DataFrame:
    """The last line of each id wins."""
    rest = [c for c in lines.columns if c not in (key, order)]
    return lines.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("v")).select(key, "v.*")


def write_features(features: DataFrame, path: str, version: int) -> None:
    features.withColumn("feat_version", F.lit(version)).write.mode("append").partitionBy("feat_version").parquet(path)


def read_features(spark: SparkSession, path: str, version: int) -> DataFrame:
    """Features of the current version only; files of others are not even listed."""
    return spark.read.parquet(path).where(F.col("feat_version") == version).drop("feat_version")
