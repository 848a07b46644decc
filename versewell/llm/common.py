"""What the training-data operators share: table access, scratch tables and small SQL fragments."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versewell.sources.storage import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released(batches: Iterator) -> Iterator:
    """The batches; memory that Arrow keeps for later goes back after each, as Python workers live on from job to job."""
    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()


class Scratch:
    """Parquet tables in the shared folder: they cut lineage and outlive lost executors.

    Tables that have served are emptied by ``drop``; those that a lazy result still reads stay, and go with
    the folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.written: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, *partitions: str) -> DataFrame:
        path = f"{self.base}/{len(self.written)}"
        df.write.partitionBy(*partitions).parquet(path)
        self.written.append((self.spark.read.parquet(path), path))
        return self.written[-1][0]

    def drop(self, *tables: DataFrame) -> None:
        """Empty tables that no later plan reads: an empty one takes the place of their files."""
        none = self.spark.createDataFrame([], "gone boolean").coalesce(1)
        for df, path in self.written:
            if any(df is x for x in tables):
                none.write.mode("overwrite").parquet(path)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``, equals ``remainder``; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def others(df: DataFrame, *names: str) -> list[Column]:
    """Columns of ``df`` but those that an operator adds under ``names``: its results take their place."""
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in {n.lower() for n in names}]
