"""Badges as attempts come in: a versioned table that a batch, run again, writes the same once more.

The table holds the days that count (a learner, a quiz, a day, its first attempt), cut into buckets of learners. A batch
reads the newest version before its own of the buckets that its attempts touch and writes these buckets as its own
version; what is new or raised against that version goes out under the batch's number. So a batch that is run again
finds the same table, and writes and says the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versewell.operators import reports as R

BUCKETS = 16
COUNTED = "learner long, quiz long, day date, at timestamp, assessment long"
AWARD = "learner long, quiz long, level int, change string, from_level int"


def _latest(counted: DataFrame, before: int) -> DataFrame:
    """Newest version under ``before`` of each bucket; which versions there are is read from the folders' names."""
    there = counted.where(F.col("version") < before)
    newest = there.select("bucket", "version").distinct().groupBy("bucket").agg(F.max("version").alias("version"))
    return there.join(F.broadcast(newest), ["bucket", "version"])


def counting(attempts: DataFrame) -> DataFrame:
    """Attempts that count: one of each learner, quiz and day, the earliest."""
    first = F.row_number().over(W.partitionBy("learner", "quiz", "day").orderBy("at", "assessment"))
    return attempts.withColumn("__n", first).where("__n = 1").drop("__n")


def levels(counted: DataFrame) -> DataFrame:
    n = F.row_number().over(W.partitionBy("learner", "quiz").orderBy("day"))
    return R.badge_levels(counted.withColumn("n", n))


def award(folder: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls with qualifying attempts (learner, quiz, day, at, assessment)."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kind = T.StructType([*T.StructType.fromDDL(COUNTED), *T.StructType.fromDDL("bucket int, version long")])
        spark.createDataFrame([], kind).write.mode("ignore").partitionBy("bucket", "version").parquet(f"{folder}/counted")
        cols = [c.split()[0] for c in COUNTED.split(", ")]
        new = batch.select(*cols).withColumn("bucket", F.pmod(F.xxhash64("learner"), F.lit(buckets)).cast("int"))
        touched = F.broadcast(new.select("bucket").distinct())  # at most ``buckets`` rows
        old = _latest(spark.read.schema(kind).parquet(f"{folder}/counted"), number).join(touched, "bucket").select(*cols, "bucket")
        now = counting(old.unionByName(new)).withColumn("version", F.lit(number).cast("long"))
        # only this batch's own folders are replaced, also when it runs again
        now.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(f"{folder}/counted")
        written = spark.read.schema(kind).parquet(f"{folder}/counted").where(F.col("version") == number)
        changed = R.diff_badges(levels(old), levels(written)).select("learner", "quiz", "level", "change", "from_level")
        changed.write.mode("overwrite").parquet(f"{folder}/awards/batch={number}")

    return run


def badges(folder: str, spark) -> DataFrame:
    """All badges as they stand."""
    kind = T.StructType([*T.StructType.fromDDL(COUNTED), *T.StructType.fromDDL("bucket int, version long")])
    return levels(_latest(spark.read.schema(kind).parquet(f"{folder}/counted"), 1 << 62))


def awards(folder: str, spark) -> DataFrame:
    """Every award with the batch that gave it."""
    return spark.read.schema(T.StructType([*T.StructType.fromDDL(AWARD), T.StructField("batch", T.IntegerType())])).parquet(f"{folder}/awards")
