"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is (rank - 1/2) / rows
of its source. Sorted by fractional rank, every stretch holds the sources in their overall proportions, so
equal cuts give shards that match the mixture, with counts at most one apart (law ``rows``).

Both rankings are exact without putting a source, or the table, into one task: rows are dealt to buckets
of their hash inside the source (and to slices of the fractional rank) of about BUCKET_ROWS rows, however many
there are, ranked there, and shifted by the running count of the buckets before, which is a table of counts
only. How many rows a slice holds follows from the sizes of the sources alone, so rows are shuffled, hashed and
ranked once.

Defined results: a null source is a source of its own; a null text has size 8 and the CRC of the empty text;
equal ids (and wholly equal rows) are ranked in any order among themselves and keep their rows; with fewer
rows than shards the first shards hold one row each; texts of any length count by their bytes and are never
moved; the outputs take the place of columns of their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from versewell.llm.common import others, table

SEED, SHARDS = 42, 24
#: rows of a bucket or slice, about; the most digits of the hash that name a bucket
BUCKET_ROWS, MOST_DIGITS = 50_000, 6


def interleave(df: DataFrame, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Add ``shard`` (from 0) and ``slot`` (gapless from 0 inside each shard)."""
    kept, n = others(df, "shard", "slot"), df.select(key).count()
    digits = next(d for d in range(1, MOST_DIGITS + 1) if d == MOST_DIGITS or n <= BUCKET_ROWS * 16**d)
    shuffled = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    rows = df.withColumn("__hash", shuffled).withColumn("__bucket", F.substring("__hash", 1, digits))
    stratum = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit(""))
    rows = rows.withColumn("__source", stratum)

    counts = rows.groupBy("__source", "__bucket").agg(F.count("*").alias("__n"))
    before = W.partitionBy("__source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(
        "__source", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(W.partitionBy("__source")).alias("__total"),
    )
    in_bucket = F.row_number().over(W.partitionBy("__source", "__bucket").orderBy("__hash", key))
    rows = rows.withColumn("__row", in_bucket).join(counts, ["__source", "__bucket"])
    rows = rows.withColumn("__rank", F.col("__before") + F.col("__row"))
    rows = rows.withColumn("__fraction", (2 * F.col("__rank") - 1) / (2 * F.col("__total")))

    # rank r of t rows is in slice (2 r - 1) S div 2 t; the first rank of slice s is the least r of at least (2 t s + S) / 2 S
    cut = max(1, -(-n // BUCKET_ROWS))
    rows = rows.withColumn("__slice", F.expr(f"(2 * __rank - 1) * {cut} div (2 * __total)"))
    first_of = lambda s: f"(2 * __total * {s} + {3 * cut} - 1) div {2 * cut}"
    sizes = counts.groupBy("__source").agg(F.first("__total").alias("__total"))
    sizes = sizes.withColumn("__k", F.explode(F.expr(f"sequence(0L, least(__total, {cut}) - 1)")))
    some = F.col("__total") >= cut  # else a rank each
    slices = sizes.select(
        F.when(some, F.col("__k")).otherwise(F.expr(f"(2 * __k + 1) * {cut} div (2 * __total)")).alias("__slice"),
        F.when(some, F.expr(f"{first_of('(__k + 1)')} - {first_of('__k')}")).otherwise(1).alias("__m"),
    )
    slices = slices.groupBy("__slice").agg(F.sum("__m").alias("__in_slice"))
    ahead = W.orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)  # a row for each BUCKET_ROWS rows
    slices = slices.select(
        "__slice", F.coalesce(F.sum("__in_slice").over(ahead), F.lit(0)).alias("__ahead"), F.sum("__in_slice").over(W.partitionBy()).alias("__all")
    )
    in_slice = F.row_number().over(W.partitionBy("__slice").orderBy("__fraction", "__source", "__hash", key))
    rows = rows.withColumn("__at", in_slice).join(slices, "__slice")
    place = F.col("__ahead") + F.col("__at") - 1
    rows = rows.withColumn("shard", F.expr(f"int((__ahead + __at - 1) * {shards} div __all)"))
    # the first place of shard s is the least p with p * shards div all = s
    first = F.expr(f"(shard * __all + {shards} - 1) div {shards}")
    return rows.withColumn("slot", (place - first).cast("long")).select(*kept, "shard", "slot")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put all ``documents`` into 24 shards of the same mixture of sources."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return interleave(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )



def _nibble(n: int) -> int:
    for _ in range(4):
        n = n >> 1 ^ 0xEDB88320 if n & 1 else n >> 1
    return n


# CRC-32 by half-bytes, the lower one first
_H = "h[i + 2 - 2 * (i % 2)]"
_CODES = f"list_transform(range(0, len(h)), lambda i: (ascii({_H}) - CASE WHEN {_H} > '9' THEN 55 ELSE 48 END)::BIGINT)"
_FOLD = f"list_reduce({_CODES}, lambda a, b: xor(a >> 4, ({[_nibble(n) for n in range(16)]})[(xor(a, b) & 15) + 1]), 4294967295::BIGINT)"
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, '') AS source, strlen(coalesce(text, '')) + 8 AS size, string_split(hex(encode(coalesce(text, ''))), '') AS h,
         md5(concat_ws(':', doc_id::VARCHAR, '{SEED}')) AS md FROM documents
), crc AS (
  SELECT doc_id, source, size, md, CASE WHEN size = 8 THEN 0 ELSE xor({_FOLD}, 4294967295::BIGINT) END AS text_crc32 FROM d
), f AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY md, doc_id) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY source)) AS fraction FROM crc
), p AS (
  SELECT *, row_number() OVER (ORDER BY fraction, source, md, doc_id) - 1 AS place, count(*) OVER () AS n FROM f
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * {SHARDS} // n)::INT AS shard,
       (row_number() OVER (PARTITION BY place * {SHARDS} // n ORDER BY place) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM p
"""
