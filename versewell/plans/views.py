"""Stand-ins for recitation tables over the driver's star schema, as DataFrames and as DuckDB SQL.

Each view is deterministic; ``sql(body, names...)`` puts the SQL of the named views before a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def half_up(x: Column) -> Column:
    """Rounding of the scores: floor(x + 1/2)."""
    return F.floor(x + 0.5)


def assessments(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    learner = F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey"))
    kind = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "quiz").when(F.col("o_orderpriority") == "5-LOW", "teach").otherwise("evaluation")
    return o.select(
        F.col("o_orderkey").alias("assessment"), learner.alias("learner"), F.col("o_orderdate").alias("at"), F.to_date("o_orderdate").alias("day"),
        kind.alias("kind"), (F.col("o_custkey") % 20).alias("quiz"),
    )


SCORES = ("phoneme", "vowel", "syllable", "emphasis", "pitch", "phrasing", "timing")
LEGACY = ("content", "pronunciation", "dynamics")
_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
SLIPS = ("restart", "stall", "dropped", "skipped", "falseStart", "repeat", "partial")


def items(spark: SparkSession, d: str) -> DataFrame:
    """Items of assessments; ``item`` numbers them inside their assessment by all columns."""
    line = table(spark, d, "lineitem").withColumn("item", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_LINE)))
    legacy = F.col("l_suppkey") % 7 == 0
    new = lambda x: F.when(~legacy, half_up(x))
    old = lambda x: F.when(legacy, half_up(x))
    kind = F.element_at(F.array(*[F.lit(s) for s in SLIPS]), (F.col("l_suppkey") % 7 + 1).cast("int"))
    unsure = F.col("l_linenumber") % 2 == 0
    slips = F.when(F.col("l_returnflag") == "R", F.array(F.struct(kind.alias("kind"), unsure.alias("unsure")))).otherwise(F.array().cast("array<struct<kind:string,unsure:boolean>>"))
    return line.select(
        F.col("l_orderkey").alias("assessment"), "item", F.col("l_partkey").alias("sloka"), (F.col("l_linestatus") == "F").alias("matched"),
        (F.col("l_quantity") >= 50).alias("missing"), new(100 - F.col("l_quantity")).alias("phoneme"), new(100 - F.col("l_discount") * 400).alias("vowel"),
        new(100 - F.col("l_tax") * 500).alias("syllable"), F.when(~legacy, 100 - F.col("l_suppkey") % 40).alias("emphasis"),
        F.when(F.col("l_suppkey") % 5 != 0, 100 - F.col("l_partkey") % 30).alias("pitch"), F.when(~legacy, 100 - F.col("l_partkey") % 50).alias("phrasing"),
        F.when(F.col("l_returnflag") != "N", 100 - F.col("l_suppkey") % 60).alias("timing"), old(100 - F.col("l_quantity")).alias("content"),
        old(100 - F.col("l_discount") * 400).alias("pronunciation"), old(100 - F.col("l_tax") * 500).alias("dynamics"), slips.alias("slips"),
    )


def slokas(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("sloka"), F.col("p_name").alias("name"), F.col("p_brand").alias("folder"), (F.col("p_size") % 18 + 1).alias("chapter"), (F.col("p_partkey") % 40 + 1).alias("verse"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Feature frames: loudness in dB and pitch in semitones (null: unvoiced) by recording and index."""
    e = table(spark, d, "events")
    idx = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rms = 20 * F.log10(F.greatest(F.col("value"), F.lit(0.01)) / 100)
    return e.select(F.col("user_id").alias("recording"), idx.alias("idx"), rms.alias("rms_db"), F.when(F.col("event_type") != "error", 60 + F.col("value") / 10).alias("st"), F.col("event_type").alias("kind"))


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def intervals(spark: SparkSession, d: str) -> DataFrame:
    """Spans of a take: [t0, t1) in seconds since 2024-01-01; kind is the event's."""
    e = table(spark, d, "events")
    t0 = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 1e6
    return e.select(F.col("user_id").alias("take"), F.col("event_id").alias("span"), F.col("event_type").alias("kind"), t0.alias("t0"), (t0 + F.col("value") * 60).alias("t1"), "value")


SQL = {
    "v_assessments": """SELECT o_orderkey AS assessment, CASE WHEN o_custkey % 11 <> 0 THEN o_custkey END AS learner, o_orderdate AS at, o_orderdate::DATE AS day,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'quiz' WHEN o_orderpriority = '5-LOW' THEN 'teach' ELSE 'evaluation' END AS kind, o_custkey % 20 AS quiz FROM orders""",
    "v_items": f"""SELECT l_orderkey AS assessment, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE)}) AS item, l_partkey AS sloka,
  l_linestatus = 'F' AS matched, l_quantity >= 50 AS missing,
  CASE WHEN l_suppkey % 7 <> 0 THEN floor(100 - l_quantity + 0.5)::BIGINT END AS phoneme, CASE WHEN l_suppkey % 7 <> 0 THEN floor(100 - l_discount * 400 + 0.5)::BIGINT END AS vowel,
  CASE WHEN l_suppkey % 7 <> 0 THEN floor(100 - l_tax * 500 + 0.5)::BIGINT END AS syllable, CASE WHEN l_suppkey % 7 <> 0 THEN 100 - l_suppkey % 40 END AS emphasis,
  CASE WHEN l_suppkey % 5 <> 0 THEN 100 - l_partkey % 30 END AS pitch, CASE WHEN l_suppkey % 7 <> 0 THEN 100 - l_partkey % 50 END AS phrasing,
  CASE WHEN l_returnflag <> 'N' THEN 100 - l_suppkey % 60 END AS timing,
  CASE WHEN l_suppkey % 7 = 0 THEN floor(100 - l_quantity + 0.5)::BIGINT END AS content, CASE WHEN l_suppkey % 7 = 0 THEN floor(100 - l_discount * 400 + 0.5)::BIGINT END AS pronunciation,
  CASE WHEN l_suppkey % 7 = 0 THEN floor(100 - l_tax * 500 + 0.5)::BIGINT END AS dynamics,
  CASE WHEN l_returnflag = 'R' THEN ({list(SLIPS)})[l_suppkey % 7 + 1] END AS slip, l_linenumber % 2 = 0 AS unsure FROM lineitem""",
    "v_slokas": "SELECT p_partkey AS sloka, p_name AS name, p_brand AS folder, p_size % 18 + 1 AS chapter, p_partkey % 40 + 1 AS verse FROM part",
    "v_frames": """SELECT user_id AS recording, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, 20 * log10(greatest(value, 0.01) / 100) AS rms_db,
  CASE WHEN event_type <> 'error' THEN 60 + value / 10 END AS st, event_type AS kind FROM events""",
    "v_intervals": """SELECT user_id AS take, event_id AS span, event_type AS kind, (epoch_us(ts) - 1704067200000000) / 1e6 AS t0, (epoch_us(ts) - 1704067200000000) / 1e6 + value * 60 AS t1, value FROM events""",
}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + f"{',' if body.lstrip().startswith(',,') else ''}\n{body.lstrip().removeprefix(',,')}"
