"""Live takes and practice streams with Structured Streaming.

Each job reads ``events`` as a file stream with event-time watermarks. The queries drain what is there
(``availableNow``) and return the result table, which the shared scratch folder holds; in service the same
transformation feeds a long-running ``writeStream``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versewell.operators import reports as R
from versewell.plans import views as V
from versewell.sources.storage import shared_folder
from versewell.streaming import awards, ordered, restarts

STOP_SECONDS = 1800  # silence that ends a take
DELAY = "1 day"  # how late events may come


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def events_stream(spark: SparkSession, d: str) -> DataFrame:
    """``events`` as a stream; the event time becomes a TIMESTAMP, which watermarks need."""
    there = V.table(spark, d, "events")
    read = spark.readStream.schema(there.schema)
    in_folder = any("/events.parquet/" in path for path in there.inputFiles())
    e = read.parquet(f"{d}/events.parquet") if in_folder else read.option("pathGlobFilter", "events.parquet").parquet(d)
    return e.withColumn("at", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, keys: list[str], mode: str = "update", then: Callable[[], None] | None = None) -> DataFrame:
    """Run the stream over what is there; the last version of each key, by batch. ``then`` adds what a second run reads."""
    spark, top = stream.sparkSession, folder(stream.sparkSession)

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("__batch", F.lit(n)).write.mode("overwrite").parquet(f"{top}/out/batch={n}")  # a batch that runs again replaces itself

    for more in (None, then) if then else (None,):
        if more:
            more()
        stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema, T.StructField("__batch", T.IntegerType())])
    out = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{top}/out")
    if mode == "complete":  # every batch holds the whole table
        newest = out.agg(F.max("__batch")).first()[0]
        return out.where(F.col("__batch") == newest).drop("__batch")
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in keys] or keys), "__batch").alias("__v"))
    return last.select(*keys, "__v.*") if len(stream.columns) > len(keys) else last.select(*keys)


def _text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def q_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Takes cut where a learner is silent for half an hour."""
    s = events_stream(spark, d).withWatermark("at", "30 days").groupBy("user_id", F.session_window("at", f"{STOP_SECONDS} seconds").alias("w"))
    # a session that grows is written again under a new start or end: complete mode replaces the whole table
    out = s.agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "events", "total")
    done = drain(out, ["user_id", "start"], "complete")
    return done.select("user_id", _text(F.col("start")).alias("start"), "events", "total")


def q_period_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and per sliding week."""
    e = events_stream(spark, d).withWatermark("at", "30 days")
    day = drain(e.groupBy(F.window("at", "1 day").alias("w")).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("u")).select(F.col("w.start").alias("start"), "n"), ["start"])
    week = drain(e.groupBy(F.window("at", "7 days", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n"), ["start"])
    return day.select(F.lit("day").alias("period"), _text(F.col("start")).alias("start"), "n").unionByName(week.select(F.lit("week").alias("period"), _text(F.col("start")).alias("start"), "n"))


def q_unsure_confirm(spark: SparkSession, d: str) -> DataFrame:
    """Unsure slips that a click of the same take confirms within two minutes: a join of two streams."""
    e = events_stream(spark, d)
    slips = e.where("event_type = 'error'").select(F.col("user_id").alias("take"), F.col("event_id").alias("slip"), F.col("at").alias("slip_at")).withWatermark("slip_at", "1 hour")
    clicks = e.where("event_type = 'click'").select(F.col("user_id").alias("tk"), F.col("event_id").alias("click"), F.col("at").alias("click_at")).withWatermark("click_at", "1 hour")
    on = (F.col("take") == F.col("tk")) & F.expr("click_at BETWEEN slip_at - INTERVAL 2 MINUTES AND slip_at + INTERVAL 2 MINUTES")
    return drain(slips.join(clicks, on).select("take", "slip", "click"), ["take", "slip", "click"], "append").distinct()


def folded(spark: SparkSession, d: str, rows: DataFrame, job: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """Answers of an ordered fold over all of a finite stream: then time passes, so that the last rows are folded, too."""
    seen, tick = ordered.with_ticks(rows, f"{folder(spark)}/ticks")
    last = V.table(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp")) + F.expr("INTERVAL 400 DAYS")).first()[0]
    return drain(job(seen), keys, "append", then=lambda: tick(last))


def q_pace_profile(spark: SparkSession, d: str) -> DataFrame:
    """Running mean pace of each learner as takes close, depth capped at 20; the state is two numbers."""

    def step(user, now, row):
        mean, n = now
        mean, n = mean + (row.values[0] - mean) / min(n + 1, 20), n + 1
        return (mean, n), [(user, n, mean)]

    rows = events_stream(spark, d).where("event_type = 'purchase'").select("user_id", "event_id", "at", "value")
    out = folded(spark, d, rows, lambda r: ordered.fold(r, "user_id", ["value"], "user_id long, n long, pace double", (0.0, 0), step, DELAY), ["user_id", "n"])
    return out.groupBy("user_id").agg(F.round(F.max_by("pace", "n"), 6).alias("pace"), F.max("n").alias("n"))


def q_ear(spark: SparkSession, d: str) -> DataFrame:
    """Position in a plan of 32 syllables: a long pause past three quarters completes, a very long one stops the take."""

    def step(user, now, row):
        count, last, items = now
        at = row.at
        pause = at - last if last else 0.0
        said = None
        if count and pause >= 14400:
            said = (user, items, "partial" if count < 16 else "complete", "stop", count)
        elif count >= 24 and pause >= 1800:
            said = (user, items, "complete", "pause" if count >= 30 else "dropped", count)
        if said:
            count, items = 0, items + 1
        return (count + 1 + int(row.values[0] // 50), at, items), [said] if said else []

    rows = events_stream(spark, d).select("user_id", "event_id", "at", "value")
    out = "user_id long, item long, state string, reason string, heard long"
    return folded(spark, d, rows, lambda r: ordered.fold(r, "user_id", ["value"], out, (0, 0.0, 0), step, DELAY), ["user_id", "item"])


RISE = 2.5  # dB between a nucleus and the dips around it


def nucleus(now: tuple[float, float, bool, int], level: float) -> tuple[tuple[float, float, bool, int], bool]:
    """Follow the loudness of a take: (dip, peak, rising, count). A nucleus counts when the level has fallen from it."""
    dip, peak, rising, count = now
    if rising:
        peak = max(peak, level)
        if level <= peak - RISE:
            return (level, level, False, count + 1), True
        return (dip, peak, True, count), False
    dip = min(dip, level)
    return (dip, level, level >= dip + RISE, count), False


def q_syllables(spark: SparkSession, d: str) -> DataFrame:
    """Syllable nuclei of each take as they pass, and the pause before each."""
    import math

    def step(user, now, row):
        *levels, last = now
        at = row.at
        new, counted = nucleus(tuple(levels), 20 * math.log10(max(row.values[0], 0.01) / 100))
        return (*new, at), [(user, new[3], round(at - last, 3) if last else 0.0)] if counted else []

    rows = events_stream(spark, d).select("user_id", "event_id", "at", "value")
    job = lambda r: ordered.fold(r, "user_id", ["value"], "user_id long, nucleus long, pause double", (0.0, 0.0, False, 0, 0.0), step, DELAY)
    return folded(spark, d, rows, job, ["user_id", "nucleus"])


def q_stalls(spark: SparkSession, d: str) -> DataFrame:
    """Slips of the live take: a stall for each pāda of eight syllables in which the learner paused too long, once."""

    def step(user, now, row):
        count, last, stalled = now
        at = row.at
        pada = count // 8
        stall = bool(last) and at - last >= 3600 and count % 8 != 0 and stalled != pada
        return (count + 1, at, pada if stall else stalled), [(user, pada, "stall", count)] if stall else []

    rows = events_stream(spark, d).select("user_id", "event_id", "at", "value")
    job = lambda r: ordered.fold(r, "user_id", [], "user_id long, pada long, kind string, count long", (0, 0.0, -1), step, DELAY)
    return folded(spark, d, rows, job, ["user_id", "pada"])


PLAN, FRAMES, LONG_PAUSE = [8, 8, 8, 8], 4, 12 * 3600  # akṣaras of a text's pādas, frames of a template, a pause in seconds


def signature(kind: int, value: float) -> np.ndarray:
    """Twelve cepstra that stand for an event: its kind's, and a little of its value."""
    return np.cos(np.arange(1, 13) * (kind + 2) * 1.3) * 6 + 0.1 * np.sin(np.arange(1, 13) * value)


def q_restarts(spark: SparkSession, d: str) -> DataFrame:
    """Events of a learner as the frames of a take, an akṣara each; each kind of event opens one pāda of the text."""
    kinds = F.array_position(F.array(*[F.lit(k) for k in ("signup", "purchase", "view", "click", "error")]), F.col("event_type"))
    frame = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda c: F.cos(c * (kinds + 2) * 1.3) * 6 + 0.1 * F.sin(c * F.col("value")))
    rows = events_stream(spark, d).select(F.col("user_id").alias("take"), "event_id", "at", frame.alias("frame"), F.lit(1).alias("aksharas"))
    centre = np.mean([signature(k, 0) for k in range(1, 6)], 0)
    templates = [(k, np.stack([signature(k, 0) - centre])) for k in range(1, 5)]
    known = spark.sparkContext.broadcast(Fixed((templates, 9.0, PLAN, 0)))
    job = lambda r: restarts.restarts(r, known, LONG_PAUSE, FRAMES, 1, delay=DELAY)
    return folded(spark, d, rows, job, ["take", "at"]).withColumn("at", F.round("at", 3))


class Fixed:
    """The same text for every take."""

    def __init__(self, value: tuple):
        self.value = value

    def __call__(self, take: int) -> tuple:
        return self.value


def q_award_badges(spark: SparkSession, d: str) -> DataFrame:
    """Awards over a stream of quiz attempts, in four batches: only what is new or raised in each."""
    top = folder(spark)
    h = R.qualified(R.history(spark, d).withColumn("quiz", F.col("quiz") % 3), R.LEAST_STAND_IN)
    h = h.select("learner", "quiz", "day", F.col("at").cast("timestamp").alias("at"), "assessment").withColumn("part", F.ntile(4).over(R.W.partitionBy("learner").orderBy("at", "assessment")))
    for k in range(1, 5):
        h.where(F.col("part") == k).drop("part").coalesce(1).write.parquet(f"{top}/in/part={k}")
    seen = spark.readStream.schema(awards.COUNTED).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{top}/in")
    seen.writeStream.foreachBatch(awards.award(top)).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    return awards.awards(top, spark).select("learner", "quiz", "level", "change", "from_level")


QUERIES = {"stream_restart_detection": q_restarts, "stream_award_badges": q_award_badges, "stream_syllable_counter": q_syllables, "stream_ear_slips": q_stalls, "stream_session_takes": q_sessions, "stream_period_counts": q_period_counts, "stream_unsure_confirm": q_unsure_confirm, "stream_pace_profile": q_pace_profile, "stream_ear_decisions": q_ear}
_FMT = "'%Y-%m-%d %H:%M:%S'"
ORACLE = {
    "stream_ear_slips": """WITH e AS (SELECT user_id, row_number() OVER w - 1 AS count, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS pause FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count // 8 AS pada, 'stall' AS kind, min(count) AS count FROM e WHERE pause >= 3600000000 AND count % 8 <> 0 GROUP BY user_id, count // 8""",
    "stream_session_takes": f"""WITH e AS (SELECT user_id, ts, value, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < {STOP_SECONDS}000000 THEN 0 ELSE 1 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, strftime(min(ts), {_FMT}) AS start, count(*) AS events, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""",
    "stream_period_counts": f"""SELECT 'day' AS period, strftime(date_trunc('day', ts)::TIMESTAMP, {_FMT}) AS start, count(*) AS n FROM events GROUP BY ALL
UNION ALL SELECT 'week', strftime((date_trunc('day', ts) - to_days(k::INT))::TIMESTAMP, {_FMT}), count(*) FROM events, range(7) r(k) GROUP BY ALL""",
    "stream_unsure_confirm": """SELECT s.user_id AS take, s.event_id AS slip, c.event_id AS click FROM events s JOIN events c ON s.user_id = c.user_id AND c.ts BETWEEN s.ts - INTERVAL 2 MINUTE AND s.ts + INTERVAL 2 MINUTE WHERE s.event_type = 'error' AND c.event_type = 'click'""",
    "stream_pace_profile": """WITH RECURSIVE s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase'), p AS (SELECT user_id, n, value AS mean FROM s WHERE n = 1 UNION ALL SELECT s.user_id, s.n, p.mean + (s.value - p.mean) / least(s.n, 20) FROM p JOIN s ON s.user_id = p.user_id AND s.n = p.n + 1)
SELECT user_id, round(arg_max(mean, n), 6) AS pace, max(n) AS n FROM p GROUP BY user_id""",
}
