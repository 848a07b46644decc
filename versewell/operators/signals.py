"""Recordings as files: headers, identity and silence. Each is one Arrow pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versewell.functions.slices import inside, sliced
from versewell.functions.trimming import trimmed
from versewell.plans import views as V
from versewell.sources import audio as A
from versewell.sources.documents import scratch_path

RATE, PART = 8000, 320  # samples of one event's tone
NOTES_BYTES = 1 << 18  # of events whose recordings are made together: their sound takes twenty times as many


def sung(spark: SparkSession, d: str) -> DataFrame:
    """A recording per learner, made of their events: each sounds for 40 ms at a pitch and loudness from its value."""
    e = V.table(spark, d, "events")
    notes = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value", (F.col("event_type") == "error").alias("rest"))))

    def run(batch: pa.Array) -> pa.Array:
        each, places = inside(batch)
        hz = 100 + np.minimum(each.field("value").to_numpy(zero_copy_only=False), 400)
        loud = np.where(each.field("rest").fill_null(False).to_numpy(zero_copy_only=False), 0.0, 0.5)
        out = []
        for a, b in places:
            phase = np.cumsum(np.repeat(hz[a:b], PART)) * (2 * np.pi / RATE)
            out.append(A.encode(np.sin(phase) * np.repeat(loud[a:b], PART), RATE))
        return pa.array(out, pa.binary())

    made = sliced(run, "binary", "n", most=NOTES_BYTES)
    return e.groupBy("user_id").agg(notes.alias("n")).select(F.col("user_id").alias("recording"), made.alias("content"))


def q_wav_corpus(spark: SparkSession, d: str) -> DataFrame:
    return A.headers(sung(spark, d)).select("recording", "audio.*")


def q_audio_identity(spark: SparkSession, d: str) -> DataFrame:
    """Recordings by the hash of their samples."""
    return sung(spark, d).select("recording", A.identity(F.col("content")).alias("h")).groupBy("h").agg(F.min("recording").alias("recording"), F.count("*").alias("copies")).drop("h")


TRIMMED = "start double, stop double, removed_start double, removed_end double, changed boolean, content binary"


def trim_silence(recordings: DataFrame, content: str = "content", out: str = "trimmed") -> DataFrame:
    """Add ``out``: the part with sound in seconds, what was cut, whether anything was, and the new file."""

    def job(x, rate, channels, bits):
        y, start, stop, changed = trimmed(x, rate)
        return {"start": start / rate, "stop": stop / rate, "removed_start": start / rate, "removed_end": (len(x) - stop) / rate, "changed": changed, "content": A.encode(y, rate)}

    return A.with_audio(recordings, TRIMMED, job, content, out)


#: A row is a file: writers hold a group of rows and readers thousands of rows of a group, so groups are kept small.
SMALL_GROUPS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 10}


def write_trimmed(recordings: DataFrame, path: str, content: str = "content", chunks: str | None = None) -> DataFrame:
    """Write recordings without their silence as Parquet and read them back: content, and with ``chunks``
    (array<struct<text, start, end>>) their times moved by what was cut, kept inside the new length."""
    t = trim_silence(recordings, content)
    cut, length = F.col("trimmed.removed_start"), F.col("trimmed.stop") - F.col("trimmed.start")
    inside = lambda v: F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(length, v - cut)))
    if chunks:
        t = t.withColumn(chunks, F.transform(chunks, lambda c: F.struct(c["text"].alias("text"), inside(c["start"]).alias("start"), inside(c["end"]).alias("end"))))
    kept = [c for c in recordings.columns if c != content]
    t.select(*kept, F.coalesce("trimmed.content", content).alias(content), F.coalesce("trimmed.changed", F.lit(False)).alias("changed")).write.options(**SMALL_GROUPS).parquet(path)
    return recordings.sparkSession.read.parquet(path)


def q_trim(spark: SparkSession, d: str) -> DataFrame:
    """Sounding region of each recording, and the size of the trimmed file."""
    t = trim_silence(sung(spark, d))
    return t.select("recording", *[F.round(f"trimmed.{c}", 4).alias(c) for c in ("start", "stop")], "trimmed.changed", F.octet_length("trimmed.content").cast("long").alias("bytes"))


def q_trimmed_audio(spark: SparkSession, d: str) -> DataFrame:
    """Trimmed recordings with a transcript of one chunk over the whole, written and read back."""
    r = A.headers(sung(spark, d), carry=True).withColumn("chunks", F.array(F.struct(F.lit("all").alias("text"), F.lit(0.0).alias("start"), F.col("audio.duration").alias("end")))).drop("audio")
    t = A.headers(write_trimmed(r, scratch_path(spark), chunks="chunks"))
    return t.select("recording", "changed", F.round("audio.duration", 4).alias("duration"), F.round(F.element_at("chunks", 1)["end"], 4).alias("stop"))


QUERIES = {"src_wav_corpus": q_wav_corpus, "audio_identity": q_audio_identity, "trim_silence": q_trim, "snk_trimmed_audio": q_trimmed_audio}
ORACLE = {"src_wav_corpus": f"SELECT user_id AS recording, {RATE}::INT AS sample_rate, 1 AS channels, 16 AS bits, count(*) * {PART} AS n_samples, count(*) * {PART / RATE}::DOUBLE AS duration FROM events GROUP BY user_id"}
