"""Audio decoding and silence on made signals."""

import struct

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tests.conftest import SMALL
from versewell.functions.trimming import trimmed
from versewell.operators import signals
from versewell.sources import audio


def tone(hz, seconds, rate=8000):
    return 0.5 * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


def test_wav_round_trip(spark, tmp_path):
    x = tone(220, 0.5)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.wav").write_bytes(audio.encode(x, 8000))
    (tmp_path / "bad.wav").write_bytes(b"RIFFnonsense")
    (tmp_path / "other.txt").write_text("x")
    rows = {r.path.rsplit("/")[-1]: r.audio for r in audio.headers(audio.read_wavs(spark, str(tmp_path))).collect()}
    assert rows["bad.wav"] is None and set(rows) == {"x.wav", "bad.wav"}
    assert (rows["x.wav"].sample_rate, rows["x.wav"].n_samples, rows["x.wav"].bits) == (8000, 4000, 16)
    assert np.abs(audio.decode(audio.encode(x, 8000))[0] - x).max() < 1e-4


def test_sample_formats():
    head = lambda kind, channels, bits, data: struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, kind, channels, 8000, 8000 * channels * bits // 8, channels * bits // 8, bits, b"data", len(data)) + data
    half = {(1, 8): bytes([192]), (1, 16): struct.pack("<h", 16384), (1, 24): struct.pack("<i", 1 << 22)[:3], (1, 32): struct.pack("<i", 1 << 30), (3, 32): struct.pack("<f", 0.5)}
    for (kind, bits), sample in half.items():
        x, rate, channels, got = audio.decode(head(kind, 2, bits, sample * 4))
        assert (rate, channels, got) == (8000, 2, bits) and np.allclose(x, [0.5, 0.5])
    assert audio.decode(head(1, 1, 12, b"ab")) is None and audio.decode(b"") is None and audio.decode(None) is None


def noise(seconds, level=1e-4, rate=8000, seed=1):
    return np.random.default_rng(seed).normal(0, level, int(seconds * rate))


def test_trim_is_a_no_op_the_second_time():
    x = np.r_[noise(1), tone(200, 1.0), noise(1, seed=2)]
    y, start, stop, changed = trimmed(x, 8000)
    assert changed and abs(start / 8000 - 0.88) < 0.03 and abs(stop / 8000 - 2.22) < 0.03
    again = trimmed(y, 8000)
    assert not again[3] and again[0] is y
    assert np.allclose(y[200:-200], x[start + 200 : stop - 200]) and y[0] == 0 == y[-1]  # faded where it was cut
    assert not trimmed(np.zeros(8000), 8000)[3] and not trimmed(np.zeros(0), 8000)[3]


def test_clicks_and_rooms_are_no_sound():
    click = np.r_[noise(0.2), 0.5 * np.ones(400), noise(0.8, seed=3), tone(200, 1.0), noise(1, seed=4)]  # 50 ms, then silence
    _, start, _, _ = trimmed(click, 8000)
    assert abs(start / 8000 - (1.05 - 0.12)) < 0.04
    room = np.r_[noise(0.3, 1e-5), noise(1.5, 4e-3), tone(200, 1.0), noise(1.5, 4e-3, seed=5)]  # a dip before a steady room
    _, start, stop, _ = trimmed(room, 8000)
    assert abs(start / 8000 - (1.8 - 0.12)) < 0.05 and abs(stop / 8000 - (2.8 + 0.22)) < 0.05
    one = np.r_[tone(200, 0.3), np.zeros(1600), tone(200, 1.0)]  # a word before a pause is no click
    assert trimmed(one, 8000)[1] == 0


def test_trimmed_recordings(spark, tmp_path):
    x = np.r_[noise(1), tone(200, 1.0), noise(1, seed=2)]
    rows = [(1, audio.encode(x, 8000), [("a", 0.0, 1.5), ("b", 1.5, None)]), (2, b"nonsense", None), (3, audio.encode(tone(200, 1.0), 8000), [])]
    df = spark.createDataFrame(rows, "k int, content binary, chunks array<struct<text string, start double, end double>>")
    got = {r.k: r for r in signals.write_trimmed(df, str(tmp_path / "out"), chunks="chunks").collect()}
    cut = audio.header(got[1].content)["duration"]
    assert got[1].changed and abs(cut - 1.34) < 0.05 and got[2].content == b"nonsense" and not got[2].changed and not got[3].changed
    a, b = got[1].chunks
    assert a.start == 0 and abs(a.end - (1.5 - 0.88)) < 0.03 and b.start == a.end and b.end is None
    assert audio.header(got[3].content)["n_samples"] == 8000


def rss():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_what_is_made_of_a_batch_is_not_held(spark):
    """400 recordings are one batch; each is made into 2 MB."""
    df = spark.range(0, 400, 1, 1).select("id", F.lit(audio.encode(tone(220, 0.1), 8000)).alias("content"))
    made = audio.with_audio(df, "used bigint, made binary", lambda *_: {"used": rss(), "made": b"x" * 2_000_000})
    used = [r.used for r in made.select("audio.used", F.octet_length("audio.made")).collect()]
    assert len(used) == 400 and max(used) - min(used) < 400e6


def test_recordings_of_events_are_as_sung(spark):
    """Slices of a batch hold their own learners' notes, with rests where there were errors."""
    got = {r.recording: audio.decode(r.content)[0] for r in signals.sung(spark, SMALL).collect()}
    notes = {}
    for r in spark.read.parquet(f"{SMALL}/events.parquet").orderBy("ts", "event_id").collect():
        notes.setdefault(r.user_id, []).append((100 + min(r.value, 400), 0.0 if r.event_type == "error" else 0.5))
    assert set(got) == set(notes)
    for learner, said in notes.items():
        hz, loud = (np.repeat([n[k] for n in said], signals.PART) for k in (0, 1))
        assert np.abs(got[learner] - np.sin(np.cumsum(hz) * (2 * np.pi / signals.RATE)) * loud).max() < 1e-4


def test_trimmed_audio_of_events(spark):
    """Every recording is written once; a transcript of the whole ends with the cut recording."""
    rows = signals.q_trimmed_audio(spark, SMALL).collect()
    trim = {r.recording: r for r in signals.q_trim(spark, SMALL).collect()}
    assert sorted(r.recording for r in rows) == sorted(trim)
    for r in rows:
        t = trim[r.recording]
        assert r.changed == t.changed and abs(r.duration - (t.stop - t.start)) < 2e-4 and abs(r.stop - r.duration) < 2e-4


def test_made_recordings_are_headed_in_the_pass_that_makes_them(spark, capsys):
    r = audio.headers(signals.sung(spark, SMALL), carry=True)
    r.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1 and r.columns == ["recording", "content", "audio"]
    plain = {x.recording: (x.content, x.audio) for x in audio.headers(signals.sung(spark, SMALL)).collect()}
    assert {x.recording: (x.content, x.audio) for x in r.collect()} == plain
    odd = spark.createDataFrame([(1, b"nonsense"), (2, None)], "k int, content binary")
    assert [(x.k, x.content, x.audio) for x in audio.headers(odd, carry=True).orderBy("k").collect()] == [(1, b"nonsense", None), (2, None, None)]


def test_written_recordings_stand_in_small_groups(spark, tmp_path):
    rng = np.random.default_rng(3)
    files = [audio.encode(rng.uniform(-0.5, 0.5, 100_000), 8000) for _ in range(10)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(files)], "k int, content binary").coalesce(1)
    many = df.crossJoin(spark.range(0, 20, 1, 1)).select((F.col("k") * 20 + F.col("id")).alias("k"), "content")  # 40 MB
    assert signals.write_trimmed(many, str(tmp_path / "out")).count() == 200
    meta = [pq.read_metadata(f) for f in (tmp_path / "out").glob("*.parquet")]
    groups = [m.row_group(g) for m in meta for g in range(m.num_row_groups)]
    sizes = [(g.num_rows, g.total_byte_size) for g in groups]
    assert sum(n for n, _ in sizes) == 200 and max(x for _, x in sizes) < 25e6, sizes
