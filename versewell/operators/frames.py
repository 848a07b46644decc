"""Feature frames and intervals by built-in windows: runs, hysteresis, medians, thresholds, spans.

A recording's frames are one window partition; every job below needs one exchange by recording (or take).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from versewell.plans import views as V


def by_rec():
    return W.partitionBy("recording")


def by_time():
    return by_rec().orderBy("idx")


def nearest_rank(values: Column, p: float) -> Column:
    """sorted[round(p * (n - 1))] of an array, nulls left out."""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    at = (F.floor(p * (F.size(v) - 1) + 0.5) + 1).cast("int")
    return F.when(F.size(v) > 0, F.element_at(v, F.greatest(at, F.lit(1))))


def middle_mean(values: Column) -> Column:
    """Median as the mean of the two middle values."""
    v, n = F.array_sort(F.filter(values, lambda x: x.isNotNull())), None
    n = F.size(v)
    lo, hi = F.element_at(v, F.greatest(F.floor((n + 1) / 2), F.lit(1)).cast("int")), F.element_at(v, F.greatest(F.floor(n / 2) + 1, F.lit(1)).cast("int"))
    return F.when(n > 0, (lo + hi) / 2)


def runs(rows: DataFrame, key: str, idx: str, gap: int = 0, least: int = 1) -> DataFrame:
    """Maximal runs of the given rows (those where a predicate holds), gaps of up to ``gap`` tolerated."""
    w = W.partitionBy(key).orderBy(idx)
    new = F.when(F.col(idx) - F.lag(idx).over(w) > gap + 1, 1).otherwise(0)
    marked = rows.select(key, idx, new.alias("__new")).withColumn("__run", F.sum("__new").over(w))
    found = marked.groupBy(key, "__run").agg(F.min(idx).alias("first"), F.max(idx).alias("last"))
    return found.where(F.col("last") - F.col("first") + 1 >= least).drop("__run")


def hysteresis(rows: DataFrame, key: str, idx: str, level: Column, on: float, off: float) -> DataFrame:
    """``active``: on from the first frame at ``on`` or above until one below ``off``; off before any decision."""
    event = F.when(level >= on, 1).when(level < off, 0)
    state = F.last(event, ignorenulls=True).over(W.partitionBy(key).orderBy(idx).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("active", F.coalesce(state, F.lit(0)) == 1)


def clean_activity(rows: DataFrame, key: str, idx: str, gap: int = 2, least: int = 2) -> DataFrame:
    """Active runs with short gaps filled and short runs dropped."""
    return runs(rows.where("active"), key, idx, gap, least)


def q_reject_silent(spark: SparkSession, d: str) -> DataFrame:
    """Usable or quarantined recordings by active share and peak."""
    f = V.frames(spark, d)
    s = f.groupBy("recording").agg(F.avg(F.when(F.col("rms_db") > -5, 1.0).otherwise(0.0)).alias("active_frac"), F.max("rms_db").alias("peak_db"))
    return s.withColumn("usable", (F.col("active_frac") >= 0.05) & (F.col("peak_db") >= -40))


def q_voice_stats(spark: SparkSession, d: str) -> DataFrame:
    f = V.frames(spark, d)
    a = f.groupBy("recording").agg(F.collect_list("st").alias("st"), F.count("st").alias("voiced"), F.count("*").alias("n"), F.max("rms_db").alias("peak_db"), F.collect_list("rms_db").alias("rms"))
    return a.select(
        "recording", *[nearest_rank(F.col("st"), p).alias(f"st_p{int(p * 100)}") for p in (0.1, 0.5, 0.9)], (nearest_rank(F.col("st"), 0.9) - nearest_rank(F.col("st"), 0.1)).alias("range_st"),
        F.round(F.col("voiced") / F.col("n"), 6).alias("voiced_fraction"), "peak_db", nearest_rank(F.col("rms"), 0.1).alias("floor_db"),
    )


def q_prominence(spark: SparkSession, d: str) -> DataFrame:
    """Loudness and folded pitch, smoothed over seven frames and standardised per recording."""
    p = V.frames(spark, d).withColumn("p", F.col("rms_db") / 6 + F.pmod(F.coalesce("st", F.lit(60)), F.lit(12)) / 3)
    p = p.withColumn("s", F.avg("p").over(by_time().rowsBetween(-3, 3)))
    sd = F.stddev_pop("s").over(by_rec())
    return p.select("recording", "idx", F.round(F.when(sd > 0, (F.col("s") - F.avg("s").over(by_rec())) / sd).otherwise(0.0), 6).alias("z"))


def q_moving_median(spark: SparkSession, d: str) -> DataFrame:
    """Centred moving median of five frames; a null in the centre stays null."""
    near = F.collect_list("st").over(by_time().rowsBetween(-2, 2))
    return V.frames(spark, d).select("recording", "idx", F.round(F.when(F.col("st").isNotNull(), middle_mean(near)), 9).alias("median"))


def q_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs(V.frames(spark, d).where("rms_db > -12"), "recording", "idx", gap=1, least=3)


def q_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    f = V.frames(spark, d)
    return clean_activity(hysteresis(f, "recording", "idx", F.col("rms_db"), -8.0, -14.0), "recording", "idx")


def q_onsets(spark: SparkSession, d: str) -> DataFrame:
    """Onset intervals against a reference interval, with verdict and severity."""
    e = V.intervals(spark, d).where("kind = 'click'")
    nxt = F.lead("t0").over(W.partitionBy("take").orderBy("t0", "span"))
    x = e.withColumn("ioi", nxt - F.col("t0")).where("ioi IS NOT NULL AND ioi > 0")
    ref = 600 + F.col("value") * 20
    ratio = F.col("ioi") / ref
    slow = (ratio > 1.25) & (F.col("ioi") - ref > 0.08)
    fast = (ratio < 0.8) & (ref - F.col("ioi") > 0.08)
    sev = F.least(F.lit(3), 1 + F.floor(F.abs(F.ln(ratio)) / 0.7))
    return x.select("take", "span", F.when(slow, "slow").when(fast, "fast").alias("verdict"), F.when(slow | fast, sev).cast("long").alias("severity"))


def q_topk_deviations(spark: SparkSession, d: str) -> DataFrame:
    """The 60 most severe spans per take, in time order."""
    e = V.intervals(spark, d).withColumn("severity", F.floor(F.col("value") / 20).cast("long"))
    n = F.row_number().over(W.partitionBy("take").orderBy(F.desc("severity"), "t0", "span"))
    kept = e.withColumn("n", n).where("n <= 60")
    return kept.select("take", "span", "severity", F.row_number().over(W.partitionBy("take").orderBy("t0", "span")).alias("place"))


def q_longest_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Starts after the three longest pauses of each take, in time order; none if there are fewer."""
    e = V.intervals(spark, d)
    w = W.partitionBy("take").orderBy("t0", "span")
    g = e.select("take", "span", "t0", (F.col("t0") - F.lag("t0").over(w)).alias("gap")).where("gap IS NOT NULL")
    g = g.withColumn("n", F.row_number().over(W.partitionBy("take").orderBy(F.desc("gap"), "t0"))).withColumn("all", F.count("*").over(W.partitionBy("take")))
    return g.where("all >= 3 AND n <= 3").select("take", "span", F.row_number().over(W.partitionBy("take").orderBy("t0")).alias("pada"))


def q_even_stride(spark: SparkSession, d: str) -> DataFrame:
    """At most 300 active frames per recording at an even stride."""
    f = V.frames(spark, d).where("rms_db > -12")
    f = f.withColumn("n", F.count("*").over(by_rec())).withColumn("i", F.row_number().over(by_time()) - 1)
    return f.where(F.col("i") % F.greatest(F.lit(1), F.ceil(F.col("n") / 300)) == 0).select("recording", "idx")


def q_activity_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Room level: the quietest steady window of 15 frames, if well under the 98th percentile; and the threshold."""
    f = V.frames(spark, d)
    w = by_time().rowsBetween(-14, 0)
    x = f.select("recording", "idx", "rms_db", F.avg("rms_db").over(w).alias("level"), (F.max("rms_db").over(w) - F.min("rms_db").over(w)).alias("spread"), F.count("*").over(w).alias("n"))
    whole = F.col("n") == 15
    a = x.groupBy("recording").agg(F.min_by(F.when(whole, F.struct("level", "spread")), F.when(whole, F.struct("level", "idx"))).alias("quiet"), F.collect_list("rms_db").alias("rms"))
    p98, p10 = nearest_rank(F.col("rms"), 0.98), nearest_rank(F.col("rms"), 0.1)
    trusted = F.coalesce((F.col("quiet.spread") <= 25) & (p98 - F.col("quiet.level") >= 12), F.lit(False))
    thr = F.when(trusted, F.col("quiet.level") + 9).otherwise(F.greatest(p10 + 6, p98 - 35))
    return a.select("recording", trusted.alias("trusted"), F.round(thr, 6).alias("threshold_db"))


LEAST_MATCHES, SNAP = 10, 0.3


def key_offset(matches: DataFrame, by: str, apart: str = "apart") -> DataFrame:
    """(by, offset, n): by how many semitones one side is sung higher, from the differences of matched frames.

    The pitch class is the most frequent tenth of a semitone of the differences folded into one octave (the lowest of
    equally frequent ones); the octave is the one that most differences of that class lie in (the same octave before
    others, then the nearest, the lower one); then the median of those within a semitone, a whole number if it is
    within 0.3 of one. 0 with fewer than ten differences. A difference of nothing is none.
    """
    half = lambda x: F.floor(x + 0.5)
    m = matches.where(F.col(apart).isNotNull()).select(by, F.col(apart).alias("d"))
    m = m.withColumn("folded", F.col("d") - 12 * half(F.col("d") / 12))
    bins = m.groupBy(by, half((F.col("folded") + 6) * 10).alias("bin")).agg(F.count("*").alias("votes"))
    modes = bins.groupBy(by).agg(F.max_by("bin", F.struct("votes", (-F.col("bin")).alias("b"))).alias("bin"), F.sum("votes").alias("n"))
    m = m.join(modes.select(by, (F.col("bin") / 10 - 6).alias("class")), by)
    octave = half((F.col("d") - F.col("class")) / 12).alias("octave")
    votes = m.where("abs(folded - class) <= 1").groupBy(by, "class", octave).agg(F.count("*").alias("votes"))
    rank = F.struct("votes", (-F.abs("octave")).alias("near"), (-F.col("octave")).alias("low"))
    centres = votes.groupBy(by, "class").agg(F.max_by("octave", rank).alias("octave")).select(by, (F.col("class") + 12 * F.col("octave")).alias("centre"))
    near = m.join(centres, by).where("abs(d - centre) <= 1").groupBy(by).agg(F.median("d").alias("middle"))
    whole = half(F.col("middle"))
    offset = F.when(F.col("n") < LEAST_MATCHES, 0.0).when(F.abs(F.col("middle") - whole) < SNAP, whole).otherwise(F.col("middle"))
    return modes.join(near, by, "left").select(by, offset.alias("offset"), "n")


def tempo_ratio(matches: DataFrame, by: str, ref: str = "i", heard: str = "j", least: float = 0.25, most: float = 4.0) -> DataFrame:
    """(by, tempo_ratio): slope of the frames heard over the reference's, kept in bounds; 1 where it can't be told."""
    x = F.col(ref).cast("double")
    slope = F.greatest(F.lit(least), F.least(F.lit(most), F.regr_slope(F.col(heard).cast("double"), x)))
    return matches.groupBy(by).agg(F.coalesce(F.when(F.var_pop(x) > 0, slope), F.lit(1.0)).alias("tempo_ratio"))


def q_key_offset(spark: SparkSession, d: str) -> DataFrame:
    """Differences of pitch to the next frame, three times as large, as those of two takes."""
    f = V.frames(spark, d).select("recording", ((F.lead("st").over(by_time()) - F.col("st")) * 3).alias("apart"))
    return key_offset(f, "recording").select("recording", F.round("offset", 6).alias("offset"), "n")


def q_tempo_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Least-squares slope of take frame on reference frame, clamped; 1 where it can't be told."""
    f = V.frames(spark, d).where("st IS NOT NULL").withColumn("j", F.col("idx") * 1.1 + F.col("rms_db"))
    return tempo_ratio(f, "recording", "idx").select("recording", F.round("tempo_ratio", 6).alias("tempo_ratio"))


def q_normalize_vectors(spark: SparkSession, d: str) -> DataFrame:
    """12 coefficients with each recording's mean removed, over the pooled spread of the coefficient."""
    v = V.table(spark, d, "embeddings").select("label", "vec_id", F.posexplode(F.slice("embedding", 1, 12)).alias("coef", "x"))
    c = v.withColumn("c", F.col("x").cast("double") - F.avg(F.col("x").cast("double")).over(W.partitionBy("label", "coef")))
    sd = c.groupBy("coef").agg(F.sqrt(F.avg(F.col("c") * F.col("c"))).alias("sd"))
    return c.join(F.broadcast(sd), "coef").select("vec_id", "coef", F.round(F.when(F.col("sd") > 0, F.col("c") / F.col("sd")).otherwise(0.0), 5).alias("z"))  # 12 rows are broadcast


def q_emphasis(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of loudness with the next frame's along a recording, as a score; null under 25 points."""
    f = V.frames(spark, d).withColumn("next", F.lead("rms_db").over(by_time())).where("next IS NOT NULL")
    a = f.groupBy("recording").agg(F.count("*").alias("n"), F.corr("rms_db", "next").alias("r"))
    return a.select("recording", F.when(F.col("n") >= 25, F.floor(F.greatest(F.lit(0), F.least(F.lit(100), 40 + 60 * F.col("r") / 0.7)) + 0.5)).cast("long").alias("emphasis"))


def q_missing_extra(spark: SparkSession, d: str) -> DataFrame:
    """Runs of reference sound without take sound (missing) and the other way round (extra)."""
    f = V.frames(spark, d).select("recording", "idx", (F.col("rms_db") > -14).alias("ref"), (F.col("kind") != "view").alias("take"))
    parts = [runs(f.where(c), "recording", "idx", 1, 2).withColumn("type", F.lit(t)) for t, c in (("missing", F.expr("ref AND NOT take")), ("extra", F.expr("take AND NOT ref")))]
    return parts[0].unionByName(parts[1])


def q_pitch_deviations(spark: SparkSession, d: str) -> DataFrame:
    """Runs of at least three frames whose pitch is off its moving median by more than the band."""
    f = V.frames(spark, d).withColumn("m", middle_mean(F.collect_list("st").over(by_time().rowsBetween(-6, 6))))
    off = F.abs(F.col("st") - F.col("m"))
    found = runs(f.where(off > 1.5), "recording", "idx", 1, 3)
    worst = f.select("recording", "idx", off.alias("off"))
    j = found.join(worst, (found.recording == worst.recording) & F.expr("idx BETWEEN first AND last AND off IS NOT NULL")).drop(worst.recording)
    return j.groupBy("recording", "first", "last").agg(F.round(F.avg("off"), 6).alias("mean_off"), F.least(F.lit(3), 1 + F.floor(F.max("off") / 3)).cast("long").alias("severity"))


def q_content_deviations(spark: SparkSession, d: str) -> DataFrame:
    """Frames whose distance is above median + 2 MAD and the floor, in runs of two, away from the edges."""
    f = V.frames(spark, d).withColumn("dist", F.abs(F.col("rms_db") + 10) / 5)
    m = f.groupBy("recording").agg(middle_mean(F.collect_list("dist")).alias("med"), F.collect_list("dist").alias("all"), F.max("idx").alias("top"))
    m = m.select("recording", "top", "med", middle_mean(F.transform("all", lambda x: F.abs(x - F.col("med")))).alias("mad"))
    j = f.join(m, "recording").where(F.col("dist") > F.greatest(F.col("med") + 2 * 1.4826 * F.col("mad"), F.lit(1.1))).where("idx >= 2 AND idx <= top - 2")
    return runs(j, "recording", "idx", 1, 2)


def q_merge_deviations(spark: SparkSession, d: str) -> DataFrame:
    """Spans of one kind merged where they overlap or lie within 30 s; long ones are one step more severe."""
    e = V.intervals(spark, d).where("kind IN ('click', 'purchase')")
    w = W.partitionBy("take", "kind").orderBy("t0", "span")
    high = F.max("t1").over(w.rowsBetween(W.unboundedPreceding, -1))
    e = e.withColumn("new", F.when(F.col("t0") > high + 30, 1).otherwise(0)).withColumn("island", F.sum("new").over(w))
    a = e.groupBy("take", "kind", "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.max(F.floor(F.col("value") / 40) + 1).alias("sev"), F.count("*").alias("parts"))
    return a.select("take", "kind", "t0", "t1", "parts", F.least(F.lit(3), F.col("sev") + F.when(F.col("t1") - F.col("t0") > 3600, 1).otherwise(0)).cast("long").alias("severity"))


def q_dynamics(spark: SparkSession, d: str) -> DataFrame:
    """Runs of frames more than 10 dB away from the recording's mean level."""
    f = V.frames(spark, d).withColumn("off", F.abs(F.col("rms_db") - F.avg("rms_db").over(by_rec())))
    return runs(f.where("off > 10"), "recording", "idx", 0, 2)


def q_harmonise(spark: SparkSession, d: str) -> DataFrame:
    """Active frames of both of two recordings under the stricter of their relative thresholds."""
    f = V.frames(spark, d).withColumn("pair", F.floor(F.col("recording") / 2).cast("long"))
    thr = f.groupBy("recording", "pair").agg((F.max("rms_db") - F.min("rms_db")).alias("depth"), F.max("rms_db").alias("peak"))
    both = thr.groupBy("pair").agg(F.min("depth").alias("least"), F.max("depth").alias("most"))
    rel = F.when(F.col("most") - F.col("least") > 6, F.col("least")).otherwise(F.col("depth")) * 0.3
    t = thr.join(both, "pair").select("recording", (F.col("peak") - rel).alias("thr"))
    return f.join(t, "recording").groupBy("recording").agg(F.count_if(F.col("rms_db") >= F.col("thr")).alias("active"))


def q_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Spans of a take that overlap by more than half of the shorter one: equi-join on take and time bucket."""
    size = 7200.0
    e = V.intervals(spark, d).where("kind = 'purchase' AND t1 > t0")
    cells = e.withColumn("cell", F.explode(F.sequence(F.floor(F.col("t0") / size), F.floor(F.col("t1") / size))))
    a, b = cells.select("take", "cell", F.col("span").alias("a"), F.col("t0").alias("a0"), F.col("t1").alias("a1")), cells.select("take", "cell", F.col("span").alias("b"), F.col("t0").alias("b0"), F.col("t1").alias("b1"))
    both = F.least("a1", "b1") - F.greatest("a0", "b0")
    first = F.floor(F.greatest("a0", "b0") / size) == F.col("cell")  # the pair is reported by the first cell that it shares
    j = a.join(b, ["take", "cell"]).where((F.col("a") < F.col("b")) & first & (both > 0.5 * F.least(F.col("a1") - F.col("a0"), F.col("b1") - F.col("b0"))))
    return j.select("take", "a", "b")


def q_slip_confirm(spark: SparkSession, d: str) -> DataFrame:
    """Unsure stalls of a take that a deviation starts or ends near (within 45 s)."""
    e = V.intervals(spark, d)
    slips, dev = e.where("kind = 'error'").select("take", "span", "t0"), e.where("kind = 'click'").select(F.col("take").alias("tk"), F.col("t0").alias("d0"), F.col("t1").alias("d1"))
    near = F.expr("t0 >= d0 - 45 AND t0 <= d1 + 45")
    return slips.join(dev, (F.col("take") == F.col("tk")) & near, "left_semi").select("take", "span")


def q_tokens_in_window(spark: SparkSession, d: str) -> DataFrame:
    """Moments inside [from - 1/2, to + 1/2] of the take's first long span."""
    e = V.intervals(spark, d)
    win = e.where("kind = 'purchase'").groupBy("take").agg(F.min_by(F.struct("t0", "t1"), F.struct("t0", "span")).alias("w")).select("take", "w.*").withColumnsRenamed({"t0": "lo", "t1": "hi"})
    return e.join(win, "take", "left").where(F.expr("lo IS NULL OR t0 BETWEEN lo - 0.5 AND hi + 0.5")).select("take", "span")


def q_segments_for_span(spark: SparkSession, d: str) -> DataFrame:
    """Segments that overlap a span by more than 0.3 s at both ends, where one covers its middle; joined in order."""
    e = V.intervals(spark, d)
    spans = e.where("kind = 'purchase' AND value > 50").select("take", "span", "t0", "t1")
    segs = e.where("kind = 'view'").select(F.col("take").alias("tk"), F.col("span").alias("seg"), F.col("t0").alias("s0"), F.col("t1").alias("s1"))
    j = spans.join(segs, (F.col("take") == F.col("tk")) & F.expr("s1 > t0 + 0.3 AND s0 < t1 - 0.3"))
    a = j.groupBy("take", "span").agg(F.bool_or(F.expr("s0 <= (t0 + t1) / 2 AND s1 >= (t0 + t1) / 2")).alias("covered"), F.array_sort(F.collect_list("seg")).alias("segs"))
    return a.where("covered").select("take", "span", F.array_join(F.transform("segs", lambda x: x.cast("string")), ",").alias("segments"))


def q_asof_pada(spark: SparkSession, d: str) -> DataFrame:
    """First checkpoint that a count doesn't exceed, within a tolerance of a tenth; and whether it is at it."""
    e = V.intervals(spark, d).where("kind = 'view'").withColumn("count", F.floor(F.col("value")).cast("long"))
    marks = [8, 16, 24, 32, 48, 64, 96, 128]
    tol = F.greatest(F.lit(1), F.floor(F.col("count") * 0.1 + 0.5))
    k = F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: m >= F.col("count") - tol)
    at = F.element_at(k, 1)
    return e.select("take", "span", F.when(F.size(k) > 0, at).cast("long").alias("checkpoint"), F.when(F.size(k) > 0, F.abs(at - F.col("count")) <= tol).alias("at_boundary"))


def q_ear_window(spark: SparkSession, d: str) -> DataFrame:
    """Longest span of each take, half a second wider on both sides."""
    n = F.row_number().over(W.partitionBy("take").orderBy(F.desc(F.expr("t1 - t0")), "span"))
    return V.intervals(spark, d).withColumn("n", n).where("n = 1").select("take", "span", F.round(F.greatest(F.lit(0.0), F.col("t0") - 0.5), 6).alias("lo"), F.round(F.col("t1") + 0.5, 6).alias("hi"))


def q_carry_speaker(spark: SparkSession, d: str) -> DataFrame:
    """The last signup's id carried forward in time order."""
    w = W.partitionBy("take").orderBy("t0", "span").rowsBetween(W.unboundedPreceding, W.currentRow)
    return V.intervals(spark, d).select("take", "span", F.last(F.when(F.col("kind") == "signup", F.col("span")), ignorenulls=True).over(w).alias("speaker"))


def q_session_updates(spark: SparkSession, d: str) -> DataFrame:
    """Latest version of each session: the last non-null value of every field by version."""
    e = V.intervals(spark, d).withColumn("session", F.col("take") % 25)
    fields = {"score": F.when(F.col("kind") == "click", F.floor(F.col("value"))), "note": F.when(F.col("kind") == "view", F.col("span"))}
    last = [F.max_by(x, F.when(x.isNotNull(), F.struct("t0", "span"))).cast("long").alias(n) for n, x in fields.items()]
    return e.groupBy("session").agg(*last, F.count("*").alias("versions"))


def q_merge_word_slips(spark: SparkSession, d: str) -> DataFrame:
    """One slip per take, kind and hour: the latest one, with the first word that any of them has."""
    e = V.intervals(spark, d).withColumn("pada", F.floor(F.col("t0") / 3600).cast("long"))
    word = F.when(F.col("kind") == "click", F.col("span"))
    return e.groupBy("take", "kind", "pada").agg(F.max_by("span", F.struct("t0", "span")).alias("span"), F.min(word).alias("word"))


def q_shift_times(spark: SparkSession, d: str) -> DataFrame:
    """Times moved by the take's leading silence and clamped to its end."""
    e = V.intervals(spark, d)
    w = W.partitionBy("take")
    lead, end = F.min("t0").over(w), F.max("t1").over(w)
    return e.select("take", "span", *[F.round(F.greatest(F.lit(0.0), F.least(F.col(c) - lead, end - lead)), 6).alias(c) for c in ("t0", "t1")])


def q_pace(spark: SparkSession, d: str) -> DataFrame:
    """Running mean pace of a learner, depth capped at 20: an ordered fold over the takes."""
    e = V.intervals(spark, d).where("kind = 'purchase'")
    a = e.groupBy("take").agg(F.array_sort(F.collect_list(F.struct("t0", "span", "value"))).alias("v"))
    start = F.struct(F.lit(0.0).alias("mean"), F.lit(0).alias("n"))
    step = lambda s, x: F.struct((s["mean"] + (x["value"] - s["mean"]) / F.least(s["n"] + 1, F.lit(20))).alias("mean"), (s["n"] + 1).alias("n"))
    out = a.withColumn("s", F.aggregate("v", start, step))
    return out.select(F.col("take").alias("learner"), F.round("s.mean", 6).alias("pace"), F.col("s.n").cast("long").alias("n"))


def _runs_sql(src: str, gap: int, least: int, key: str = "recording") -> str:
    return f"""SELECT {key}, min(idx) AS first, max(idx) AS last FROM (SELECT {key}, idx, sum(nw) OVER (PARTITION BY {key} ORDER BY idx) AS run FROM (
  SELECT {key}, idx, CASE WHEN idx - lag(idx) OVER (PARTITION BY {key} ORDER BY idx) > {gap + 1} THEN 1 ELSE 0 END AS nw FROM ({src}))) GROUP BY {key}, run HAVING max(idx) - min(idx) + 1 >= {least}"""


def _rank_sql(v: str, p: float) -> str:
    return f"(list_sort(list({v}) FILTER ({v} IS NOT NULL)))[floor({p} * (count({v}) - 1) + 0.5)::INT + 1]"


_SORTED = "list_sort(list_filter({0}, lambda x: x IS NOT NULL))"
_MED = "(list_sort({0})[((len({0}) + 1) // 2)] + list_sort({0})[len({0}) // 2 + 1]) / 2"

QUERIES = {
    "reject_silent": q_reject_silent, "agg_voice_stats": q_voice_stats, "win_prominence": q_prominence, "win_moving_median": q_moving_median, "win_runs": q_runs, "win_hysteresis": q_hysteresis,
    "win_onsets_ioi": q_onsets, "topk_deviations": q_topk_deviations, "topk_longest_gaps": q_longest_gaps, "sample_even_stride": q_even_stride, "activity_threshold": q_activity_threshold,
    "key_offset": q_key_offset, "tempo_ratio": q_tempo_ratio, "normalize_vectors": q_normalize_vectors, "emphasis_score": q_emphasis, "detect_missing_extra": q_missing_extra,
    "detect_pitch_deviations": q_pitch_deviations, "detect_content_deviations": q_content_deviations, "merge_deviations": q_merge_deviations, "detect_timing_dynamics": q_dynamics,
    "rethreshold_harmonise": q_harmonise, "interval_overlap_spans": q_overlap, "interval_slip_confirm": q_slip_confirm, "interval_tokens_in_window": q_tokens_in_window,
    "interval_segments_for_span": q_segments_for_span, "asof_pada_at_count": q_asof_pada, "ear_window_choice": q_ear_window, "carry_speaker": q_carry_speaker,
    "merge_session_updates": q_session_updates, "merge_word_slips": q_merge_word_slips, "shift_transcript_times": q_shift_times, "agg_pace_running_mean": q_pace,
}
_F, _I = ("v_frames",), ("v_intervals",)
_W = "WINDOW w AS (PARTITION BY recording ORDER BY idx"
ORACLE = {
    "reject_silent": V.sql("SELECT recording, avg(CASE WHEN rms_db > -5 THEN 1.0 ELSE 0.0 END) AS active_frac, max(rms_db) AS peak_db, active_frac >= 0.05 AND peak_db >= -40 AS usable FROM v_frames GROUP BY recording", *_F),
    "agg_voice_stats": V.sql(f"SELECT recording, {', '.join(f'{_rank_sql("st", p)} AS st_p{int(p * 100)}' for p in (0.1, 0.5, 0.9))}, {_rank_sql('st', 0.9)} - {_rank_sql('st', 0.1)} AS range_st, round(count(st) / count(*), 6) AS voiced_fraction, max(rms_db) AS peak_db, {_rank_sql('rms_db', 0.1)} AS floor_db FROM v_frames GROUP BY recording", *_F),
    "win_prominence": V.sql(
        """,, p AS (SELECT recording, idx, rms_db / 6 + (coalesce(st, 60) - 12 * floor(coalesce(st, 60) / 12)) / 3 AS p FROM v_frames), s AS (SELECT recording, idx, avg(p) OVER (PARTITION BY recording ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s FROM p)
SELECT recording, idx, round(CASE WHEN stddev_pop(s) OVER r > 0 THEN (s - avg(s) OVER r) / stddev_pop(s) OVER r ELSE 0.0 END, 6) AS z FROM s WINDOW r AS (PARTITION BY recording)""", *_F),
    "win_moving_median": V.sql("SELECT recording, idx, round(CASE WHEN st IS NOT NULL THEN median(st) OVER (PARTITION BY recording ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 9) AS median FROM v_frames", *_F),
    "win_runs": V.sql(_runs_sql("SELECT recording, idx FROM v_frames WHERE rms_db > -12", 1, 3), *_F),
    "win_hysteresis": V.sql(_runs_sql("SELECT recording, idx FROM (SELECT recording, idx, coalesce(last_value(CASE WHEN rms_db >= -8 THEN 1 WHEN rms_db < -14 THEN 0 END IGNORE NULLS) OVER (PARTITION BY recording ORDER BY idx ROWS UNBOUNDED PRECEDING), 0) AS on_ FROM v_frames) WHERE on_ = 1", 2, 2), *_F),
    "win_onsets_ioi": V.sql(
        """,, x AS (SELECT take, span, lead(t0) OVER (PARTITION BY take ORDER BY t0, span) - t0 AS ioi, 600 + value * 20 AS ref FROM v_intervals WHERE kind = 'click'), y AS (SELECT *, ioi / ref AS r FROM x WHERE ioi > 0),
z AS (SELECT *, CASE WHEN r > 1.25 AND ioi - ref > 0.08 THEN 'slow' WHEN r < 0.8 AND ref - ioi > 0.08 THEN 'fast' END AS verdict FROM y)
SELECT take, span, verdict, CASE WHEN verdict IS NOT NULL THEN least(3, 1 + floor(abs(ln(r)) / 0.7))::BIGINT END AS severity FROM z""", *_I),
    "topk_deviations": V.sql("SELECT take, span, severity, row_number() OVER (PARTITION BY take ORDER BY t0, span) AS place FROM (SELECT *, floor(value / 20)::BIGINT AS severity, row_number() OVER (PARTITION BY take ORDER BY floor(value / 20) DESC, t0, span) AS n FROM v_intervals) WHERE n <= 60", *_I),
    "topk_longest_gaps": V.sql(
        """,, g AS (SELECT take, span, t0, t0 - lag(t0) OVER (PARTITION BY take ORDER BY t0, span) AS gap FROM v_intervals), r AS (SELECT *, row_number() OVER (PARTITION BY take ORDER BY gap DESC, t0) AS n, count(*) OVER (PARTITION BY take) AS al FROM g WHERE gap IS NOT NULL)
SELECT take, span, row_number() OVER (PARTITION BY take ORDER BY t0) AS pada FROM r WHERE al >= 3 AND n <= 3""", *_I),
    "sample_even_stride": V.sql("SELECT recording, idx FROM (SELECT recording, idx, count(*) OVER (PARTITION BY recording) AS n, row_number() OVER (PARTITION BY recording ORDER BY idx) - 1 AS i FROM v_frames WHERE rms_db > -12) WHERE i % greatest(1, ceil(n / 300)) = 0", *_F),
    "activity_threshold": V.sql(
        f""",, x AS (SELECT recording, idx, rms_db, avg(rms_db) OVER w AS level, max(rms_db) OVER w - min(rms_db) OVER w AS spread, count(*) OVER w AS n FROM v_frames {_W} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)),
a AS (SELECT recording, arg_min(level, (level, idx)) FILTER (n = 15) AS level, arg_min(spread, (level, idx)) FILTER (n = 15) AS spread, {_rank_sql('rms_db', 0.98)} AS p98, {_rank_sql('rms_db', 0.1)} AS p10 FROM x GROUP BY recording)
SELECT recording, coalesce(spread <= 25 AND p98 - level >= 12, false) AS trusted, round(CASE WHEN coalesce(spread <= 25 AND p98 - level >= 12, false) THEN level + 9 ELSE greatest(p10 + 6, p98 - 35) END, 6) AS threshold_db FROM a""", *_F),
    "key_offset": V.sql(
        """,, x AS (SELECT recording, (lead(st) OVER (PARTITION BY recording ORDER BY idx) - st) * 3 AS d FROM v_frames), f AS (SELECT *, d - 12 * floor(d / 12 + 0.5) AS folded FROM x WHERE d IS NOT NULL),
b AS (SELECT recording, floor((folded + 6) * 10 + 0.5)::BIGINT AS bin, count(*) AS n FROM f GROUP BY ALL), m AS (SELECT recording, arg_max(bin, (n, -bin)) / 10 - 6 AS class, sum(n)::BIGINT AS n FROM b GROUP BY recording),
o AS (SELECT recording, class, floor((d - class) / 12 + 0.5) AS k, count(*) AS n FROM f JOIN m USING (recording) WHERE abs(folded - class) <= 1 GROUP BY ALL), c AS (SELECT recording, class + 12 * arg_max(k, (n, -abs(k), -k)) AS centre FROM o GROUP BY recording, class),
e AS (SELECT recording, median(d) AS middle FROM f JOIN c USING (recording) WHERE abs(d - centre) <= 1 GROUP BY recording)
SELECT recording, round(CASE WHEN n < 10 THEN 0.0 WHEN abs(middle - floor(middle + 0.5)) < 0.3 THEN floor(middle + 0.5) ELSE middle END, 6) AS offset, n FROM m LEFT JOIN e USING (recording)""", *_F),
    "tempo_ratio": V.sql("SELECT recording, round(coalesce(greatest(0.25, least(4.0, regr_slope(idx * 1.1 + rms_db, idx::DOUBLE))), 1.0), 6) AS tempo_ratio FROM v_frames WHERE st IS NOT NULL GROUP BY recording", *_F),
    "normalize_vectors": """WITH v AS (SELECT label, vec_id, i AS coef, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(12) r(i)), c AS (SELECT vec_id, coef, x - avg(x) OVER (PARTITION BY label, coef) AS c FROM v)
SELECT vec_id, coef::INT AS coef, round(CASE WHEN sd > 0 THEN c / sd ELSE 0.0 END, 5) AS z FROM c JOIN (SELECT coef, sqrt(avg(c * c)) AS sd FROM c GROUP BY coef) USING (coef)""",
    "emphasis_score": V.sql(
        """,, n AS (SELECT recording, rms_db, lead(rms_db) OVER (PARTITION BY recording ORDER BY idx) AS nx FROM v_frames)
SELECT recording, CASE WHEN count(*) >= 25 THEN floor(greatest(0, least(100, 40 + 60 * corr(rms_db, nx) / 0.7)) + 0.5)::BIGINT END AS emphasis FROM n WHERE nx IS NOT NULL GROUP BY recording""", *_F),
    "detect_missing_extra": V.sql(
        f"SELECT *, 'missing' AS type FROM ({_runs_sql("SELECT recording, idx FROM v_frames WHERE rms_db > -14 AND kind = 'view'", 1, 2)}) UNION ALL SELECT *, 'extra' FROM ({_runs_sql("SELECT recording, idx FROM v_frames WHERE rms_db <= -14 AND kind <> 'view'", 1, 2)})", *_F),
    "detect_pitch_deviations": V.sql(
        f""",, f AS (SELECT recording, idx, abs(st - median(st) OVER (PARTITION BY recording ORDER BY idx ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)) AS dv FROM v_frames), r AS ({_runs_sql('SELECT recording, idx FROM f WHERE dv > 1.5', 1, 3)})
SELECT r.recording, first, last, round(avg(dv), 6) AS mean_off, least(3, 1 + floor(max(dv) / 3))::BIGINT AS severity FROM r JOIN f ON f.recording = r.recording AND idx BETWEEN first AND last AND dv IS NOT NULL GROUP BY ALL""", *_F),
    "detect_content_deviations": V.sql(
        f""",, f AS (SELECT recording, idx, abs(rms_db + 10) / 5 AS dist FROM v_frames), m AS (SELECT recording, median(dist) AS med, max(idx) AS top FROM f GROUP BY recording), g AS (SELECT recording, median(abs(dist - med)) AS mad FROM f JOIN m USING (recording) GROUP BY recording)
{_runs_sql('SELECT recording, idx FROM f JOIN m USING (recording) JOIN g USING (recording) WHERE dist > greatest(med + 2 * 1.4826 * mad, 1.1) AND idx >= 2 AND idx <= top - 2', 1, 2)}""", *_F),
    "merge_deviations": V.sql(
        """,, e AS (SELECT *, CASE WHEN t0 > max(t1) OVER (PARTITION BY take, kind ORDER BY t0, span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 30 THEN 1 ELSE 0 END AS nw FROM v_intervals WHERE kind IN ('click', 'purchase')), i AS (SELECT *, sum(nw) OVER (PARTITION BY take, kind ORDER BY t0, span) AS island FROM e)
SELECT take, kind, min(t0) AS t0, max(t1) AS t1, count(*) AS parts, least(3, max(floor(value / 40) + 1) + CASE WHEN max(t1) - min(t0) > 3600 THEN 1 ELSE 0 END)::BIGINT AS severity FROM i GROUP BY take, kind, island""", *_I),
    "detect_timing_dynamics": V.sql(_runs_sql("SELECT recording, idx FROM (SELECT recording, idx, abs(rms_db - avg(rms_db) OVER (PARTITION BY recording)) AS dv FROM v_frames) WHERE dv > 10", 0, 2), *_F),
    "rethreshold_harmonise": V.sql(
        """,, t AS (SELECT recording, recording // 2 AS pair, max(rms_db) - min(rms_db) AS depth, max(rms_db) AS peak FROM v_frames GROUP BY recording), b AS (SELECT pair, min(depth) AS lo, max(depth) AS hi FROM t GROUP BY pair),
x AS (SELECT recording, peak - CASE WHEN hi - lo > 6 THEN lo ELSE depth END * 0.3::DOUBLE AS thr FROM t JOIN b USING (pair)) SELECT recording, count(*) FILTER (rms_db >= thr) AS active FROM v_frames JOIN x USING (recording) GROUP BY recording""", *_F),
    "interval_overlap_spans": V.sql(
        """,, e AS (SELECT * FROM v_intervals WHERE kind = 'purchase' AND t1 > t0)
SELECT a.take, a.span AS a, b.span AS b FROM e a JOIN e b ON a.take = b.take AND a.span < b.span AND least(a.t1, b.t1) - greatest(a.t0, b.t0) > 0.5 * least(a.t1 - a.t0, b.t1 - b.t0)""", *_I),
    "interval_slip_confirm": V.sql("SELECT take, span FROM v_intervals s WHERE kind = 'error' AND EXISTS (SELECT 1 FROM v_intervals d WHERE d.kind = 'click' AND d.take = s.take AND s.t0 >= d.t0 - 45 AND s.t0 <= d.t1 + 45)", *_I),
    "interval_tokens_in_window": V.sql(",, w AS (SELECT take, arg_min(t0, (t0, span)) AS lo, arg_min(t1, (t0, span)) AS hi FROM v_intervals WHERE kind = 'purchase' GROUP BY take) SELECT take, span FROM v_intervals LEFT JOIN w USING (take) WHERE lo IS NULL OR t0 BETWEEN lo - 0.5 AND hi + 0.5", *_I),
    "interval_segments_for_span": V.sql(
        """SELECT p.take, p.span, string_agg(s.span::VARCHAR, ',' ORDER BY s.span) AS segments FROM v_intervals p JOIN v_intervals s ON p.take = s.take AND s.t1 > p.t0 + 0.3 AND s.t0 < p.t1 - 0.3
WHERE p.kind = 'purchase' AND p.value > 50 AND s.kind = 'view' GROUP BY p.take, p.span HAVING bool_or(s.t0 <= (p.t0 + p.t1) / 2 AND s.t1 >= (p.t0 + p.t1) / 2)""", *_I),
    "asof_pada_at_count": V.sql(
        """,, c AS (SELECT take, span, floor(value)::BIGINT AS n, greatest(1, floor(floor(value) * 0.1::DOUBLE + 0.5)) AS tol FROM v_intervals WHERE kind = 'view'), k AS (SELECT *, list_filter([8, 16, 24, 32, 48, 64, 96, 128], lambda m: m >= n - tol)[1] AS cp FROM c)
SELECT take, span, cp::BIGINT AS checkpoint, abs(cp - n) <= tol AS at_boundary FROM k""", *_I),
    "ear_window_choice": V.sql("SELECT take, span, round(greatest(0.0, t0 - 0.5), 6) AS lo, round(t1 + 0.5, 6) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY take ORDER BY t1 - t0 DESC, span) AS n FROM v_intervals) WHERE n = 1", *_I),
    "carry_speaker": V.sql("SELECT take, span, last_value(CASE WHEN kind = 'signup' THEN span END IGNORE NULLS) OVER (PARTITION BY take ORDER BY t0, span ROWS UNBOUNDED PRECEDING) AS speaker FROM v_intervals", *_I),
    "merge_session_updates": V.sql("SELECT take % 25 AS session, arg_max(floor(value)::BIGINT, (t0, span)) FILTER (kind = 'click') AS score, arg_max(span, (t0, span)) FILTER (kind = 'view') AS note, count(*) AS versions FROM v_intervals GROUP BY 1", *_I),
    "merge_word_slips": V.sql("SELECT take, kind, floor(t0 / 3600)::BIGINT AS pada, arg_max(span, (t0, span)) AS span, min(CASE WHEN kind = 'click' THEN span END) AS word FROM v_intervals GROUP BY 1, 2, 3", *_I),
    "shift_transcript_times": V.sql(
        "SELECT take, span, round(greatest(0.0, least(t0 - lo, hi - lo)), 6) AS t0, round(greatest(0.0, least(t1 - lo, hi - lo)), 6) AS t1 FROM (SELECT *, min(t0) OVER (PARTITION BY take) AS lo, max(t1) OVER (PARTITION BY take) AS hi FROM v_intervals)", *_I),
    "agg_pace_running_mean": V.sql(
        """,, s AS (SELECT take, value, row_number() OVER (PARTITION BY take ORDER BY t0, span) AS n FROM v_intervals WHERE kind = 'purchase'), p AS (SELECT take, n, value AS mean FROM s WHERE n = 1 UNION ALL SELECT s.take, s.n, p.mean + (s.value - p.mean) / least(s.n, 20) FROM p JOIN s ON s.take = p.take AND s.n = p.n + 1)
SELECT take AS learner, round(arg_max(mean, n), 6) AS pace, max(n) AS n FROM p GROUP BY take""", *_I, recursive=True),
}
