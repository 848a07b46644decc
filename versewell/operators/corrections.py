"""What learners do to correct themselves, read from words as streams of sounds; and boundaries moved by words.

Keys of words are made natively. Where a stream repeats itself is found for some thousand places at once: seeds of three
equal sounds at each distance, then edit distances of all seeds together, a column of a table in two words of 64 bits.
Work is linear in the length of a stream. Takes are rows, so nothing is shuffled to find repeats; boundaries need one exchange by take.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from versewell.functions.slices import sliced
from versewell.functions.sounds import akshara_counts, phonetic_key
from versewell.operators.texts import tokens
from versewell.plans import views as V

LEAST_SOUNDS, MOST_SOUNDS, MOST_GAP, SEED = 5, 60, 2, 3
REPEAT_EDITS, PLACE_EDITS, BOUNDARY_EDITS = 0.15, 0.3, 0.2
RESTART_AKSHARAS, START_SLACK = 6, 2
LEAST_RUN, LEAD = 6, 0.15


def slack(length: int, share: float) -> int:
    return max(1, int(length * share + 0.5))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype("i8")


class Stream:
    """Keys of tokens side by side: sounds, the token of each sound, and where each token starts."""

    def __init__(self, keys: list[str | None]):
        sizes = [len(k or "") for k in keys]
        self.sounds = codes("".join(k or "" for k in keys))
        self.token = np.repeat(np.arange(len(keys)), sizes)
        self.ends = np.cumsum(sizes, dtype="i8")
        self.starts = self.ends - np.array(sizes, "i8")

    def __len__(self) -> int:
        return len(self.sounds)


def band_distances(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, length: int, band: int, wanted: list[int]) -> dict[int, np.ndarray]:
    """Edit distances of stretches of ``a`` from the places ``at_a`` and of ``b`` from ``at_b``, all pairs at once.

    For each wanted length: [pairs, 2 * band + 1], the first ``length`` sounds of a against ``length + k`` of b, for k
    in -band .. band. Distances over ``band`` are not exact; there are no sounds beyond the end of ``b``.
    """
    offsets = np.arange(-band, band + 1)
    beyond = 1 << 20
    row = np.where(offsets >= 0, offsets, beyond)[None, :].repeat(len(at_a), 0)
    padded = np.concatenate([b, np.full(length + band + 1, -1)])
    out = {0: row}
    for n in range(1, length + 1):
        other = n + offsets  # how many sounds of b
        place = at_b[:, None] + np.maximum(other - 1, 0)[None, :]
        differ = (padded[np.minimum(place, len(padded) - 1)] != a[np.minimum(at_a + n - 1, len(a) - 1)][:, None]).astype("i8")
        into = np.minimum(row + differ, np.append(row[:, 1:] + 1, np.full((len(row), 1), beyond), 1))
        into = np.where(other[None, :] > 0, into, np.where(other[None, :] == 0, n, beyond))
        row = np.minimum.accumulate(into - offsets, axis=1) + offsets
        if n in wanted:
            out[n] = row
    return out


# Fixed tables of the search for repeats: bits and slack by length.
PLACES, FAR = 2048, MOST_SOUNDS + MOST_GAP
LOW_BITS = np.array([(1 << k) - 1 for k in range(MOST_SOUNDS + 1)], "u8")
SLACK = np.array([slack(k, REPEAT_EDITS) for k in range(MOST_SOUNDS + 1)])


def repeats(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a stretch is said again right after itself: start, length and gap; of each start the longest, then closest."""
    every = np.concatenate([np.zeros((3, 0), "i8"), *(_repeats_from(s, lo) for lo in range(0, len(s), PLACES))], 1)
    order = np.lexsort((every[2], -every[1], every[0]))
    every = every[:, order]
    first = np.r_[True, every[0, 1:] != every[0, :-1]] if every.shape[1] else np.zeros(0, bool)
    return tuple(every[:, first])


def _repeats_from(s: np.ndarray, lo: int) -> np.ndarray:
    """Repeats that start at PLACES places from ``lo`` on: [start, length, gap] of every length and gap.

    All seeds at all distances go on together, a sound a step. A column of a pair's table of edit distances is 64 bits
    of ups and 64 of downs (Myers), as no stretch is longer; the table's diagonal never falls, so a pair is given up
    when that is over what its longest stretch may differ in.
    """
    n, places = len(s), min(PLACES, len(s) - lo)
    symbols, code = np.unique(s[lo : lo + places + FAR + MOST_SOUNDS], return_inverse=True)
    has = np.zeros((len(symbols) + 1, places), "u8")  # bit t: this sound stands t sounds after this place
    for t in range(min(MOST_SOUNDS, len(code))):
        some = code[t : t + places]
        has[some, np.arange(len(some))] |= np.uint64(1 << t)
    seeds = []
    for distance in range(min(FAR, len(code) - SEED), LEAST_SOUNDS - 1, -1):
        same = code[: len(code) - distance] == code[distance:]
        at = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        at = at[at < places]
        seeds.append(np.stack([at, np.full(len(at), distance)]))
    at, apart = np.concatenate(seeds, 1) if seeds else np.zeros((2, 0), "i8")
    code = np.r_[code, np.full(FAR + MOST_SOUNDS, len(symbols))]  # nothing is like what lies beyond the end
    ups, downs, one = np.full(len(at), ~np.uint64(0)), np.zeros(len(at), "u8"), np.uint64(1)
    out = [np.zeros((3, 0), "i8")]
    for k in range(1, MOST_SOUNDS + 1):
        on = int(np.searchsorted(-apart, -k, "right"))  # farther ones stand in front
        at, apart, ups, downs = at[:on], apart[:on], ups[:on], downs[:on]
        if not on:
            break
        equal = has[code[at + apart + k - 1], at] | downs
        down = ((ups + (equal & ups)) ^ ups) | equal
        right_up, right_down = ((downs | ~(ups | down)) << one) | one, (ups & down) << one
        downs, ups = right_up & down, right_down | ~(right_up | down)
        edits = k + np.bitwise_count(ups & LOW_BITS[k]).astype("i8") - np.bitwise_count(downs & LOW_BITS[k])
        if k >= LEAST_SOUNDS:
            ok = (apart - k <= MOST_GAP) & (edits <= SLACK[k]) & (lo + at + apart + k <= n) & (k <= (n - lo - at) // 2)
            out.append(np.stack([lo + at[ok], np.full(ok.sum(), k), apart[ok] - k]))
        if k % 4 == 0:
            alive = edits <= SLACK[np.minimum(apart, MOST_SOUNDS)]
            at, apart, ups, downs = at[alive], apart[alive], ups[alive], downs[alive]
    return np.concatenate(out, 1)


def place_in(run: np.ndarray, text: np.ndarray) -> int:
    """Where in ``text`` a stretch as long as ``run`` (at its end: at least four sounds) reads most like it; -1 if none does."""
    starts = np.arange(max(0, len(text) - min(len(run), 4) + 1))
    band = slack(len(run), PLACE_EDITS)
    if not len(starts):
        return -1
    left = np.minimum(len(run), len(text) - starts) - len(run)  # short by so many at the text's end
    apart = band_distances(run, text, np.zeros(len(starts), "i8"), starts, len(run), band, [len(run)])[len(run)]
    apart = np.where(left >= -band, apart[np.arange(len(starts)), np.maximum(band + left, 0)], band + 1)
    best = int(apart.argmin())
    return best if apart[best] <= band else -1


def corrections(words: list[str], keys: list[str], ref_words: list[str], ref_keys: list[str], ref_padas: list[int | None]) -> list[dict]:
    """Repeats and restarts of one take, from its start on; a correction's sounds aren't part of another one."""
    heard, ref = Stream(keys), Stream(ref_keys)
    out: list[dict] = []
    starts, lengths, gaps = repeats(heard.sounds)
    first_of: dict[int, int] = {}
    for token, pada in enumerate(ref_padas[: len(ref_keys)]):
        if pada is not None:
            first_of.setdefault(pada, token)
    begins = sorted((int(ref.starts[token]), pada, token) for pada, token in first_of.items())
    free = 0
    for i, length, gap in zip(starts.tolist(), lengths.tolist(), gaps.tolist()):
        if i < free:
            continue
        last, second = min(len(heard) - 1, i + 2 * length + gap - 1), min(len(heard) - 1, i + length + gap)
        if heard.token[i] == heard.token[last]:  # the recogniser's echo inside one word
            free = i + length
            continue
        run = heard.sounds[i : i + length]
        aksharas = int(np.isin(run, codes("aeiou")).sum())
        at = place_in(run, ref.sounds) if aksharas >= RESTART_AKSHARAS else -1
        again = next(((pada, token) for start, pada, token in begins if at >= 0 and abs(start - at) <= START_SLACK), None)
        here = int(heard.token[second])
        if again:
            out.append({"kind": "restart", "word": ref_words[again[1]], "at": here, "pada": again[0], "ref_index": again[1]})
        else:
            said = words[heard.token[i] : heard.token[i + length - 1] + 1]
            out.append({"kind": "repeat", "word": " ".join(said), "at": here, "pada": None, "ref_index": None})
        free = i + 2 * length + gap
    return out


FOUND = pa.struct([("kind", pa.string()), ("word", pa.string()), ("at", pa.int32()), ("pada", pa.int32()), ("ref_index", pa.int32())])


def find_self_corrections(takes: DataFrame, heard: str, ref: str, ref_padas: str | None = None, out: str = "corrections") -> DataFrame:
    """Add ``out``: what was said again in each take. ``heard``, ``ref``: arrays of struct<word, norm>; ``ref_padas``: the
    pāda in which each word of the text begins, where it is known."""

    def run(*columns: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns))
        return pa.array([corrections(*(v or [] for v in row)) for row in rows], pa.list_(FOUND))

    keys = lambda c: F.transform(F.col(f"{c}.norm"), phonetic_key)
    padas = F.col(ref_padas) if ref_padas else F.array().cast("array<int>")
    kind = "array<struct<kind string, word string, at int, pada int, ref_index int>>"
    return takes.withColumn(out, sliced(run, kind, F.col(f"{heard}.word"), keys(heard), F.col(f"{ref}.word"), keys(ref), padas))


def padas_of(words: Column, per_pada: int) -> Column:
    """The pāda (1 to 4) in which each word begins, by the akṣaras before it.

    Sums run on in one fold: a lambda that names the counts would have all words counted again for each word.
    """
    sums = F.aggregate(akshara_counts(words), F.array(F.lit(0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
    before = F.slice(sums, F.lit(1), F.size(words))
    return F.transform(before, lambda n: F.least(F.lit(4), F.floor(n / per_pada) + 1).cast("int"))


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two stretches of equal length, or more than ``most``."""
    zero = np.zeros(1, "i8")
    return int(band_distances(a, b, zero, zero, len(a), most, [len(a)])[len(a)][0, most])


def boundary(keys: list[str], moments: list, ref: str, next_keys: list[str], next_moments: list, next_ref: str) -> float | None:
    """Where the later text begins by the words of two neighbouring stretches: seconds, or None where words say nothing.

    The later stretch may begin with the end of the earlier text (its longest such run of words counts); else the
    earlier stretch may end with the beginning of the later text.
    """
    ref_, next_ref_ = codes(ref), codes(next_ref)
    for own, of, text, of_tail in ((Stream(next_keys), next_moments, ref_, True), (Stream(keys), moments, next_ref_, False)):
        words = range(len(own.ends) - 1, 0, -1) if of_tail else range(1, len(own.ends))
        for k in words:
            length = int(own.ends[k - 1]) if of_tail else int(len(own) - own.ends[k - 1])
            if length > min(MOST_SOUNDS, len(text)):
                continue
            if length < LEAST_RUN:
                break
            run, other = (own.sounds[:length], text[len(text) - length :]) if of_tail else (own.sounds[-length:], text[:length])
            most = slack(length, BOUNDARY_EDITS)
            if edit_distance(run, other, most) <= most:
                return None if of[k] is None else max(0.0, of[k] - LEAD)
    return None


NEIGHBOURS, LEAST_MOVE, LEAST_REST, LEAST_SHARE = 1.0, 0.4, 1.0, 0.5


def refine_boundaries(segments: DataFrame, take: list[str], start: str = "start", stop: str = "stop", words: str = "words", moments: str = "moments", ref: str = "ref", item: str = "item") -> DataFrame:
    """Segments with their windows moved to where the words of their texts begin, and ``refined``.

    What the words say of each pair of neighbours doesn't depend on the windows, so pairs are judged as rows; only the
    guards do (a moved window is the next pair's window), in a fold over the segments of a take. A boundary stays where
    it moves by 0.4 s or less, leaves less than a second of either stretch, or passes the middle of one.
    """
    by_time = W.partitionBy(*take).orderBy(start, stop, item)
    key = lambda c: F.transform(F.col(c), phonetic_key)
    later = lambda c: F.lead(c).over(by_time)
    own = segments.withColumn("__keys", key(words)).withColumn("__ref", F.array_join(key(ref), ""))
    pairs = own.select("*", *[later(c).alias(f"__next{c.strip('_')}") for c in ("__keys", moments, "__ref", item)], F.row_number().over(by_time).alias("__k"))

    def run(*columns: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns))
        return pa.array([None if any(v is None for v in row) else boundary(*row) for row in rows], pa.float64())

    args = ["__keys", moments, "__ref", "__nextkeys", f"__next{moments.strip('_')}", "__nextref"]
    other = ~F.col(item).eqNullSafe(F.col(f"__next{item.strip('_')}"))
    said = F.when(other, F.arrow_udf(run, "double")(*[F.col(c) for c in args]))
    row = F.struct(F.col("__k").alias("k"), F.col(start).cast("double").alias("start"), F.col(stop).cast("double").alias("stop"), F.col("__said").alias("said"))
    folded = pairs.withColumn("__said", said).groupBy(*take).agg(F.sort_array(F.collect_list(row)).alias("s"))

    def step(done: Column, b: Column) -> Column:
        a = F.element_at(done, -1)
        to = a["said"]
        moves = (a["stop"] >= b["start"] - NEIGHBOURS) & (F.abs(to - b["start"]) > LEAST_MOVE) & (to > a["start"] + LEAST_REST) & (to < b["stop"] - LEAST_REST)
        inside = (to <= b["start"] + LEAST_SHARE * (b["stop"] - b["start"])) & (to >= a["stop"] - LEAST_SHARE * (a["stop"] - a["start"]))
        ok = F.coalesce(moves & inside, F.lit(False))
        put = lambda x, s, e, r: F.struct(x["k"].alias("k"), s.alias("start"), e.alias("stop"), x["said"].alias("said"), r.alias("refined"))
        before = F.slice(done, 1, F.size(done) - 1)
        a_, b_ = put(a, a["start"], F.when(ok, to).otherwise(a["stop"]), a["refined"] | ok), put(b, F.when(ok, to).otherwise(b["start"]), b["stop"], ok)
        return F.concat(before, F.array(a_, b_))

    head = F.transform(F.slice("s", 1, 1), lambda x: F.struct(x["k"].alias("k"), x["start"].alias("start"), x["stop"].alias("stop"), x["said"].alias("said"), F.lit(False).alias("refined")))
    windows = folded.select(*take, F.explode(F.aggregate(F.slice("s", 2, F.greatest(F.size("s"), F.lit(1))), head, step)).alias("w"))
    windows = windows.select(*take, F.col("w.k").alias("__k"), F.col("w.start").alias("__start"), F.col("w.stop").alias("__stop"), F.col("w.refined").alias("refined"))
    numbered = segments.drop("refined").withColumn("__k", F.row_number().over(by_time))
    joined = numbered.join(windows, [*take, "__k"])
    return joined.withColumn(start, F.col("__start")).withColumn(stop, F.col("__stop")).drop("__k", "__start", "__stop")


TURNS_A_TASK = 2000


def turn_words(spark: SparkSession, d: str) -> DataFrame:
    """Turns as takes: their tokens, and those of the turn before as the text that was to be recited.

    Keys of words take far longer than their bytes say: turns are dealt out by their number.
    """
    by = W.partitionBy("conv_id").orderBy("turn")
    t = V.table(spark, d, "conversations")
    tasks = max(spark.sparkContext.defaultParallelism, -(-t.count() // TURNS_A_TASK))
    t = t.select("conv_id", "turn", "text", F.lag("text").over(by).alias("ref")).where("ref IS NOT NULL").repartition(tasks, "conv_id", "turn")
    return t.select("conv_id", "turn", tokens(F.col("text")).alias("heard"), tokens(F.col("ref")).alias("ref"))


def q_self_corrections(spark: SparkSession, d: str) -> DataFrame:
    takes = turn_words(spark, d).withColumn("padas", padas_of(F.col("ref.word"), 8))
    found = find_self_corrections(takes, "heard", "ref", "padas")
    return found.select("conv_id", "turn", F.posexplode("corrections").alias("nr", "c")).select("conv_id", "turn", "nr", "c.*")


def q_refine_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Turns as stretches of ten seconds, each closed three words early: the next one begins with the end of its text."""
    by = W.partitionBy("conv_id").orderBy("turn")
    words = F.col("own.word")
    t = V.table(spark, d, "conversations").select("conv_id", "turn", tokens(F.col("text")).alias("own")).where("size(own) > 6")
    tail = F.coalesce(F.slice(F.lag(words).over(by), -3, 3), F.array().cast("array<string>"))
    last = F.when(F.lead("turn").over(by).isNull(), 0).otherwise(3)
    s = t.select("conv_id", "turn", tail.alias("tail"), words.alias("ref"), F.slice(words, F.lit(1), F.size("own") - last).alias("said"))
    s = s.select("conv_id", "turn", "ref", F.concat("tail", "said").alias("words"), (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 10).alias("stop"))
    moments = F.transform("words", lambda _, k: F.col("start") + 10 * (k + 0.5) / F.size("words"))
    moved = refine_boundaries(s.withColumn("moments", moments), ["conv_id"], item="turn")
    return moved.select("conv_id", "turn", F.round("start", 6).alias("start"), F.round("stop", 6).alias("stop"), "refined")


QUERIES = {"find_self_corrections": q_self_corrections, "refine_boundaries": q_refine_boundaries}
ORACLE: dict[str, str] = {}
