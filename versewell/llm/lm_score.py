"""LM scoring: a hashed maximum-entropy model of the next word.

Words are runs of non-space bytes, A-Z lower-cased; every text ends with one end token. Words of more than KEY_BYTES
bytes go by their SHA-256. A word's outcome is its own (the TOP most frequent words) or one of TAIL hashed ones;
outcomes are ordered by frequency and dealt to CLASSES classes, so that

    P(word | context) = P(class | context) * P(outcome | class, context) * P(word | outcome).

The first two are softmaxes over hashed context features (the previous word, the two previous words, and the
word before the previous one alone), on top of corpus frequencies as bias: a row of weights for each of BUCKETS
contexts of a feature, and one for each of MEMBER_ROWS hashed pairs of context and class. The last is the word's
share of its outcome, with one added to each count and one unseen word.

Counting covers all training texts. Training goes EPOCHS times over them, in PARTS steps each: every task sums the
gradient of its texts in numpy and sends the rows that they touch, Spark adds them up, and the driver, which only
ever holds the weights, whose number is fixed, takes the step (AdaGrad). Tasks read as much text as outweighs
what they send. Scoring needs each word's count, and the table of counts grows with the corpus: the HEAD most frequent
words travel with the model (a bounded table, from a histogram of counts), all other words of a text, each of which
is at most 1 / HEAD of all tokens, are joined to the counts by a shuffle.

Texts are split by Arrow in pieces of about READ_BYTES; longer ones than SLICE_BYTES are read in stretches of about that
size, the words before a stretch going with it as context. Words are counted by Arrow over COUNT_BYTES of them at a time.

Defined results: a null text is the empty one, which is its end token alone; repeated rows are scored each;
with no training text, N and V are 0 and every count is 0; texts of any length are read whole; outputs take the
place of columns of their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versewell.llm.common import Scratch, held_out, others, released, table

CLASSES, MEMBERS, TAIL = 32, 32, 128
TOP = CLASSES * MEMBERS - TAIL
FEATURES, BUCKETS, MEMBER_ROWS = 3, 1 << 13, 1 << 16
HEAD, KEY_BYTES = 1 << 16, 32
EPOCHS, PARTS, RATE, DAMPING, LIMIT = 2, 2, 0.7, 8.0, 6.0
END = b" "
SLICE_BYTES, READ_BYTES, COUNT_BYTES = 1 << 19, 1 << 22, 1 << 24
CHUNK, BLOCK, TASK_TOKENS, LEAST_TASKS = 1 << 16, 1 << 11, 1 << 25, 4  # small blocks of probabilities measured faster
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_CRC = np.array([zlib.crc32(bytes([k ^ 255])) for k in range(256)], "u4") ^ np.uint32(0xFF000000)  # what each byte adds


def _words(raw: bytes) -> list[bytes]:
    return [w if len(w) <= KEY_BYTES else hashlib.sha256(w).digest() for w in raw.lower().split()]


def tokens(text: str | None) -> list[bytes]:
    return [*_words((text or "").encode()), END]


def _stretches(texts: pa.Array) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """(place of the text, number of words that are context only, words) in lists of bounded size."""
    held, size = [], 0
    for place, text in enumerate(texts):
        raw, at, before = (text.as_py() or "").encode(), 0, []
        while True:
            end = at + SLICE_BYTES
            cut = _SPACE.search(raw, end) if end < len(raw) else None
            end = cut.start() if cut else len(raw)
            words = _words(raw[at:end]) + ([] if cut else [END])
            held.append((place, len(before), before + words))
            size += end - at + 64
            if size > SLICE_BYTES:
                yield held
                held, size = [], 0
            if not cut:
                break
            at, before = end, (before + words)[-2:]
    if held:
        yield held


class Piece(NamedTuple):
    places: np.ndarray  # of the texts
    lengths: np.ndarray  # words of each
    skips: np.ndarray  # how many of them are context only
    words: pa.BinaryArray

    def counted(self) -> np.ndarray:
        """Which words are more than context."""
        counts = np.ones(len(self.words), bool)
        for k in np.flatnonzero(self.skips):
            start = self.lengths[:k].sum()
            counts[start : start + self.skips[k]] = False
        return counts


def _piece(part: list[tuple[int, int, list[bytes]]]) -> Piece:
    places, skips, lengths = (np.array(x, "i8") for x in zip(*[(k, skip, len(words)) for k, skip, words in part]))
    return Piece(places, lengths, skips, pa.array([w for _, _, words in part for w in words], pa.binary()))


def _pieces(texts: pa.Array) -> Iterator[Piece]:
    """The words of all texts, in their order, in pieces of bounded size."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("i8")
    long, part = sizes > SLICE_BYTES, np.cumsum(sizes + 64) // READ_BYTES
    edges = np.flatnonzero((part[1:] != part[:-1]) | long[1:] | long[:-1]) + 1
    for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(texts)]):
        some = texts.slice(start, end - start)
        if start < end and long[start]:
            for stretch in map(_piece, _stretches(some)):
                yield stretch._replace(places=stretch.places + start)
        elif start < end:
            nothing, space = pa.scalar("", some.type), pa.scalar(" ", some.type)
            said = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(some, nothing)))
            said = pc.if_else(pc.equal(said, nothing), nothing, pc.binary_join_element_wise(said, nothing, space))  # an empty word for each end
            split = pc.ascii_split_whitespace(said)
            words = split.flatten().cast(pa.binary())
            size = pc.binary_length(words)
            words = pc.if_else(pc.equal(size, 0), pa.scalar(END), words)
            if pc.max(size).as_py() > KEY_BYTES:
                large = pc.greater(size, KEY_BYTES)
                words = pc.replace_with_mask(words, large, pa.array([hashlib.sha256(w).digest() for w in words.filter(large).to_pylist()], pa.binary()))
            yield Piece(np.arange(start, end), np.diff(split.offsets.to_numpy()).astype("i8"), np.zeros(end - start, "i8"), words)


def count_words(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) over all texts, end tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            told = pc.value_counts(pa.chunked_array(held, pa.binary()))
            held.clear()
            return pa.RecordBatch.from_arrays([told.field("values"), told.field("counts")], ["word", "c"])

        for batch in released(batches):
            for piece in _pieces(batch.column(text)):
                held.append(piece.words.filter(pa.array(piece.counted())) if piece.skips.any() else piece.words)
                size += held[-1].nbytes
                if size > COUNT_BYTES:
                    yield flush()
                    size = 0
        yield flush()

    return df.select(text).mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _crc32(words: pa.BinaryArray, places: np.ndarray) -> np.ndarray:
    """CRC-32 of the words at some places, a byte of all of them at once; words are short."""
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, "i4")[words.offset : words.offset + len(words) + 1]
    sizes = offsets[places + 1] - offsets[places]
    order = np.argsort(-sizes, kind="stable")  # those that have a k-th byte come first
    starts, raw, left = offsets[places[order]], np.frombuffer(data or b"", "u1"), np.cumsum(np.bincount(sizes)[::-1])[::-1]
    crc = np.full(len(places), 0xFFFFFFFF, "u4")
    for k, n in enumerate(left[1:]):
        crc[:n] = _CRC.take((crc[:n] ^ raw.take(starts[:n] + k)) & 255) ^ crc[:n] >> 8
    out = np.empty_like(crc)
    out[order] = ~crc
    return out


@dataclass
class Model:
    total: int  # N
    distinct: int  # V
    words: list[bytes]  # the most frequent ones, most frequent first
    counts: np.ndarray  # theirs
    mass: np.ndarray  # count of each outcome
    kinds: np.ndarray  # distinct words of each outcome
    class_w: np.ndarray  # [FEATURES * BUCKETS, CLASSES]
    member_w: np.ndarray  # [MEMBER_ROWS, MEMBERS]


class Reader:
    """Turns texts into arrays by a model; one per Python worker and model."""

    def __init__(self, m: Model):
        self.m = m
        self.head = pa.array(m.words, pa.binary())
        self.crc = np.array([zlib.crc32(w) for w in m.words] or [0], "u4")
        self.outcome = np.where(np.arange(len(self.crc)) < TOP, np.arange(len(self.crc)), TOP + self.crc % TAIL).astype("i4")
        mass = m.mass.reshape(CLASSES, MEMBERS) + 0.5
        self.member_bias = (mass / mass.sum(1, keepdims=True)).astype("f4")
        # exponentials are taken of weights, not for each word; weights are bounded, so that no product overflows
        self.class_e, self.member_e = np.exp(m.class_w), np.exp(m.member_w)
        self.class_e[:BUCKETS] *= (mass.sum(1) / mass.sum()).astype("f4")  # each word has one row of the first feature

    def read(self, part: Piece | list[tuple[int, int, list[bytes]]]):
        """Words, which of them count, place in the head (-1: none) and outcome of each; hashed contexts [FEATURES, words]."""
        piece = part if isinstance(part, Piece) else _piece(part)
        lengths, words = piece.lengths, piece.words
        place = pc.fill_null(pc.index_in(words, value_set=self.head), -1).to_numpy(zero_copy_only=False)
        crc, outcome = self.crc[place], self.outcome[place]
        other = np.flatnonzero(place < 0)
        crc[other] = _crc32(words, other)
        outcome[other] = TOP + crc[other] % TAIL
        starts = np.cumsum(lengths) - lengths
        one, two = np.roll(crc, 1), np.roll(crc, 2)
        one[starts] = two[starts] = 1
        two[starts[lengths > 1] + 1] = 1
        mix = lambda x: (x ^ x >> np.uint32(15)) * np.uint32(2654435761)
        return words, lengths, piece.counted(), place, outcome, np.stack([mix(one), mix(one * np.uint32(31) + two), mix(two ^ np.uint32(0x5BD1E995))])

    @staticmethod
    def rows(contexts: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of class_w and of member_w, [FEATURES, words] each."""
        own = (contexts >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype("i8") + np.arange(FEATURES)[:, None] * BUCKETS
        salted = (contexts ^ (cls.astype("u4") * np.uint32(FEATURES) + np.arange(FEATURES, dtype="u4")[:, None]) * np.uint32(0x9E3779B1)) * np.uint32(0x85EBCA6B)
        return own, (salted >> np.uint32(32 - MEMBER_ROWS.bit_length() + 1)).astype("i8")

    def shares(self, outcome: np.ndarray, own: np.ndarray, of_class: np.ndarray):
        """What classes [n, CLASSES] and members of each token's own class [n, MEMBERS] are in proportion to, and the sums of both."""
        p = self.class_e.take(own[0], 0)
        q = self.member_e.take(of_class[0], 0)
        for f in range(1, FEATURES):
            p *= self.class_e.take(own[f], 0)
            q *= self.member_e.take(of_class[f], 0)
        q *= self.member_bias.take(outcome // MEMBERS, 0)
        return p, q, p @ np.ones(CLASSES, "f4"), q @ np.ones(MEMBERS, "f4")

    def probabilities(self, outcome: np.ndarray, own: np.ndarray, of_class: np.ndarray):
        """P(class | context) [n, CLASSES] and P(member | class, context) [n, MEMBERS] for each token's own class."""
        p, q, of_p, of_q = self.shares(outcome, own, of_class)
        p /= of_p[:, None]
        q /= of_q[:, None]
        return p, q


def add_gradient(reader: Reader, part: Piece | list[tuple[int, int, list[bytes]]], class_g: np.ndarray, member_g: np.ndarray) -> None:
    """Add the gradient of the log-likelihood (observed less expected features) of texts; [CLASSES, rows] both.

    A piece is summed in single precision, which is faster and loses under a thousandth. Two columns are added at once,
    as the parts of a complex number.
    """
    _, _, counts, _, outcome, contexts = reader.read(part)
    keep = np.flatnonzero(counts)
    class_s, member_s = np.zeros((CLASSES // 2, class_g.shape[1]), "c8"), np.zeros((MEMBERS // 2, member_g.shape[1]), "c8")
    class_x, member_x = (np.empty((n // 2, min(len(keep), CHUNK)), "c8") for n in (CLASSES, MEMBERS))
    for at in range(0, len(keep), CHUNK):
        mine = keep[at : at + CHUNK]
        y, ctx = outcome[mine], contexts[:, mine]
        own, of_class = reader.rows(ctx, y // MEMBERS)
        p, q = class_x[:, : len(mine)], member_x[:, : len(mine)]
        for k in range(0, len(mine), BLOCK):
            here, twice = slice(k, k + BLOCK), slice(2 * k, 2 * (k + BLOCK))
            *shares, of_p, of_q = reader.shares(y[here], own[:, here], of_class[:, here])
            for x, whole, seen, to in zip(shares, (of_p, of_q), (y[here] // MEMBERS, y[here] % MEMBERS), (p, q)):
                x.reshape(-1)[np.arange(len(x)) * x.shape[1] + seen] -= whole
                to[:, here] = x.view("c8").T
                to.view("f4")[:, twice] *= np.repeat(1 / whole, 2)
        for to, rows, values in ((class_s, own, p), (member_s, of_class, q)):
            for k, column in enumerate(values):
                for f in range(FEATURES):
                    np.add.at(to[k], rows[f], column)
    for to, sums in ((class_g, class_s), (member_g, member_s)):
        to[0::2] -= sums.real
        to[1::2] -= sums.imag


def _gradient(df: DataFrame, model: Model, text: str) -> np.ndarray:
    """Sum of gradients over all texts, [FEATURES * BUCKETS + MEMBER_ROWS, CLASSES]."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, g = Reader(held.value), np.zeros((CLASSES, FEATURES * BUCKETS + MEMBER_ROWS))
        for batch in released(batches):
            for piece in _pieces(batch.column(text)):
                add_gradient(reader, piece, g[:, : FEATURES * BUCKETS], g[:, FEATURES * BUCKETS :])
        some = np.flatnonzero(g.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array(x[some], pa.float32()) for x in g]], ["row", *names])

    names = [f"g{k}" for k in range(CLASSES)]
    tasks = max(LEAST_TASKS, -(-model.total // TASK_TOKENS))
    sums = df.select(text).coalesce(tasks).mapInArrow(run, ", ".join(["row int", *[f"{n} float" for n in names]]))
    found = sums.groupBy("row").agg(*[F.sum(n).cast("float").alias(n) for n in names]).toArrow()  # a row for each row of weights at most
    out = np.zeros((FEATURES * BUCKETS + MEMBER_ROWS, CLASSES), "f4")
    out[found["row"].to_numpy()] = np.stack([found[n].to_numpy() for n in names], 1)
    held.destroy()
    return out


def frequent(counts: DataFrame, most: int | None = None) -> DataFrame:
    """The most frequent words, at most HEAD: the upper bins of a histogram of counts, and a share by hash of the next.

    The histogram has 16 bins for each doubling, so that neither it nor the words grow with the corpus.
    """
    binned = counts.withColumn("bin", F.floor(F.log2("c") * 16))
    left = HEAD if most is None else most
    for r in sorted(binned.groupBy("bin").count().collect(), reverse=True):
        if r["count"] > left:
            share = F.pmod(F.xxhash64("word"), F.lit(r["count"])) < max(left - 6 * math.isqrt(left), 0)
            return binned.where((F.col("bin") > r.bin) | ((F.col("bin") == r.bin) & share)).drop("bin")
        left -= r["count"]
    return counts


def train(df: DataFrame, counts: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Fit the model on all rows of ``df``; ``counts`` as from ``count_words`` over the same rows."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = frequent(counts).toPandas().sort_values(["c", "word"], ascending=[False, True], ignore_index=True)
    words = [bytes(w) for w in head["word"]]
    outcome = F.lit(TOP) + F.crc32("word") % TAIL
    tail = counts.groupBy(outcome.alias("o")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()  # TAIL rows
    mass, kinds = np.zeros(TOP + TAIL), np.zeros(TOP + TAIL)
    for r in tail:
        mass[r.o], kinds[r.o] = r.c, r.n
    for k, (word, c) in enumerate(zip(words[:TOP], head["c"][:TOP])):  # these are no part of it
        o = TOP + zlib.crc32(word) % TAIL
        mass[k], mass[o], kinds[o] = c, mass[o] - c, kinds[o] - 1
    w = np.zeros((FEATURES * BUCKETS + MEMBER_ROWS, CLASSES), "f4")
    model = Model(int(total), int(distinct), words, head["c"].to_numpy("i8"), mass, kinds, w[: FEATURES * BUCKETS], w[FEATURES * BUCKETS :])
    squares, part = np.full_like(w, DAMPING**2), F.pmod(F.xxhash64(F.col(key)), F.lit(PARTS))
    for step in range(EPOCHS * PARTS):
        g = _gradient(df.where(part == step % PARTS), model, text)
        squares += g * g
        w += RATE * g / np.sqrt(squares)
        np.clip(w, -LIMIT, LIMIT, out=w)
    return model


def score(df: DataFrame, counts: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score and score to every row."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    held = spark.sparkContext.broadcast(model)
    shape = pa.struct([("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("words", pa.list_(pa.binary()))])

    @F.arrow_udf("struct<n_tokens bigint, known bigint, base double, score double, words array<binary>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(held.value)
        logs = np.append(np.log10(reader.m.counts + 1.0), 0.0)  # of head words; 0 at place -1
        size = np.log10(np.maximum(reader.m.mass + reader.m.kinds + 1, 1))
        size[:TOP] = 0
        for batch in released(batches):
            sums, rare, owner = np.zeros((4, len(batch))), [], []
            for piece in _pieces(batch):
                words, lengths, counts, place, outcome, contexts = reader.read(piece)
                told = np.empty(len(words))
                for at in range(0, len(words), BLOCK):
                    y, here = outcome[at : at + BLOCK], place[at : at + BLOCK]
                    p, q, of_p, of_q = reader.shares(y, *reader.rows(contexts[:, at : at + BLOCK], y // MEMBERS))
                    n = np.arange(len(y))
                    told[at : at + BLOCK] = np.log10(p[n, y // MEMBERS] / of_p) + np.log10(q[n, y % MEMBERS] / of_q) - size[y] + np.where(y < TOP, 0, logs[here])
                text_of = np.repeat(piece.places, lengths)
                for k, values in enumerate((np.ones(len(words)), place >= 0, logs[place], told)):
                    sums[k] += np.bincount(text_of, values * counts, len(batch))
                others = np.flatnonzero((place < 0) & counts)
                rare.append(words.take(pa.array(others)))
                owner.append(text_of[others])
            each = np.bincount(np.concatenate(owner), minlength=len(batch)) if owner else np.zeros(len(batch), "i8")
            words = pa.concat_arrays(rare) if rare else pa.array([], pa.binary())
            words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), words)
            columns = [pa.array(sums[0].astype("i8")), pa.array(sums[1].astype("i8")), pa.array(sums[2]), pa.array(sums[3]), words]
            yield pa.StructArray.from_arrays(columns, fields=list(shape))

    own = others(df, text, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    first = df.withColumn("__s", run(F.col(text))).select(F.monotonically_increasing_id().alias("__row"), *own, "__s")
    first = scratch.write(first)
    pairs = first.select("__row", F.explode("__s.words").alias("word"))
    rare = pairs.join(counts, "word").groupBy("__row").agg(F.count("*").alias("__k"), F.sum(F.log10(F.col("c") + 1)).alias("__log"))
    slim = first.withColumn("__s", F.struct(*[F.col(f"__s.{c}") for c in ("n_tokens", "known", "base", "score")]))
    told = slim.join(rare, "__row", "left")
    log = F.coalesce("__log", F.lit(0.0))
    whole = math.log10(model.total + model.distinct + 1)
    return told.select(
        *own, F.col("__s.n_tokens").alias("n_tokens"), (F.col("__s.known") + F.coalesce("__k", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), (F.col("__s.base") + log - F.col("__s.n_tokens") * whole).alias("base_score"),
        (F.col("__s.score") + log).alias("score"),
    )


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all whole texts of ``documents``, learning from those that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), "text")
    learn = docs.where("NOT held_out")
    counts = Scratch(spark).write(count_words(learn))
    return score(docs, counts, train(learn, counts))
