"""Language ID: a bidirectional gated recurrent network over bytes.

One recurrent layer with update and reset gates reads a text forward and one backward; at every byte both states
give a distribution over the languages, and a document's distribution is the mean over its bytes. Texts are read
whole. So that long ones neither take one step per byte alone nor hold all states, they are cut into stretches of
WINDOW bytes that run side by side; a layer enters each stretch with the state of the WARM bytes that it would
have read before it.

Training is backpropagation through time in numpy on a bounded sample of pieces of PIECE characters. All pieces of
all whole training texts can be drawn, by hash: about SAMPLE in all, evenly by language, of at most MOST_LANGS
languages (those with the most pieces, ties by name). The sample and the model (some thousand numbers) are
all that meets on the driver.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is everything if no row
can be learned from; a null lang is not learned from; repeated rows are predicted each; equal scores go to the
first language by name; extra columns are kept, unless they have an output's name; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versewell.llm.common import held_out, others, released, table

SAMPLE, PIECE, MOST_LANGS = 16384, 96, 256
HIDDEN, STEPS, BATCH, RATE, SEED = 16, 140, 96, 0.03, 7
WINDOW, WARM = 512, 24
SCALE = np.array([-1.0, -1.0, 2.0])
#: stretches that run side by side, and the most numbers of a direction's outputs that are held at once
LANES, HELD = 512, 1 << 23


class Layer:
    """One direction: h' = h + z (c - h), z and r logistic gates, c = tanh(in_c + r (h u_c)).

    ``w_in`` [256, 3 H] is a byte's input to z, r and c; ``u`` [H, 3 H] that of the state before. Both functions are
    taken from the exponential, 1 / (1 + exp(-x)) and 1 - 2 / (1 + exp(2 x)), which numpy computes several times
    faster than tanh; -1 and 2 are in the weights already.
    """

    def __init__(self, w_in: np.ndarray, u: np.ndarray, out: np.ndarray):
        n = u.shape[0]
        split = lambda x: (np.ascontiguousarray(x[:, : 2 * n]), np.ascontiguousarray(x[:, 2 * n :]))
        (self.in_g, self.in_c), (self.u_g, self.u_c) = split(w_in * SCALE.repeat(n).astype(u.dtype)), split(u * SCALE.repeat(n).astype(u.dtype))
        self.u, self.out, self.n = split(u), out, n

    @np.errstate(over="ignore")
    def run(self, seq: np.ndarray, keep: list | None = None, begin: np.ndarray | None = None) -> np.ndarray:
        """Share in the languages' logits, [time, language, lane], over bytes seq [time, lane].

        ``keep`` gets the steps; ``begin``: the time at which each lane begins, with a state of zero.
        """
        lanes, n, late = seq.shape[1], self.n, 0 if begin is None else begin.max()
        said, out = np.empty((len(seq), self.out.shape[1], lanes), self.out.dtype), np.ascontiguousarray(self.out.T)
        h, new = np.zeros((2, lanes, n), self.out.dtype)
        gates, more, c, of_h = (np.empty((lanes, k), self.out.dtype) for k in (2 * n, 2 * n, n, n))
        for t, b in enumerate(seq):
            np.take(self.in_g, b, axis=0, out=gates, mode="clip")
            gates += np.matmul(h, self.u_g, out=more)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            np.take(self.in_c, b, axis=0, out=c, mode="clip")
            np.matmul(h, self.u_c, out=of_h)
            if keep is not None:
                keep.append((h.copy(), gates.copy(), of_h / 2))
            of_h *= gates[:, n:]
            c += of_h
            np.exp(c, out=c)
            c += 1
            np.divide(-2, c, out=c)
            c += 1
            if keep is not None:
                keep[-1] += (c.copy(),)
            np.subtract(c, h, out=new)
            new *= gates[:, :n]
            new += h
            if t < late:
                new[begin > t] = 0
            np.matmul(out, new.T, out=said[t])
            h, new = new, h
        return said

    def back(self, seq: np.ndarray, steps: list, d_said: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of w_in, u and out."""
        n = self.n
        h, gates, of_h, c = (np.stack(x) for x in zip(*steps))
        z, r = gates[:, :, :n], gates[:, :, n:]
        to_c, to_z, to_r = z * (1 - c * c), (c - h) * z * (1 - z), of_h * r * (1 - r)
        d_states, stay = np.swapaxes(d_said, 1, 2) @ self.out.T, 1 - z
        d_in, d_of = np.empty((*seq.shape, 3 * n), d_said.dtype), np.empty_like(h)
        d_h = np.zeros_like(h[0])
        for t in range(len(seq) - 1, -1, -1):
            d_h += d_states[t]
            d_c = np.multiply(d_h, to_c[t], out=d_in[t, :, 2 * n :])
            np.multiply(d_h, to_z[t], out=d_in[t, :, :n])
            np.multiply(d_c, to_r[t], out=d_in[t, :, n : 2 * n])
            np.multiply(d_c, r[t], out=d_of[t])
            d_h *= stay[t]
            d_h += d_in[t, :, : 2 * n] @ self.u[0].T
            d_h += d_of[t] @ self.u[1].T
        flat = lambda x: x.reshape(-1, x.shape[2])
        d_u = np.concatenate([flat(h).T @ flat(d_in)[:, : 2 * n], flat(h).T @ flat(d_of)], 1)
        d_out = flat(h + z * (c - h)).T @ flat(np.swapaxes(d_said, 1, 2))
        order = np.argsort(seq, axis=None, kind="stable")
        bytes_, starts = np.unique(seq.ravel()[order], return_index=True)
        of_byte = np.zeros((256, 3 * n), d_said.dtype)
        of_byte[bytes_] = np.add.reduceat(flat(d_in)[order], starts, axis=0)
        return of_byte, d_u, d_out


class Model:
    """Languages and weights."""

    def __init__(self, langs: list[str]):
        rng, n = np.random.default_rng(SEED), HIDDEN
        self.langs = langs
        draw = lambda *shape: (rng.standard_normal(shape) * shape[0] ** -0.5).astype("f4")
        self.w = {k + d: draw(*s) for d in "fb" for k, s in (("in", (256, 3 * n)), ("u", (n, 3 * n)), ("out", (n, len(langs))))}
        self.w["inf"] *= 8
        self.w["inb"] *= 8
        self.w["bias"] = np.zeros(len(langs), "f4")

    def _layers(self) -> list[Layer]:
        return [Layer(self.w["in" + d], self.w["u" + d], self.w["out" + d]) for d in "fb"]

    def _distributions(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        p = forward
        p += backward
        p += self.w["bias"][:, None]
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return p

    def step(self, seq: np.ndarray, lang: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy over bytes; byte 0 is padding. seq [time, lane]."""
        (f, b), kept_f, kept_b = self._layers(), [], []
        back = np.ascontiguousarray(seq[::-1])
        d = self._distributions(f.run(seq, kept_f), b.run(back, kept_b)[::-1])
        d[:, lang, np.arange(len(lang))] -= 1
        d *= ((seq > 0) * weight)[:, None, :] / max(1.0, float(((seq > 0) * weight).sum()))
        grad = {"bias": d.sum((0, 2))}
        grad["inf"], grad["uf"], grad["outf"] = f.back(seq, kept_f, d)
        grad["inb"], grad["ub"], grad["outb"] = b.back(back, kept_b, np.ascontiguousarray(d[::-1]))
        return grad

    def train(self, pieces: list[bytes], lang: np.ndarray) -> Model:
        """Languages weigh the same whatever their share. Adam; every batch holds pieces of about one length."""
        rng, m, v = np.random.default_rng(SEED), {}, {}
        share = np.bincount(lang, minlength=len(self.langs)).clip(1)
        weight = (len(lang) / len(self.langs) / share)[lang].astype("f4")
        order = rng.permutation(len(lang))
        for t in range(1, STEPS + 1):
            if len(order) < min(BATCH, len(lang)):
                order = np.append(order, rng.permutation(len(lang)))
            rows, order = order[:BATCH], order[BATCH:]
            for k, g in self.step(_columns([pieces[r] for r in rows]), lang[rows], weight[rows]).items():
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                rate = RATE * (1 - t / (STEPS + 1))
                self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype("f4")
        return self

    def _stretches(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places [lane, 4] of text, begin, and the bytes of the stretch that count; distributions [time, language, lane])."""
        cuts = [(k, max(at - WARM, 0), at, min(at + WINDOW, len(x))) for k, x in enumerate(texts) for at in range(0, len(x), WINDOW)]
        cuts.sort(key=lambda c: c[3] - c[1])
        lanes = max(1, min(LANES, HELD // ((WINDOW + 2 * WARM) * len(self.langs))))
        forward, backward = self._layers()
        for at in range(0, len(cuts), lanes):
            mine = cuts[at : at + lanes]
            seq = _columns([texts[k][lo : hi + WARM] for k, lo, _, hi in mine])
            sizes = np.array([min(hi + WARM, len(texts[k])) - lo for k, lo, _, hi in mine])
            said = backward.run(seq[::-1], begin=len(seq) - sizes)[::-1]
            yield np.array(mine), self._distributions(forward.run(seq), said)

    def positions(self, text: bytes) -> np.ndarray:
        """Distribution at every byte of one text: [bytes, languages]."""
        out = np.zeros((len(text), len(self.langs)), "f4")
        for places, p in self._stretches([text]):
            for lane, (_, lo, begin, end) in enumerate(places.tolist()):
                out[begin:end] = p[begin - lo : end - lo, :, lane]
        return out

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean distribution of each text (all its bytes); zeros for an empty one."""
        total = np.zeros((len(texts), len(self.langs)))
        for places, p in self._stretches(texts):
            of, lo, begin, end = places.T
            time = np.arange(len(p))[:, None]
            p *= ((time >= begin - lo) & (time < end - lo))[:, None, :]
            np.add.at(total, of, p.sum(0).T)
        return total / np.maximum(total.sum(1, keepdims=True), 1e-9)


def _columns(texts: list[bytes]) -> np.ndarray:
    """Bytes [time, text] as places in a table, padded by 0."""
    longest = max(map(len, texts))
    rows = np.frombuffer(b"".join(x.ljust(longest, b"\0") for x in texts), "u1").reshape(len(texts), longest)
    return rows.T.astype("i8", order="C")


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model | None:
    """Learn from labelled rows; None if there are none."""
    rows = rows.where(F.col(lang).isNotNull() & has_letter(F.col(text))).select(F.col(lang).cast("string").alias("lang"), F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.withColumn("n", F.ceil(F.length("text") / PIECE))
    most = rows.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    if not most:
        return None
    each = SAMPLE // len(most)
    shares = rows.sparkSession.createDataFrame([(r.lang, -(-r.n // each)) for r in most], "lang string, every long")  # at most MOST_LANGS rows
    drawn = F.filter(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda k: F.pmod(F.xxhash64("key", k), F.col("every")) == 0)
    pieces = rows.join(F.broadcast(shares), "lang").select("lang", "text", F.explode(drawn).alias("k"))
    pieces = pieces.select("lang", F.col("text").substr((F.col("k") * PIECE + 1).cast("int"), F.lit(PIECE)).alias("piece"))
    sample = pieces.toPandas().sort_values(["piece", "lang"], ignore_index=True)
    langs = sorted(set(sample["lang"]))
    return Model(langs).train([x.encode() for x in sample["piece"]], np.array([langs.index(x) for x in sample["lang"]])) if langs else None


def identify(df: DataFrame, model: Model | None, text: str = "text", slice_bytes: int = 1 << 19) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (mean probability of that language over all bytes of the text)."""
    und = (F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if model is None:
        return df.select(*others(df, "lang_pred", "score"), *und)
    held = df.sparkSession.sparkContext.broadcast((model.langs, model.w))

    @F.arrow_udf("struct<lang_pred string, score double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = Model(held.value[0])
        net.w = held.value[1]
        for batch in released(batches):
            best, score = [], []
            step = max(1, int(len(batch) * slice_bytes / max(batch.nbytes, 1)))
            for at in range(0, len(batch), step):
                p = net.pooled([(x or "").encode() for x in batch.slice(at, step).to_pylist()])
                best += [net.langs[k] for k in p.argmax(1)]
                score += p.max(1).clip(0, 1).tolist()
            yield pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    found = df.withColumn("__lang", run(F.col(text)))
    known = has_letter(F.col(text))
    return found.select(
        *others(df, "lang_pred", "score"), F.when(known, F.col("__lang.lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(known, F.col("__lang.score")).otherwise(0.0).alias("score"),
    )


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every whole text of ``documents``, learning from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 3, 1)
    model = fit(docs.where(~out))
    return identify(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")
