"""Approximate nearest neighbours by largest inner product: score-aware quantisation and exact reranking.

Vectors are cut into pieces of two dimensions, each coded by four bits. What matters for inner products is
the residual along the vector itself, so codes and codebooks minimise |r|^2 + (ETA - 1) (r . x)^2 / |x|^2:
residuals parallel to the vector cost ETA times as much as orthogonal ones. Codebooks are fitted on about
SAMPLE distinct vectors, an even share by hash; every one is coded. Two codes share a byte, so a query's table has 256 entries
for each four dimensions, and a scan adds up one table entry per byte.

Equal vectors are one class, which holds its k + 1 smallest ids (one more than wanted, as a query is no
neighbour of itself) and is coded, scanned and asked once. Asked classes (in blocks of BLOCK_BYTES, so that the
coded ones are sent to few of them) meet all coded ones (in blocks of at most about ROW_BLOCK) in one task per pair, which reranks its own KEEP best
vectors of each query by the exact inner product in double precision: what is reranked grows with the blocks, and
so with the rows. The k + 1 best ids of each block go on, those of all blocks are the answer of each row of the class.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with a null
id, take no part, neither do vectors of another dimension than the most frequent one (ties: the larger);
repeated rows count once, and of different vectors with the same id the smallest counts; ties go to smaller
ids; with fewer candidates all are returned; other columns, whatever their names, are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from versewell.llm.common import Scratch, table

SAMPLE, ROUNDS, SWEEPS, THRESHOLD, SEED = 8192, 8, 2, 0.2, 5
BLOCK_BYTES, ROW_BLOCK, LEAST_ROW_BLOCKS, KEEP = 64 << 20, 32768, 24, 200


class Codebook:
    """Centres [pieces, 16, 2] of vectors padded to a multiple of four dimensions."""

    def __init__(self, centres: np.ndarray, eta: float):
        self.centres, self.eta = centres, eta

    @staticmethod
    def padded(x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, -x.shape[1] % 4)))

    @classmethod
    def fit(cls, x: np.ndarray) -> Codebook:
        """x [n, d], all rows used: plain k-means steps first, then score-aware ones."""
        d = x.shape[1]
        x = cls.padded(x)
        rng = np.random.default_rng(SEED)
        pieces = x.shape[1] // 2
        start = x[rng.choice(len(x), 16, replace=len(x) < 16)].reshape(16, pieces, 2).transpose(1, 0, 2)
        t = THRESHOLD**2
        book = cls(start.copy(), 1.0)
        for k in range(ROUNDS):
            if k == ROUNDS // 2:
                book.eta = max(1.0, (d - 1) * t / (1 - t))
            book._improve(x, book.codes(x))
        return book

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Code [n, pieces] of each piece of padded rows: nearest centre, then sweeps of one piece at a time."""
        n, pieces = len(x), len(self.centres)
        parts = x.reshape(n, pieces, 2)
        own = ((parts[:, :, None, :] - self.centres) ** 2).sum(3)  # squared residual of each choice
        codes = own.argmin(2)
        if self.eta == 1:
            return codes
        along = np.einsum("npd,pcd->npc", parts, self.centres)
        along = (parts**2).sum(2)[:, :, None] - along  # (r . x) of each choice
        weight = (self.eta - 1) / np.maximum((x**2).sum(1), 1e-30)
        rows = np.arange(n)
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(SWEEPS):
            for p in range(pieces):
                rest = total - along[rows, p, codes[:, p]]
                codes[:, p] = (own[:, p] + weight[:, None] * (rest[:, None] + along[:, p]) ** 2).argmin(1)
                total = rest + along[rows, p, codes[:, p]]
        return codes

    def _improve(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Best centres for given codes, piece by piece: (sum I + w x x^T) c = sum x + w x (rest + |x|^2)."""
        n, pieces = codes.shape
        parts = x.reshape(n, pieces, 2)
        weight = (self.eta - 1) / np.maximum((x**2).sum(1), 1e-30)
        for p in range(pieces):
            chosen = self.centres[np.arange(pieces), codes]
            rest = ((parts - chosen) * parts).sum((1, 2)) - ((parts[:, p] - chosen[:, p]) * parts[:, p]).sum(1)
            xp = parts[:, p]
            left = np.eye(2) + weight[:, None, None] * xp[:, :, None] * xp[:, None, :]
            right = xp * (1 + weight * (rest + (xp**2).sum(1)))[:, None]
            for c in range(16):
                mine = codes[:, p] == c
                if mine.any():
                    self.centres[p, c] = np.linalg.solve(left[mine].sum(0), right[mine].sum(0))

    def pack(self, x: np.ndarray) -> np.ndarray:
        """Two codes a byte: [n, pieces / 2]."""
        codes = self.codes(self.padded(x))
        return (codes[:, ::2] * 16 + codes[:, 1::2]).astype("u1")

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries with all pairs of centres: [queries, pieces / 2, 256]."""
        parts = self.padded(q).reshape(len(q), len(self.centres), 2)
        one = np.einsum("qpd,pcd->qpc", parts, self.centres).astype("f4")
        return (one[:, ::2, :, None] + one[:, 1::2, None, :]).reshape(len(q), -1, 256)


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    big = F.lit(float("inf"))
    finite = F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < big), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def search(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, ``key``, score) of the ``k`` rows nearest to each query row. ``is_query``: over columns of ``df``."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    rows = df.where(F.col(key).isNotNull() & usable(F.col(vector)))
    rows = rows.groupBy(F.col(key).alias("id")).agg(F.min(F.col(vector).cast("array<double>")).alias("v"), F.bool_or(is_query).alias("q"))
    rows = scratch.write(rows)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if("q").alias("nq")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes:
        return df.select(
            F.col(key).alias("query_id"), F.lit(0).alias("rank"), F.col(key), F.lit(0.0).alias("score")).where("false")
    rows = rows.where(F.size("v") == sizes[0].d)
    first = F.row_number().over(W.partitionBy("v").orderBy("id"))
    classes = rows.select("id", "v").withColumn("n", first).where(F.col("n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list(F.col("id").cast("bigint"))).alias("ids"))
    asked = rows.where("q").select("v").distinct().withColumn("q", F.lit(True))
    classes = scratch.write(classes.join(asked, "v", "left").withColumn("id", F.col("ids")[0]))
    size = classes.agg(F.count("*").alias("n"), F.count_if("q").alias("nq")).first()
    share = F.pmod(F.xxhash64("id"), F.lit(-(-size.n // SAMPLE))) == 0
    sample = classes.where(share).select("id", "v").toPandas().sort_values("id")
    book = Codebook.fit(np.stack(sample["v"].to_numpy()).astype("f8"))
    held = spark.sparkContext.broadcast(book)

    @F.arrow_udf("binary")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = batch.flatten().to_numpy().reshape(len(batch), -1)
            parts = [held.value.pack(x[at : at + 2048]) for at in range(0, len(x), 2048)]
            yield pa.array([row.tobytes() for part in parts for row in part], pa.binary())

    row_blocks = max(LEAST_ROW_BLOCKS, -(-size.n // ROW_BLOCK))
    query_blocks = max(1, -(-size.nq * 8 * sizes[0].d // BLOCK_BYTES))
    block = lambda n: F.pmod(F.xxhash64(F.col("id"), F.lit(n)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = df.schema[vector].dataType  # floats travel as they are
    coded = classes.select("ids", F.col("v").cast(own).alias("x"), code("v").alias("code"), block(row_blocks).alias("rb")).withColumn("qb", every(query_blocks))
    queries = classes.where("q").select("id", "v", block(query_blocks).alias("qb")).withColumn("rb", every(row_blocks))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_id, out_s = [], [], []
        if len(left) and len(right):
            book, lists = held.value, right["ids"].combine_chunks()
            ids, count = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype("i8")
            start = np.cumsum(count) - count
            order = np.argsort(ids[start])  # stable sorting by score then keeps smaller ids first
            start, count = start[order], count[order]
            codes = np.frombuffer(b"".join(right["code"].to_pylist()), "u1").reshape(len(order), -1)[order]
            columns = [np.ascontiguousarray(c) for c in codes.T]
            exact = right["x"].combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order].T.astype("f8", order="C")
            qs, vs = left["id"].to_numpy(), left["v"].combine_chunks().flatten().to_numpy().reshape(len(left), -1)
            for at in range(0, len(qs), 64):
                u, best = vs[at : at + 64], []
                for lut in book.tables(u):
                    s = lut[0].take(columns[0])
                    for t, c in zip(lut[1:], columns[1:]):
                        s += t.take(c)
                    best.append(np.sort(_first(s, KEEP)))
                best = np.stack(best)
                score = np.zeros(best.shape)
                for a, x in zip(u.T, exact):  # one dimension after the other: the same sums in every block
                    score += a[:, None] * x.take(best)
                top = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
                score, best = np.take_along_axis(score, top, 1).ravel(), np.take_along_axis(best, top, 1).ravel()
                query, n = np.repeat(np.arange(len(u)), top.shape[1]), count[best]
                found = ids[np.repeat(start[best] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                query, score = np.repeat(query, n), np.repeat(score, n)
                order = np.lexsort((found, -score, query))
                query, score, found = query[order], score[order], found[order]
                keep = np.arange(len(query)) - np.searchsorted(query, query) <= k
                out_q.append(qs[at + query[keep]])
                out_id.append(found[keep])
                out_s.append(score[keep])
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return pa.table({"query": join(out_q, "i8"), "id": join(out_id, "i8"), "score": join(out_s, "f8")})

    near = queries.groupBy("qb", "rb").cogroup(coded.groupBy("qb", "rb")).applyInArrow(scan, "query bigint, id bigint, score double")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    near = near.withColumn("n", place).where(F.col("n") <= k + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("near"))
    near = near.join(classes.where("q").select(F.col("id").alias("query"), "v"), "query").select("v", "near")
    found = rows.where("q").select(F.col("id").cast("bigint").alias("query_id"), "v").join(near, "v")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    found = found.select("query_id", F.posexplode(others).alias("place", "one"))
    return found.select("query_id", (F.col("place") + 1).alias("rank"), F.col("one.id").alias(key), F.col("one.score").alias("score"))


def _first(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values, equal ones by place; as by a stable sort, without sorting all."""
    if len(s) <= k:
        return np.argsort(-s, kind="stable")
    least = np.partition(s, len(s) - k)[len(s) - k]
    above = np.flatnonzero(s > least)
    ties = np.flatnonzero(s == least)[: k - len(above)]
    best = np.concatenate([above, ties])
    return best[np.argsort(-s[best], kind="stable")]


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows of ``embeddings`` with the largest inner product for every 20th row."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
