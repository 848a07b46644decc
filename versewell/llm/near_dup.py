"""MinHash near-duplicates by a multi-index Hamming join.

A document is the set of its word shingles (64-bit hashes). Its signature has CHUNKS * SYMBOLS min-hashes of
BITS bits. By the pigeonhole principle two signatures that differ in at most CHUNKS * (ERRORS + 1) - 1
symbols agree in some chunk up to ERRORS symbols; so each chunk gives one key for every way to leave out
ERRORS of its symbols, and all pairs under that distance share a key. At a similarity of 0.8 all ten chunks
fail with a probability of 2 in a million, at 0.85 of 1 in 10 million.

No group of copies is expanded into its pairs:

1. equal sets become one class, represented by its smallest id;
2. inside each key all members are compared with one centre (the smallest id) only, and links confirmed on
   the full sets give first components;
3. for keys that still hold several components, the members of *different* components are compared.

So every pair that shares a key is either compared or already connected, and no link between components is
lost. No key is one task's work: keys of more than HOT of all entries are found by a count over hashed cells of
bounded number, their centres (at most 1 / HOT of them) are broadcast instead of sorted; in step 3 the members of
a key are dealt to blocks of about BLOCK, and each pair of blocks is a join key of its own. Classes of more than
HOT of all rows (at most 1 / HOT, too) are broadcast to their rows. Families of many texts just under the threshold
still cost a sketch test for each pair; they are spread over all tasks, and give no rows.

Before the full sets are fetched, pairs are tested by size (the smaller set must have the needed share
of the larger) and by a sketch of 2 bits of each symbol, at six standard deviations. In step 3 an odd sketch
(parities of the shingles that fall into each of ODD cells; shared shingles cancel out) bounds the symmetric
difference from below inside the join, so that groups of copies just under the threshold give no pairs.

Defined results: null, empty and wordless texts have no shingles and are linked with nothing; rows of equal
id count as one document, whose texts are all linked by it; a row with a null id is its own; texts of any length
are read whole; other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from versewell.llm.common import Scratch, released, table

CHUNKS, SYMBOLS, ERRORS, BITS = 10, 5, 1, 12
ODD = 1024
#: share of all entries (and number) above which a key or class is not left to one task; cells that are counted; members of a block
HOT, LEAST_HOT, CELLS, BLOCK = 1e-3, 100_000, 1 << 16, 4096
SIGNATURE = CHUNKS * SYMBOLS
KEYS = CHUNKS * math.comb(SYMBOLS, ERRORS)
SLICE_BYTES = 1 << 19
_rng = np.random.default_rng(20)
TIMES, PLUS = _rng.integers(0, 1 << 63, (2, SIGNATURE), dtype="u8") | np.uint64(1)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text (words: runs of non-space; A-Z lower-cased)."""
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, "u8")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), "u8", len(tokens))
    words = min(words, len(tokens))
    acc = np.full(len(h) - words + 1, words, "u8")
    for k in range(words):
        acc = acc * _P + h[k : len(h) - words + 1 + k]
        acc ^= acc >> np.uint64(29)
    acc *= _Q
    acc ^= acc >> np.uint64(32)
    return np.unique(acc)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """[documents, SIGNATURE] symbols of sets that aren't empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), SIGNATURE), "u8")
    for k in range(SIGNATURE):
        least = np.minimum.reduceat(flat * TIMES[k] + PLUS[k], starts)
        out[:, k] = (least * _Q) >> np.uint64(64 - BITS)
    return out


def _keys(symbols: np.ndarray) -> np.ndarray:
    """[documents, keys]: for each chunk and each choice of symbols left out, the others, packed."""
    kept = [[k for k in range(SYMBOLS) if k not in gone] for gone in combinations(range(SYMBOLS), ERRORS)]
    out = []
    for chunk in range(CHUNKS):
        for way, keep in enumerate(kept):
            key = np.full(len(symbols), chunk * len(kept) + way, "u8")
            for k in keep:
                key = (key << np.uint64(BITS)) | symbols[:, chunk * SYMBOLS + k]
            out.append(key)
    return np.stack(out, 1).view("i8")


def _sketch(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of each symbol, in two words."""
    halves = []
    for part in (symbols[:, :32], symbols[:, 32:]):
        word = np.zeros(len(part), "u8")
        for k in range(part.shape[1]):
            word = (word << np.uint64(2)) | (part[:, k] & np.uint64(3))
        halves.append(word.view("i8"))
    return halves[0], halves[1]


def _odd(s: np.ndarray) -> np.ndarray:
    """Parity of the number of elements in each cell, as ODD / 64 words."""
    cells = np.bincount((s * _P >> np.uint64(40)).astype("i8") % ODD, minlength=ODD)
    return np.packbits((cells & 1).astype("u1")).view("i8")


def fingerprints(df: DataFrame, words: int, text: str = "text") -> DataFrame:
    """Add struct ``print``: size n, 128-bit hash (h1, h2) of the set, sketch (s1, s2), odd sketch and keys."""
    import xxhash

    words_, long = ODD // 64, pa.list_(pa.int64())
    shape = pa.struct([("n", pa.int32()), *[(c, pa.int64()) for c in ("h1", "h2", "s1", "s2")], ("odd", long), ("keys", long)])

    @F.arrow_udf("struct<n int, h1 bigint, h2 bigint, s1 bigint, s2 bigint, odd array<bigint>, keys array<bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in released(batches):
            parts = []
            step = max(1, int(len(batch) * SLICE_BYTES / max(batch.nbytes, 1)))
            for at in range(0, len(batch), step):
                sets = [shingles(x.as_py(), words) for x in batch.slice(at, step)]
                n = np.array([len(s) for s in sets], "i4")
                whole = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], "u8").view("i8")
                full = np.flatnonzero(n)
                s1, s2, keys = np.zeros(len(n), "i8"), np.zeros(len(n), "i8"), np.zeros((0, 1), "i8")
                if len(full):
                    symbols = _signatures([sets[k] for k in full])
                    s1[full], s2[full] = _sketch(symbols)
                    keys = _keys(symbols)
                ends = np.cumsum(np.where(n > 0, keys.shape[1], 0))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(keys.ravel()))
                odd = np.concatenate([_odd(x) for x in sets])
                odds = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * words_, pa.int32()), pa.array(odd))
                parts.append(pa.StructArray.from_arrays([pa.array(n), *[pa.array(c) for c in (whole[:, 0], whole[:, 1], s1, s2)], odds, lists], fields=list(shape)))
            yield pa.concat_arrays(parts) if parts else pa.array([], shape)

    return df.withColumn("print", run(F.col(text)))


def _may_link(a: str, b: str, share: float) -> Column:
    """Necessary for a link, by size, and all but certain for one, by the sketch."""
    differ = F.lit(0)
    for s in ("s1", "s2"):
        x = F.col(a + s).bitwiseXOR(F.col(b + s))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    p = (1 - share) * 0.75
    most = math.ceil(SIGNATURE * p + 6 * math.sqrt(SIGNATURE * p * (1 - p)))
    small, large = F.least(F.col(a + "n"), F.col(b + "n")), F.greatest(F.col(a + "n"), F.col(b + "n"))
    return (differ <= most) & (small * 100 >= large * round(share * 100))


def _odd_may_link(a: str, b: str, share: float) -> Column:
    """Cells of odd difference are at most the symmetric difference; for large sets, six deviations over what it gives."""
    differ = sum((F.bit_count(F.col(f"{a}o{k}").bitwiseXOR(F.col(f"{b}o{k}"))) for k in range(ODD // 64)), F.lit(0))
    most = (F.col(a + "n") + F.col(b + "n")) * ((1 - share) / (1 + share)) + 1e-6
    p = (1 - F.pow(F.lit(1 - 2 / ODD), most)) / 2
    return differ <= F.least(most, ODD * p + 6 * F.sqrt(ODD * p * (1 - p)))


def _confirmed(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    percent = round(share * 100)

    @F.arrow_udf("boolean")
    def linked(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p.as_py(), "u8"), np.frombuffer(q.as_py(), "u8")
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * both >= percent * (len(p) + len(q) - both))
        return pa.array(out, pa.bool_())

    one = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    two = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(one, "a").join(two, "b").where(linked("set_a", "set_b")).select("a", "b")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, comp): the smallest id that is reachable; nodes of ``edges`` (a, b) only.

    Every node takes the smallest label around it, then the label of that label, until nothing changes.
    """
    ways = scratch.write(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.write(ways.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = ways.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        new = labels.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        new = scratch.write(new.join(up, "comp").select("id", "was", F.least("comp", "up").alias("comp")))
        done = new.where("was <> comp").isEmpty()
        scratch.drop(labels)
        labels = new
        if done:
            return labels.select("id", "comp")


def _spread(left: DataFrame, right: DataFrame, on: list[str], most: int) -> DataFrame:
    """Inner join with ``right`` (distinct keys; ``members``: how many rows of ``left`` each meets) without a hot task.

    The keys of more than ``most`` members are broadcast: there are at most rows of ``left`` / ``most`` of them.
    """
    hot = right.where(F.col("members") > most)
    if hot.isEmpty():
        return left.join(right, on)
    cold = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.where(F.col("members") <= most), on)
    return left.join(F.broadcast(hot), on).unionByName(cold)


def _with_centres(rows: DataFrame, most: int, share: float) -> DataFrame:
    """Entries of keys that several documents hold, each with its key's smallest id and whether the two may be linked."""
    by_key = W.partitionBy("key").orderBy("id")
    first = by_key.rowsBetween(W.unboundedPreceding, W.currentRow)
    cell = F.pmod(F.xxhash64("key"), F.lit(CELLS))
    full = [r.cell for r in rows.groupBy(cell.alias("cell")).count().where(F.col("count") > most).collect()]  # at most entries / most of the CELLS
    parts = []
    if full:
        some = rows.where(cell.isin(full))
        heads = some.groupBy("key").agg(F.count("*").alias("members"), *[F.min_by(c, "id").alias(f"c_{c}") for c in ("id", "n", "s1", "s2")])
        hot = F.broadcast(heads.where(F.col("members") > most).drop("members"))
        parts.append(some.join(hot, "key"))
        rows = rows.where(~cell.isin(full)).unionByName(some.join(hot.select("key"), "key", "left_anti"))
    held = rows.select("*", *[F.first(c).over(first).alias(f"c_{c}") for c in ("id", "n", "s1", "s2")], F.lead("id").over(by_key).alias("next"))
    parts.append(held.where("next IS NOT NULL OR id <> c_id").drop("next"))
    near = (_may_link("", "c_", share) & F.expr("id <> c_id")).alias("near")
    return reduce(DataFrame.unionByName, parts).select("key", "id", "n", "s1", "s2", F.col("c_id").alias("centre"), near)


def _across(rest: DataFrame, share: float) -> DataFrame:
    """Pairs of members of one key that lie in different components and may be linked; ``members``: of the key."""
    blocks = F.ceil(F.col("members") / BLOCK)
    rest = rest.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    own = ("id", "comp", "n", "s1", "s2", *[f"o{k}" for k in range(ODD // 64)])
    to = F.sequence(F.col("block"), F.col("blocks") - 1)
    x = rest.select("key", F.col("block").alias("one"), F.explode(to).alias("two"), *[F.col(c).alias(f"x_{c}") for c in own])
    of = F.sequence(F.lit(0).cast("long"), F.col("block"))
    y = rest.select("key", F.explode(of).alias("one"), F.col("block").alias("two"), *[F.col(c).alias(f"y_{c}") for c in own])
    apart = F.expr("x_comp < y_comp OR (one < two AND x_comp > y_comp)")
    met = x.join(y, ["key", "one", "two"]).where(apart & _may_link("x_", "y_", share) & _odd_may_link("x_", "y_", share))
    return met.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()


def near_duplicates(df: DataFrame, words: int = 5, share: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: its key, ``n_shingles`` and ``component_id``."""
    import xxhash

    scratch = Scratch(df.sparkSession)
    docs = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    prints = scratch.write(fingerprints(docs, words).select("id", "print.*"))
    full = prints.where("id IS NOT NULL AND n > 0")
    # an id of several texts counts by the one whose set has the smallest hash
    whole = F.struct("h1", "h2")
    several = full.groupBy("id").agg(F.min(whole).alias("lo"), F.max(whole).alias("hi"), F.count("*").alias("times"))
    several = scratch.write(several.where("times > 1").select("id", "lo"))  # ids of several rows
    linkable = full.join(several, "id", "left").where("lo IS NULL OR (h1 = lo.h1 AND h2 = lo.h2)")
    classes = scratch.write(
        linkable.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("members"), *[F.first(c).alias(c) for c in ("n", "s1", "s2", "odd", "keys")])
    )

    rows = classes.select(F.explode("keys").alias("key"), "id", "n", "s1", "s2")
    most = max(LEAST_HOT, int(classes.count() * KEYS * HOT))
    shared = scratch.write(_with_centres(rows, most, share))

    @F.arrow_udf("struct<hash binary, set binary>")
    def as_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in released(batches):
            hashes, sets = [], []
            for t in batch:
                sets.append(shingles(t.as_py(), words).tobytes())
                hashes.append(xxhash.xxh3_128_digest(sets[-1]))
            yield pa.StructArray.from_arrays([pa.array(hashes, pa.binary()), pa.array(sets, pa.binary())], ["hash", "set"])

    wanted = classes.join(shared.select("id").distinct(), "id", "left_semi").select("id", "h1", "h2")
    same = F.hex("own.hash") == F.concat(*[F.lpad(F.hex(h), 16, "0") for h in ("h1", "h2")])
    own_set = lambda rows: rows.withColumn("own", as_bytes("text")).where(same).select("id", F.col("own.set").alias("set"))
    texts = docs.join(wanted, "id")
    once, again = own_set(texts.join(several, "id", "left_anti")), own_set(texts.join(several, "id", "left_semi")).dropDuplicates(["id"])
    sets = scratch.write(once.unionByName(again))

    stars = scratch.write(shared.where("near").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct())
    links = scratch.write(_confirmed(stars, sets, share))
    labels = components(links, scratch)

    labelled = shared.drop("centre", "near").join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members")).where("lo < hi").select("key", "members")
    rest = _spread(labelled, scratch.write(mixed), ["key"], most)
    odd = classes.select("id", *[F.col("odd")[k].alias(f"o{k}") for k in range(ODD // 64)])
    rest = scratch.write(rest.join(odd, "id"))
    pairs = _across(rest, share).join(stars, ["a", "b"], "left_anti")
    more = scratch.write(_confirmed(pairs, sets, share))
    if not more.isEmpty():
        labels = components(links.unionByName(more), scratch)

    of_class = classes.select("h1", "h2", "members", F.col("id").alias("rep")).join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    of_class = scratch.write(of_class.select("h1", "h2", "members", F.coalesce("comp", "rep").alias("comp")))
    scratch.drop(*[t for t, _ in scratch.written if not any(t is x for x in (prints, several, of_class))])
    held = prints.select("id", "n", "h1", "h2").where("id IS NOT NULL AND n > 0").join(several, "id", "left")
    held = held.select("id", "n", F.coalesce("lo.h1", "h1").alias("h1"), F.coalesce("lo.h2", "h2").alias("h2"))
    found = _spread(held, of_class, ["h1", "h2"], max(LEAST_HOT, int(prints.count() * HOT))).select("id", "n", "comp")
    alone = prints.where("id IS NULL OR n = 0").select("id", "n", F.col("id").alias("comp"))
    return found.unionByName(alone).select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.col("comp").alias("component_id"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` whose sets of 2-word shingles have a similarity of 0.8 or more."""
    found = near_duplicates(table(spark, sf_dir, "documents"), words=2)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
