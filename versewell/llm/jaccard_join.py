"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, then exact intersections. No link is missed.

A document is the sorted array of the 64-bit hashes of its word shingles. Sets of n and m shingles that share at
least the fraction t of their union differ in at most (n + m) * (1 - t) / (1 + t) shingles, and n >= t * m.

* Bands: a set belongs to the band of its size (bands grow by RATIO); the pair of two sets is looked for in the band
  of the larger one, so sets that can be a smaller partner in the next band stand there, too.
* Tiles: a band allows at most D differing shingles. Its hash range is cut into D + 1 pieces, so two linked sets
  agree in a piece as a whole. (band, piece, hash of what the set has there) is a tile: only members of one tile are
  compared, and tiles stay small because a piece is several shingles together.
* Bitmaps: each set has a bitmap of parities (a shingle flips one bit; shared shingles cancel out). The number of
  bits in which two bitmaps differ is at most the number of differing shingles, which bounds the overlap from above.
  A bitmap has about half as many bits as its set has shingles; of two widths the wider is folded to the other.
* What passes is compared exactly on the full sorted arrays, so nothing depends on chance.

Groups aren't expanded into pairs: equal sets are one class; the members of a tile are first compared with one
centre; then only those outside the largest component of a tile meet the other members, in blocks of BLOCK. Keys of
many members are found by counts over hashed cells (near_dup), so no tile is one task's work.

Defined results: null, empty and wordless texts have no shingles and are linked with nothing; rows of equal id are
one document, whose texts are all linked by it; a row with a null id has no component; repeated rows are returned
each; texts of any length are read whole; other columns, whatever their names, are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versewell.llm import near_dup
from versewell.llm.common import Scratch, released, table

RATIO, BLOCK = 1.5, 2048
LEAST_BITS, MOST_BITS = 64, 1 << 16
SLICE_BYTES = 1 << 20
_MIX, _SALT = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


def most_apart(total: int, percent: int) -> int:
    """Most shingles that differ between linked sets of ``total`` shingles together: 100 * both >= percent * union."""
    return total * (100 - percent) // (100 + percent)


def band_of(n: int) -> int:
    """Bands hold the sizes up to 1, 2, 3, 4, 6, 9 ...; equal for all sizes of one band."""
    band, top = 0, 1
    while n > top:
        top = max(top + 1, int(top * RATIO))
        band += 1
    return band


def band_top(band: int) -> int:
    top = 1
    for _ in range(band):
        top = max(top + 1, int(top * RATIO))
    return top


def piece_keys(s: np.ndarray, band: int, percent: int) -> np.ndarray:
    """One key for each piece of the hash range: equal if and only if (but for hash collisions) the set is the same there."""
    pieces = most_apart(2 * band_top(band), percent) + 1
    x = s * _SALT
    x ^= x >> np.uint64(31)
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(x * _MIX, dtype="u8")])
    # s is sorted, so the pieces of the range are stretches of it
    edges = np.array([(k << 64) // pieces for k in range(1, pieces)], "u8")
    cut = np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])
    held = sums[cut[1:]] - sums[cut[:-1]]
    key = (held ^ (np.arange(pieces, dtype="u8") + np.uint64(band << 40)) * _SALT) * _MIX
    return (key ^ key >> np.uint64(29)) * _SALT


def keys_of(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set in its own band and, where it can be the smaller partner of a larger set, in the next ones."""
    n, band = len(s), band_of(len(s))
    out = [piece_keys(s, band, percent)]
    while 100 * n >= percent * (band_top(band) + 1):
        band += 1
        out.append(piece_keys(s, band, percent))
    return np.concatenate(out)


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the number of shingles in each of 2^k cells."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (len(s) // 2).bit_length()))
    cells = np.bincount((s & np.uint64(bits - 1)).astype("i8"), minlength=bits)
    return np.packbits((cells & 1).astype("u1")).tobytes()


def folded(bitmaps: list[bytes], width: int) -> np.ndarray:
    """Bitmaps of ``width`` bytes, as rows of 64-bit words: the halves of a wider one are added (xor)."""
    out = np.empty((len(bitmaps), width // 8), "u8")
    for k, b in enumerate(bitmaps):
        words = np.frombuffer(b, "u8")
        out[k] = np.bitwise_xor.reduce(words.reshape(-1, width // 8), 0)
    return out


def may_link(n: np.ndarray, m: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and the number of differing bits allow a link."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (apart <= (n + m) * (100 - percent) // (100 + percent))


def prints(df: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, n, h1, h2, bits, keys) of (id, text): size, 128-bit hash of the set, bitmap and keys of its tiles."""
    import xxhash

    shape = [("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("bits", pa.binary()), ("keys", pa.list_(pa.int64()))]

    @F.arrow_udf("struct<n int, h1 bigint, h2 bigint, bits binary, keys array<bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in released(batches):
            parts = []
            step = max(1, int(len(batch) * SLICE_BYTES / max(batch.nbytes, 1)))
            for at in range(0, len(batch), step):
                sets = [near_dup.shingles(x.as_py(), words) for x in batch.slice(at, step)]
                n = np.array([len(s) for s in sets], "i4")
                whole = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], "u8").view("i8")
                keys = [keys_of(s, percent).view("i8") if len(s) else np.zeros(0, "i8") for s in sets]
                ends = np.cumsum([0, *map(len, keys)])
                columns = [pa.array(n), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array([bitmap(s) for s in sets], pa.binary())]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
                parts.append(pa.StructArray.from_arrays([*columns, lists], fields=list(pa.struct(shape))))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(shape))

    return df.select("id", run("text").alias("print")).select("id", "print.*")


def _bits_allow(percent: int) -> Column:
    """Condition on pairs with columns n_a, bits_a, n_b, bits_b."""

    @F.arrow_udf("boolean")
    def run(n_a: pa.Array, bits_a: pa.Array, n_b: pa.Array, bits_b: pa.Array) -> pa.Array:
        apart = np.empty(len(n_a), "i8")
        for k, (x, y) in enumerate(zip(bits_a.to_pylist(), bits_b.to_pylist())):
            two = folded([x, y], min(len(x), len(y)))
            apart[k] = np.bitwise_count(two[0] ^ two[1]).sum()
        return pa.array(may_link(n_a.to_numpy().astype("i8"), n_b.to_numpy().astype("i8"), apart, percent))

    return run("n_a", "bits_a", "n_b", "bits_b")


def _allowed(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose bitmaps allow a link."""
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)
    return pairs.where(_bits_allow(percent)).select("a", "b")


def compare_tile(n: np.ndarray, bits: list[bytes], comp: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places) of ``left`` with ``right`` members of other components that sizes and bitmaps allow."""
    xs, ys = [], []
    widths = np.array([len(b) for b in bits])
    held = {w: folded([bits[k] for k in right if widths[k] >= w], w) for w in np.unique(widths)}
    places = {w: right[widths[right] >= w] for w in held}
    small = {w: np.flatnonzero(widths[right] < w) for w in held}
    for x in left:
        w = widths[x]
        at = places[w]
        apart = np.bitwise_count(held[w] ^ np.frombuffer(bits[x], "u8")).sum(1)
        found = at[may_link(n[x], n[at], apart, percent) & (comp[at] != comp[x])]
        for y in right[small[w]]:  # narrower ones, of the next smaller sizes only
            if comp[y] != comp[x] and may_link(n[x], n[y], np.int64(0), percent):
                two = folded([bits[x], bits[y]], widths[y])
                if may_link(n[x], n[y], np.bitwise_count(two[0] ^ two[1]).sum(), percent):
                    found = np.append(found, y)
        xs.append(np.full(len(found), x))
        ys.append(found)
    none = np.zeros(0, "i8")
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (none, none)


def _tile_pairs(percent: int):
    """For rows sorted by (key, one, two): pairs of each tile; tiles may begin and end in any batch."""
    out = pa.schema([("a", pa.struct([("id", pa.int64()), ("h", pa.int64())])), ("b", pa.struct([("id", pa.int64()), ("h", pa.int64())]))])

    def of_tiles(rows: pa.Table) -> tuple[list, list]:
        tile = np.stack([rows[c].to_numpy() for c in ("key", "one", "two")], 1)
        cut = np.flatnonzero((tile[1:] != tile[:-1]).any(1)) + 1
        n, role = rows["n"].to_numpy().astype("i8"), rows["role"].to_numpy()
        ids, comps = rows["id"].to_pylist(), rows["comp"].to_pylist()
        numbers: dict = {}
        comp = np.array([numbers.setdefault((c["id"], c["h"]), len(numbers)) for c in comps])
        bits, a, b = rows["bits"].to_pylist(), [], []
        for lo, hi in zip([0, *cut], [*cut, len(n)]):
            roles = role[lo:hi]
            x, y = compare_tile(n[lo:hi], bits[lo:hi], comp[lo:hi], np.flatnonzero(roles & 1), np.flatnonzero(roles & 2), percent)
            a += [ids[lo + k] for k in x]
            b += [ids[lo + k] for k in y]
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in released(batches):
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([kept, rows]) if kept is not None else rows
            if not len(rows):
                continue
            last = [rows[c][-1] for c in ("key", "one", "two")]
            same = np.logical_and.reduce([rows[c].to_numpy() == v.as_py() for c, v in zip(("key", "one", "two"), last)])
            full = int(np.argmax(same))  # the last tile may go on
            kept = rows.slice(full).combine_chunks()
            if full:
                a, b = of_tiles(rows.slice(0, full))
                yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=out)
        if kept is not None and len(kept):
            a, b = of_tiles(kept)
            yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=out)

    return run


_CLASS = "struct<id: bigint, h: bigint>"


def _across(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one tile that lie in different components, without those inside its largest component.

    ``rest``: key, id, n, bits, comp, top (the tile's largest component), members.
    """
    blocks = F.ceil(F.col("members") / BLOCK)
    rest = rest.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    own = ("key", "id", "n", "bits", "comp")
    one = F.col("blocks") == 1
    outside = F.col("comp") != F.col("top")
    all_ = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    zero = F.lit(0).cast("long")
    both = rest.where(one).select(*own, zero.alias("one"), zero.alias("two"), F.when(outside, 3).otherwise(2).alias("role"))
    x = rest.where(~one & outside).select(*own, F.col("block").alias("one"), F.explode(all_).alias("two"), F.lit(1).alias("role"))
    y = rest.where(~one).select(*own, F.explode(all_).alias("one"), F.col("block").alias("two"), F.lit(2).alias("role"))
    tiles = both.unionByName(x).unionByName(y).repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
    pairs = tiles.mapInArrow(_tile_pairs(percent), f"a {_CLASS}, b {_CLASS}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def jaccard_components(df: DataFrame, words: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: its key, ``n_shingles`` and ``component_id``, by links of 100 * both >= percent * union."""
    import xxhash

    scratch = Scratch(df.sparkSession)
    docs = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    found = scratch.write(prints(docs, words, percent))
    full = found.where("id IS NOT NULL AND n > 0")
    # a class of equal sets goes by its smallest id, and by its hash where that id has several sets
    several = scratch.write(full.groupBy("id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("id"))
    by_set = full.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("members"), *[F.first(c).alias(c) for c in ("n", "bits", "keys")])
    by_set = by_set.join(several.select(F.col("id").alias("least"), F.lit(True).alias("again")), "least", "left")
    named = F.struct(F.col("least").alias("id"), F.when(F.col("again"), F.col("h1")).otherwise(0).alias("h"))
    classes = scratch.write(by_set.select(named.alias("id"), "h1", "h2", "members", "n", "bits", "keys"))

    rows = classes.select(F.explode("keys").alias("key"), "id", "n", F.lit(0).cast("long").alias("s1"), F.lit(0).cast("long").alias("s2"))
    entries = classes.agg(F.sum(F.size("keys"))).first()[0] or 0
    most = max(near_dup.LEAST_HOT, int(entries * near_dup.HOT))
    shared = scratch.write(near_dup._with_centres(rows, most, percent / 100).drop("s1", "s2"))
    stars = shared.where("near").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    stars = scratch.write(_allowed(stars, classes, percent))

    @F.arrow_udf("struct<hash binary, set binary>")
    def as_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in released(batches):
            sets = [near_dup.shingles(t.as_py(), words).tobytes() for t in batch]
            yield pa.StructArray.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["hash", "set"])

    def sets_of(pairs: DataFrame) -> DataFrame:
        """(id, set) of the classes in pairs, read again from one of their texts."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted = classes.join(wanted, "id", "left_semi").select(F.col("id").alias("class"), F.col("id.id").alias("id"), "h1", "h2")
        texts = docs.join(wanted, "id").withColumn("own", as_bytes("text"))
        same = F.hex("own.hash") == F.concat(*[F.lpad(F.hex(h), 16, "0") for h in ("h1", "h2")])
        return texts.where(same).select(F.col("class").alias("id"), F.col("own.set").alias("set")).dropDuplicates(["id"])

    share = percent / 100
    links = scratch.write(near_dup._confirmed(stars, scratch.write(sets_of(stars)), share))
    labels = near_dup.components(links, scratch)

    labelled = shared.drop("centre", "near").join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    by_comp = labelled.groupBy("key", "comp").agg(F.count("*").alias("of_comp"))
    mixed = by_comp.groupBy("key").agg(F.max_by("comp", "of_comp").alias("top"), F.sum("of_comp").alias("members"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
    rest = near_dup._spread(labelled, scratch.write(mixed), ["key"], most)
    rest = rest.join(classes.select("id", "bits"), "id")
    pairs = scratch.write(_across(rest, percent).join(stars, ["a", "b"], "left_anti"))
    more = near_dup._confirmed(pairs, scratch.write(sets_of(pairs)), share)

    # the classes of one id are one document
    twice = full.join(several, "id", "left_semi").join(classes.select("h1", "h2", F.col("id").alias("class")), ["h1", "h2"]).select("id", "class")
    ties = twice.groupBy("id").agg(F.min("class").alias("a")).join(twice, "id").where("class <> a").select("a", F.col("class").alias("b"))
    later = more.unionByName(ties)
    for side in "ab":  # between the components found so far
        later = later.join(labels.select(F.col("id").alias(side), "comp"), side, "left").withColumn(side, F.coalesce("comp", side)).drop("comp")
    later = scratch.write(later.where("a <> b").distinct())
    if not later.isEmpty():
        joined = near_dup.components(later, scratch).select(F.col("id").alias("comp"), F.col("comp").alias("least"))
        alone = joined.join(labels.select("comp").distinct(), "comp", "left_anti").select(F.col("comp").alias("id"), F.col("least").alias("comp"))
        labels = labels.join(joined, "comp", "left").select("id", F.coalesce("least", "comp").alias("comp")).unionByName(alone)

    of_class = classes.select("h1", "h2", "members", "id").join(labels, "id", "left")
    of_class = scratch.write(of_class.select("h1", "h2", "members", F.coalesce("comp.id", "id.id").alias("component_id")))
    scratch.drop(*[t for t, _ in scratch.written if not any(t is x for x in (found, of_class))])
    most = max(near_dup.LEAST_HOT, int(found.count() * near_dup.HOT))
    linked = near_dup._spread(found.where("id IS NOT NULL AND n > 0").select("id", "n", "h1", "h2"), of_class, ["h1", "h2"], most)
    alone = found.where("id IS NULL OR n = 0").select("id", "n", F.col("id").alias("component_id"))
    out = linked.select("id", "n", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), "component_id")


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` whose sets of 3-word shingles have a similarity of 0.9 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5_number(array_to_string(w[i + 1:i + 3], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 2, least(len(w), 1)))) AS i FROM t)
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n AS x ON x.doc_id = a.doc_id JOIN n AS y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
), c AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM documents AS d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""
