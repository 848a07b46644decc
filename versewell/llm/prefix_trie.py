"""Prefix trie of conversations: how often each beginning is shared, and what sharing it would save.

A conversation is a sequence of turns, each a 128-bit digest of role and text. Conversations are sorted by their
sequences and cut into ranges (shards); the id breaks ties, so that a group of copies is cut as well. Each shard

1. codes its turns by a dictionary of its own (ranks of the digests),
2. inserts its distinct sequences into a ternary search tree, the median of each range first, which keeps the tree
   balanced, and
3. walks the nodes from the last to the first (children come after their parents), adding up members, leaves and
   savings. There is no recursion, so depth is no limit.

Beginnings of a shard's first and last sequence may go on in the shards beside it: these boundary nodes carry what
lies below them inside the shard only. They are added up by key and rolled up to the root; there are at most
2 * shards * (depth + 1) of them. The ids that end at a boundary node are digested in sorted order as a stream.

Defined results: null role or text counts as empty; turns of an equal number are ordered by their digest; rows
without conv_id belong to no conversation and are left out; a conversation without turns is a member of the root;
repeated rows are turns of their own; texts of any length are digested whole; other columns are not read; an empty
table gives no node, not even a root. The sequence of one conversation is one row of 16 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versewell.llm.common import Scratch, released, table

STEP, MOST_SHARED = 20, 4  # conversation c begins with up to MOST_SHARED - 1 turns of conversation c - c % STEP
SHARD_TURNS, FEW_NODES = 1_000_000, 100_000
ROOT, EMPTY = hashlib.md5(b"").hexdigest(), hashlib.sha256(b"").hexdigest()
NODE = "key string, parent string, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, words bigint, boundary boolean, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_NODE = pa.schema([(c.split()[0], {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[c.split()[1]]) for c in NODE.split(", ")])


def sequences(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, digests, words): the turns of each conversation in order, with the number of words of each."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    digest = F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(32))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    turns = df.select(F.col(f"`{conv}`").alias("conv_id"), F.struct(F.col(f"`{turn}`").alias("turn"), digest.alias("digest"), words.alias("words")).alias("t"))
    turns = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return turns.select("conv_id", F.col("t.digest").alias("digests"), F.col("t.words").alias("words"))


def share_beginnings(convs: DataFrame) -> DataFrame:
    """Conversations whose first h = crc32(id) % 4 turns are those of the conversation c - c % 20 instead."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    rows = convs.withColumn("h", h.cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % STEP)
    first = [F.slice(c, 1, MOST_SHARED - 1).alias(f"base_{c}") for c in ("digests", "words")]
    heads = convs.where(F.col("conv_id") % STEP == 0).select(F.col("conv_id").alias("base"), *first)

    def joined(c: str) -> Column:
        head = F.coalesce(F.slice(f"base_{c}", F.lit(1), F.col("h")), F.slice(c, 1, 0))
        return F.concat(head, F.slice(c, F.col("h") + 1, F.greatest(F.size(c), F.lit(0)))).alias(c)

    return rows.join(heads, "base", "left").select("conv_id", joined("digests"), joined("words"))


def chained(digests: Column) -> Column:
    """Key of a whole sequence: the digest of its parent's key and of its last turn."""
    return F.aggregate(digests, F.lit(ROOT), lambda key, turn: F.md5(F.concat(key, turn).cast("binary")))


class Tree:
    """Ternary search tree over turn codes; node 0 is the root, and each node comes after its parent."""

    def __init__(self) -> None:
        self.code, self.parent, self.depth = [-1], [-1], [0]
        self.less, self.more, self.below = [-1], [-1], [-1]

    def _new(self, code: int, parent: int) -> int:
        for column, value in ((self.code, code), (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.less, -1), (self.more, -1), (self.below, -1)):
            column.append(value)
        return len(self.code) - 1

    def insert(self, codes: list[int]) -> int:
        """The node of a whole sequence."""
        code, less, more, below, parent = self.code, self.less, self.more, self.below, 0
        for c in codes:
            at, links, from_ = below[parent], below, parent
            while at >= 0 and code[at] != c:
                links, from_ = (less if c < code[at] else more), at
                at = links[at]
            if at < 0:
                at = links[from_] = self._new(c, parent)
            parent = at
        return parent

    def path(self, at: int) -> list[int]:
        out = [at]
        while at:
            at = self.parent[at]
            out.append(at)
        return out


def medians(n: int) -> Iterator[int]:
    """0 .. n - 1, the middle of each range before the ranges beside it."""
    ranges = [(0, n)]
    while ranges:
        lo, hi = ranges.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            ranges += [(mid + 1, hi), (lo, mid)]


def shard_nodes(ids: np.ndarray, seqs: list[bytes], words: np.ndarray) -> dict[str, list]:
    """Columns of NODE for one shard, sorted by sequence and id; ``words``: of all turns, one after the other."""
    pairs = np.frombuffer(b"".join(seqs), ">u8").astype("u8").reshape(-1, 2)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (pairs[order[1:]] != pairs[order[:-1]]).any(1)
    codes = np.empty(len(order), "i8")
    codes[order] = np.cumsum(new) - 1
    hexes = [f"{a:016x}{b:016x}" for a, b in pairs[order[new]].tolist()]
    words_of = words[order[new]].tolist()
    ends = np.cumsum([len(s) // 16 for s in seqs])

    runs = [0, *(k for k in range(1, len(seqs)) if seqs[k] != seqs[k - 1]), len(seqs)]
    tree, node_of = Tree(), {}
    for run in medians(len(runs) - 1):
        k = runs[run]
        node_of[run] = tree.insert(codes[ends[k] - len(seqs[k]) // 16 : ends[k]].tolist())
    size = len(tree.code)
    boundary = np.zeros(size, bool)
    for run in (0, len(runs) - 2):
        boundary[tree.path(node_of[run])] = True
    members, least, digest = [0] * size, [None] * size, [EMPTY] * size
    for run, at in node_of.items():
        own = ids[runs[run] : runs[run + 1]]
        members[at], least[at] = len(own), int(own[0])
        if not boundary[at]:
            digest[at] = hashlib.sha256(",".join(map(str, own.tolist())).encode()).hexdigest()
    children, leaves, saved, edge = [0] * size, [0] * size, [0] * size, boundary.tolist()
    for at in range(size - 1, 0, -1):
        up, parent = edge[at], tree.parent[at]
        members[parent] += members[at]
        least[parent] = least[at] if least[parent] is None else min(least[parent], least[at])
        if not up:
            leaves[at] = leaves[at] or 1
            saved[at] += (members[at] - 1) * words_of[tree.code[at]]
            children[parent] += 1
            leaves[parent] += leaves[at]
            saved[parent] += saved[at]
    keys, parents = [ROOT], [None]
    for at in range(1, size):
        parents.append(keys[tree.parent[at]])
        keys.append(hashlib.md5((parents[at] + hexes[tree.code[at]]).encode()).hexdigest())
    above = [None if at == 0 or edge[tree.parent[at]] else least[tree.parent[at]] for at in range(size)]
    last = [0, *(words_of[c] for c in tree.code[1:])]
    return dict(zip(_NODE.names, (keys, parents, tree.depth, least, above, members, last, edge, children, leaves, saved, digest)))


def _in_batches(columns: dict[str, list], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns["key"]), rows):
        yield pa.RecordBatch.from_pydict({c: v[at : at + rows] for c, v in columns.items()}, schema=_NODE)


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All nodes of one shard."""
    ids, seqs, words = [], [], []
    for batch in released(batches):
        ids.append(batch["conv_id"].to_numpy(zero_copy_only=False))
        seqs += batch["seq"].to_pylist()
        words.append(batch["words"].flatten().to_numpy(zero_copy_only=False))
    if seqs:
        yield from _in_batches(shard_nodes(np.concatenate(ids), seqs, np.concatenate(words).astype("i8")))


def _roll_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boundary nodes, the deepest first, each added to its parent."""
    columns = pa.Table.from_batches(batches, _NODE).sort_by([("depth", "descending")]).to_pydict()
    at_key = {key: k for k, key in enumerate(columns["key"])}
    children, leaves, saved = columns["n_children"], columns["n_leaves"], columns["saved_tokens"]
    for k, parent in enumerate(columns["parent"]):
        leaves[k] += not children[k]
        saved[k] += (columns["n_convs"][k] - 1) * columns["words"][k]
        if parent is not None:
            up = at_key[parent]
            columns["parent_conv_id"][k] = columns["conv_id"][up]
            children[up] += 1
            leaves[up] += leaves[k]
            saved[up] += saved[k]
    yield from _in_batches(columns)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the ids of each key, sorted by key and id; one key's ids may come in many batches."""
    key, state = None, None
    for batch in released(batches):
        done = {"key": [], "ends_sha256": []}
        for k, i in zip(batch["key"].to_pylist(), batch["conv_id"].to_pylist()):
            if k == key:
                state.update(b",%d" % i)
                continue
            if key is not None:
                done["key"].append(key)
                done["ends_sha256"].append(state.hexdigest())
            key, state = k, hashlib.sha256(b"%d" % i)
        yield pa.RecordBatch.from_pydict(done, schema=pa.schema([("key", pa.string()), ("ends_sha256", pa.string())]))
    if key is not None:
        yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [state.hexdigest()]})


def prefix_trie(convs: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per distinct beginning of the conversations (conv_id, digests, words).

    conv_id: smallest member; depth; parent_conv_id; n_convs; n_children; n_leaves; saved_tokens; ends_sha256.
    """
    spark, scratch = convs.sparkSession, Scratch(convs.sparkSession)
    rows = scratch.write(convs.select("conv_id", "digests", "words", F.unhex(F.array_join("digests", "")).alias("seq")))
    turns = rows.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    shards = shards or max(spark.sparkContext.defaultParallelism, -(-turns // SHARD_TURNS))
    ranged = rows.select("conv_id", "seq", "words").repartitionByRange(shards, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    nodes = scratch.write(ranged.mapInArrow(_grow, NODE))

    sums = {"conv_id": F.min, "n_convs": F.sum, "n_children": F.sum, "n_leaves": F.sum, "saved_tokens": F.sum}
    edge = nodes.where("boundary").groupBy("key").agg(*[sums.get(c, F.first)(c).alias(c) for c in _NODE.names if c != "key"])
    edge = scratch.write(edge.select(*_NODE.names).coalesce(1).mapInArrow(_roll_up, NODE))
    few = F.broadcast if edge.count() <= FEW_NODES else lambda df: df

    keyed = rows.select(chained(F.col("digests")).alias("key"), "conv_id").join(few(edge.select("key")), "key", "left_semi")
    ends = keyed.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_ends, "key string, ends_sha256 string")
    edge_ends = edge.drop("ends_sha256").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    above = few(edge.select(F.col("key").alias("parent"), F.col("conv_id").alias("above")))
    inner = nodes.where("NOT boundary").join(above, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    out = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return inner.select(*out).unionByName(edge_ends.select(*out))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all ``conversations``, rebuilt with shared beginnings."""
    return prefix_trie(share_beginnings(sequences(table(spark, sf_dir, "conversations"))))


def _nibble(n: int) -> int:
    for _ in range(4):
        n = n >> 1 ^ 0xEDB88320 if n & 1 else n >> 1
    return n


# CRC-32 of the id's digits by half-bytes, the lower one first
_HALVES = "list_transform(range(0, 2 * length(s)), lambda i: CASE WHEN i % 2 = 0 THEN ascii(s[i // 2 + 1]) & 15 ELSE ascii(s[i // 2 + 1]) >> 4 END::BIGINT)"
_CRC = f"xor(list_reduce({_HALVES}, lambda a, b: xor(a >> 4, ({[_nibble(n) for n in range(16)]})[(xor(a, b) & 15) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, conv_id::VARCHAR AS s, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS g,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g, words) AS pos FROM t
), c AS (
  SELECT conv_id, {_CRC} % {MOST_SHARED} AS h FROM (SELECT DISTINCT conv_id, s FROM t)
), r AS (
  SELECT c.conv_id, o.pos, o.g, o.words FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % {STEP} AND o.pos <= c.h
  UNION ALL
  SELECT c.conv_id, o.pos, o.g, o.words FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h
), q AS (
  SELECT c.conv_id, coalesce(l, []) AS l, coalesce(w, []) AS w
  FROM c LEFT JOIN (SELECT conv_id, list(g ORDER BY pos) AS l, list(words ORDER BY pos) AS w FROM r GROUP BY conv_id) USING (conv_id)
), p AS (
  SELECT conv_id, d, md5(array_to_string(l[1:d], ',')) AS k, CASE WHEN d > 0 THEN md5(array_to_string(l[1:d - 1], ',')) END AS up,
         CASE WHEN d > 0 THEN w[d] ELSE 0 END AS words, d = len(l) AS ends
  FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM q)
), n AS (
  SELECT k, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY k, d
), m AS (
  SELECT n.*, (SELECT count(*) FROM n AS x WHERE x.up = n.k) AS n_children FROM n
), b AS (
  SELECT p.k, p.d, sum((m.n_children = 0)::BIGINT) AS n_leaves, sum((m.n_convs - 1) * m.words) AS saved_tokens
  FROM m JOIN p ON p.conv_id = m.conv_id AND p.d <= m.d GROUP BY p.k, p.d
)
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, b.n_leaves::BIGINT AS n_leaves,
       b.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN b USING (k, d) LEFT JOIN m AS u ON u.k = m.up AND u.d = m.d - 1
"""
