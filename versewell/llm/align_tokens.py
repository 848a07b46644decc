"""Cross-tokenizer alignment: groups of tokens with common ends, and which tokens of two vocabularies overlap.

Both tokenizers cut the same bytes. The ends of A's tokens and of B's are two ascending lists over all texts of a
slice (each text begins where the last one ended). They are merged by merge paths: diagonals of the merge grid at
equal distances are cut by binary searches, all at once, which divides the merge into independent pieces of equal
work, however long one text is. Each piece sorts its own few ends and emits its overlaps: between two neighbouring
ends lies one A token and one B token, and each overlapping pair has one such stretch. Groups that cross pieces are
stitched: a common end may lie on a piece's edge (its A end in one piece, its B end in the next), so ends are paired
after the pieces are laid side by side, and groups are counted through.

The first pass writes, for each text, its figures and its distinct id pairs with their numbers; counts over all
documents come from that table, and go back to it in blocks of about BLOCK pairs, each broadcast by itself, so no size
of the whole is assumed.

Encoding: neither tokenizer joins a character with a space after it, so texts are cut before spaces into chunks that
encode independently, and each worker keeps a bounded memo of chunks.

Defined results: null, empty and unfaithfully encoded texts (whose joined token bytes differ from space + text) have
zeros and an empty digest; repeated rows count each, also in the corpus-wide counts; a row without doc_id counts as
any other; texts of any length are read whole; other columns but the text are kept unless an output has their name; an
empty table gives an empty result. Equal counts of a B id tie for the highest.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versewell.llm.bpe import byte_table
from versewell.llm.common import Scratch, others, released, table

PIECE, SLICE_BYTES = 4096, 1 << 19
BLOCK = 1_000_000
MEMO_CHUNKS, MEMO_CHARS, AT_ONCE = 150_000, 48, 4096
CUT, RUN = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s \s")  # before spaces; a space inside other white space
OUT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
DDL = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links array<struct<key: bigint, times: bigint>>"
_LINK = pa.struct([("key", pa.int64()), ("times", pa.int64())])
_KIND = pa.schema([*[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("links", pa.list_(_LINK))])


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Pair:
    """Two tokenizers of one Python worker: A by the tokenizers library, B by sentencepiece."""

    _built: dict[str, Pair] = {}

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        byte_of = {c: k for k, c in enumerate(byte_table())}
        tokens = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.a_bytes = [b""] * (tokens[-1][1] + 1)
        for token, k in tokens:
            self.a_bytes[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        # A cuts before white space by its pattern; B has no token that goes on with a space after another character
        first = json.loads(a)["pre_tokenizer"] or {}
        self.cuts = first.get("type") == "ByteLevel" and first["use_regex"] and not any("▁" in p.lstrip("▁") for p in pieces)
        self.sizes = [np.array([len(x) for x in side], "i8") for side in (self.a_bytes, self.b_bytes)]
        self.lone = self.b.piece_to_id("▁")
        self.memo: dict[str, tuple[bytes, bytes, bool]] = {}
        self.older: dict[str, tuple[bytes, bytes, bool]] = {}  # what the memo held when it was full
        self.digits = [self._printed(side) for side in (self.a_bytes, self.b_bytes)]

    @staticmethod
    def _printed(side: list[bytes]) -> np.ndarray:
        """Each id with each of the separators that may follow it, in fields of equal width."""
        width = len(str(len(side))) + 1
        return np.array([[f"{k}{mark}".encode() for mark in (",", "|", ";", "")] for k in range(len(side))], f"S{width}")

    @classmethod
    def get(cls, a: bytes, b: bytes) -> Pair:
        key = hashlib.sha256(a + b).hexdigest()
        if key not in cls._built:
            cls._built[key] = cls(a, b)
        return cls._built[key]

    def cut(self, text: str) -> list[str]:
        """Chunks of a text that begins with a space; all of them do."""
        if not self.cuts:
            return [text]
        if "  " in text or RUN.search(text):
            return CUT.split(text)
        return [" " + part for part in text[1:].split(" ")]

    def _new(self, chunks: list[str]) -> None:
        a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        # B puts a space before what it is given, but not before nothing
        b = self.b.encode([c[1:] for c in chunks], num_threads=1)
        if " " in chunks:
            b[chunks.index(" ")] = [self.lone]
        raw = [c.encode() for c in chunks]
        exact = np.logical_and(self._exact(raw, a, 0), self._exact(raw, b, 1)).tolist()
        self.memo.update((c, (array("i", x).tobytes(), array("i", y).tobytes(), ok)) for c, x, y, ok in zip(chunks, a, b, exact))

    def _exact(self, raw: list[bytes], ids: list[list[int]], side: int) -> np.ndarray:
        """Whether the bytes of the ids are the chunk, for each chunk."""
        of = (self.a_bytes, self.b_bytes)[side]
        flat = list(chain.from_iterable(ids))
        ends = np.cumsum([0, *map(len, ids)])
        sizes = np.concatenate([np.zeros(1, "i8"), np.cumsum(self.sizes[side][flat])])[ends]
        same_size = np.diff(sizes) == [len(r) for r in raw]
        if same_size.all() and b"".join(map(of.__getitem__, flat)) == b"".join(raw):
            return same_size
        return np.array([b"".join(map(of.__getitem__, x)) == r for x, r in zip(ids, raw)], bool)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A's ids, tokens of A in each text, B's ids, tokens of B in each text); none for unfaithful texts."""
        if len(self.memo) > MEMO_CHUNKS:
            self.memo, self.older = {}, self.memo
        cut = [self.cut(" " + t) if t else [] for t in texts]
        new = set().union(*cut).difference(self.memo)
        kept = [c for c in new if c in self.older]
        self.memo.update((c, self.older[c]) for c in kept)
        new = list(new.difference(kept))
        for at in range(0, len(new), AT_ONCE):
            self._new(new[at : at + AT_ONCE])
        sides, counts = ([], []), np.zeros((2, len(texts)), "i8")
        for k, chunks in enumerate(cut):
            if chunks:
                *found, exact = zip(*map(self.memo.__getitem__, chunks))
                if all(exact):
                    for side, ids in enumerate(map(b"".join, found)):
                        sides[side].append(ids)
                        counts[side, k] = len(ids) // 4
        for c in new:
            if len(c) > MEMO_CHARS:
                del self.memo[c]
        a, b = (np.frombuffer(b"".join(side), "<i4").astype("i8") for side in sides)
        return a, counts[0], b, counts[1]


def merge_path(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """How many ends of ``a`` come before each diagonal (every ``piece`` steps of the merge, equal ends of a first)."""
    diagonals = np.arange(0, len(a) + len(b) + piece, piece).clip(max=len(a) + len(b))
    lo, hi = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (lo < hi).any():
        open_ = lo < hi
        mid = (lo + hi) // 2
        # the diagonal's cut lies beyond a[mid] if a[mid] goes before b[diagonal - mid - 1]
        goes = np.zeros(len(mid), bool)
        goes[open_] = a[mid[open_]] <= b[diagonals[open_] - mid[open_] - 1]
        lo, hi = np.where(open_ & goes, mid + 1, lo), np.where(open_ & ~goes, mid, hi)
    return lo


def merge(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two strictly ascending lists of ends that end alike: for each stretch between neighbouring ends its A token
    and its B token, and whether its end is common to both.

    The pieces are rows of one array; each is sorted by itself.
    """
    if not len(a):
        none = np.zeros(0, "i8")
        return none, none, np.zeros(0, bool)
    total = len(a) + len(b)
    from_a = merge_path(a, b, piece)
    diagonals = np.arange(0, total + piece, piece).clip(max=total)
    from_b = diagonals - from_a
    n_a, n_b = np.diff(from_a), np.diff(from_b)
    rows = np.full((len(n_a), piece), np.iinfo("i8").max)
    at = np.arange(piece)
    is_a, is_b = at < n_a[:, None], (at >= n_a[:, None]) & (at < (n_a + n_b)[:, None])
    rows[is_a] = a << 1  # rows are filled in order, so each takes its own stretch of a and of b
    rows[is_b] = b << 1 | 1
    rows.sort(axis=1)
    flat = rows.ravel()[:total]  # only the last piece is not full
    side = flat & 1
    # tokens of A and of B that have ended before each end, counted inside its piece and carried from its edge
    ended_a = (np.arange(total) - np.repeat(diagonals[:-1], np.diff(diagonals))) - _within(side, diagonals) + np.repeat(from_a[:-1], np.diff(diagonals))
    ended_b = np.arange(total) - ended_a
    end = flat >> 1
    twin = np.zeros(total, bool)  # B's end after A's equal one, maybe across the edge of two pieces
    twin[1:] = end[1:] == end[:-1]
    common = np.append(twin[1:], False)
    keep = ~twin
    return ended_a[keep], ended_b[keep], common[keep]


def _within(side: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many ends of B come before each place inside its piece."""
    before = np.cumsum(side) - side
    return before - np.repeat(before[np.minimum(diagonals[:-1], len(side) - 1)], np.diff(diagonals))


class Aligned:
    """The alignment of the texts of one slice."""

    def __init__(self, pair: Pair, texts: list[str | None], piece: int = PIECE):
        self.pair = pair
        self.a, self.n_a, self.b, self.n_b = pair.encode(texts)
        ends = np.cumsum(pair.sizes[0][self.a]), np.cumsum(pair.sizes[1][self.b])
        self.in_a, self.in_b, self.common = merge(*ends, piece)
        self.keys = self.a[self.in_a] * len(pair.b_bytes) + self.b[self.in_b]  # id pair of each link
        text_of_a = np.repeat(np.arange(len(texts)), self.n_a)
        self.text_of = text_of_a[self.in_a]

    def links(self) -> pa.Array:
        """Distinct id pairs of each text and how many of its links hold each."""
        pairs = len(self.pair.a_bytes) * len(self.pair.b_bytes)
        both, times = np.unique(self.text_of * pairs + self.keys, return_counts=True)
        ends = np.searchsorted(both, np.arange(len(self.n_a) + 1) * pairs)
        found = pa.StructArray.from_arrays([pa.array(both % pairs), pa.array(times)], fields=list(_LINK))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)

    def figures(self) -> pa.Array:
        groups, links = (np.bincount(x, minlength=len(self.n_a)) for x in (self.text_of[self.common], self.text_of))
        digests = [hashlib.sha256(g).hexdigest() if g else "" for g in self.printed()]
        return pa.StructArray.from_arrays([*map(pa.array, (self.n_a, self.n_b, groups, links)), pa.array(digests, pa.string()), self.links()], fields=list(_KIND))

    def printed(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        out = [b""] * len(self.n_a)
        if not len(self.a):
            return out
        last_a, last_b = self.in_a[self.common], self.in_b[self.common]  # last tokens of each group
        closes_a, closes_b = np.zeros(len(self.a), "i8"), np.zeros(len(self.b), "i8")
        closes_a[last_a], closes_b[last_b] = 1, 2
        closes_b[np.cumsum(self.n_b)[self.n_b > 0] - 1] = 3  # nothing after the last group of a text
        group_a = np.cumsum(closes_a == 1) - (closes_a == 1)
        group_b = np.cumsum(closes_b >= 2) - (closes_b >= 2)
        # a token's place: its own number and the tokens of the other side that stand before it
        done_a, done_b = last_a + 1, np.concatenate([[0], last_b + 1])
        width = max(x.dtype.itemsize for x in self.pair.digits)
        fields = np.zeros(len(self.a) + len(self.b), f"S{width}")
        fields[np.arange(len(self.a)) + done_b[group_a]] = self.pair.digits[0][self.a, closes_a]
        fields[np.arange(len(self.b)) + done_a[group_b]] = self.pair.digits[1][self.b, closes_b]
        ends = np.cumsum(self.n_a + self.n_b)
        for k in np.flatnonzero(self.n_a):
            out[k] = fields[ends[k] - self.n_a[k] - self.n_b[k] : ends[k]].tobytes().replace(b"\0", b"")
        return out


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    step = max(1, int(batch.num_rows * SLICE_BYTES / max(batch[text].nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def align(df: DataFrame, a: bytes, b: bytes, text: str = "text", block: int = BLOCK) -> DataFrame:
    """Columns of ``df`` but the text, with OUT: tokens, groups and links of each text, and what the corpus-wide counts
    of id pairs say of its links. ``a``, ``b``: the files of the two tokenizers."""
    import sentencepiece

    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    files = spark.sparkContext.broadcast((a, b))
    vocabulary = sentencepiece.SentencePieceProcessor(model_proto=b).get_piece_size()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.get(*files.value)
        for batch in released(batches):  # a slice's links go out before the next slice is read
            for part in _slices(batch, "__text"):
                own = {c: part[c] for c in part.schema.names if c != "__text"}
                made = Aligned(pair, part["__text"].to_pylist()).figures().flatten()
                yield pa.RecordBatch.from_pydict(own | dict(zip(_KIND.names, made)))

    kept = others(df, *OUT, text)
    held = [F.struct(*kept).alias("__kept")] if kept else []
    rows = df.select(F.monotonically_increasing_id().alias("__row"), *held, F.col(f"`{text}`").alias("__text"))
    shape = T.StructType([*(f for f in rows.schema if f.name != "__text"), *T.StructType.fromDDL(DDL)])
    found = scratch.write(rows.mapInArrow(run, shape))

    links = found.select("__row", F.explode("links").alias("link")).select("__row", "link.*")
    counts = scratch.write(links.groupBy("key").agg(F.sum("times").alias("count")))
    blocks = -(-counts.count() // block)
    highest = counts.groupBy((F.col("key") % vocabulary).alias("b")).agg(F.max("count").alias("most"))
    marked = counts.withColumn("b", F.col("key") % vocabulary).join(highest, "b").select("key", "count", (F.col("count") == F.col("most")).alias("best"))
    marked = scratch.write(marked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(max(1, blocks)))))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")]
    parts = []
    for k in range(blocks):  # each of about ``block`` pairs
        part = links.join(F.broadcast(marked.where(F.col("block") == k).drop("block")), "key").groupBy("__row").agg(*sums)
        parts.append(scratch.write(part) if blocks > 1 else part)
    if not parts:
        parts.append(links.selectExpr("__row", "0L AS n_best", "0L AS count_sum"))
    added = parts[0] if blocks <= 1 else reduce(DataFrame.unionByName, parts).groupBy("__row").agg(*[F.sum(c).alias(c) for c in ("n_best", "count_sum")])
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return found.drop("links").join(added, "__row", "left").select(*(["__kept.*"] if kept else []), "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")


def op12_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the 50k byte-level vocabulary (A) and the 32k sentence pieces (B) on every whole text of ``documents``."""
    import public_tokenizers

    a, b = (read_file(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align(docs, a, b)
