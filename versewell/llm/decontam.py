"""Benchmark decontamination: CGK embedding of word windows or whole pieces of short items, exact edit check.

Texts are words (lower case, punctuation dropped). An item of n words may be edited in n * (1 - share) places.

Items of at least LONG words are found by LSH. The CGK random walk reads a window of WINDOW words word by word: at
step j it writes the word under the pointer and moves on if a random bit of (j, word) says so; sequences at a
small edit distance end up at a small Hamming distance, because walks that were put out of step by an edit
meet again. A repetition samples COORDINATES of the written words (the first one always); windows that agree
on them are candidates. An item has a window at each place where a whole one fits, a document at each place whose
two words follow each other in some long item, so an item is found if any of its windows is. Windows of shorter
items are too few for that, wherever the edits are.

Shorter items, of one word and more, are found without loss: an item that may be edited in e places is cut into
e + 1 pieces of whole words, and an edit spoils one of them at most, so every passage holds a piece as it is. Each
place of a document that holds one is a candidate, unless more than e words of the item are missing from where
e edits can have moved them.

Every candidate is checked exactly: the least number of word insertions, deletions and replacements that
turn the item into some stretch of the document (bit-parallel dynamic programming) must be at most
(1 - share) of the item's words.

The items travel with the code in blocks of at most BLOCK_BYTES, one pass over the documents for each block.

Defined results: null and empty texts match nothing; items of fewer words than 1 / (1 - share) match only as they
are; repeated items and documents are each reported; an empty table on either side gives no row.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versewell.llm.common import Scratch, released, table

WINDOW, WALKS, SAMPLES, COORDINATES, SEED, LONG = 12, 3, 4, 5, 11, 40
SHARE, BLOCK_BYTES, SLICE_BYTES, PAIR_BITS, PLACES = 0.8, 8 << 20, 1 << 19, 22, 1 << 19
_SPACE = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_QUOTES = re.compile(rb"\xe2\x80[\x80-\xbf]")


def words_of(text: str | None) -> list[bytes]:
    raw = (text or "").lower().encode()
    if b"\xe2\x80" in raw:
        raw = _QUOTES.sub(b" ", raw)
    return raw.translate(_SPACE).split()


def infix_distance(item: list, words: list) -> tuple[int, int]:
    """Least edits that turn ``item`` into a stretch of ``words``, and the end of the first such stretch (Myers)."""
    n = len(item)
    places: dict = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    full, last = (1 << n) - 1, 1 << (n - 1)
    plus, minus, edits, best, end = full, 0, n, n, 0
    for j, w in enumerate(words, 1):
        eq = places.get(w, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(d | plus)), d & plus
        edits += bool(up & last) - bool(down & last)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(x | up)), up & x
        if edits < best:
            best, end = edits, j
    return best, end


class Index:
    """LSH tables over the windows of the long items of one block, and tables of the pieces of its short ones."""

    def __init__(self, items: list[tuple[int, list[bytes]]], share: float = SHARE):
        self.items = [(i, w) for i, w in items if w]
        self.slack = np.array([int(len(w) * (1 - share) + 1e-9) for _, w in self.items], "i8")
        self.lengths = np.array([len(w) for _, w in self.items], "i8")
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in self.items for w in ws}), 1)}
        self.own_words = [set(ws) for _, ws in self.items]
        rng, long = np.random.default_rng(SEED), np.flatnonzero(self.lengths >= LONG).tolist()
        pairs = [(self.vocabulary[a], self.vocabulary[b]) for k in long for a, b in zip(self.items[k][1], self.items[k][1][1:])]
        self.pairs = np.zeros(1 << PAIR_BITS, bool)  # hashed; what it lets through too much, the keys sort out
        if pairs:
            self.pairs[self._pair(*np.array(pairs).T)] = True
        self.tables = []  # (steps of a walk's bits, [(coordinates, allowed words at each, sorted keys, item and offset)])
        for _ in range(WALKS):
            bits = rng.integers(0, 2, (2 * WINDOW, len(self.vocabulary) + 1), dtype="i8")
            samples = [np.sort(rng.choice(np.arange(1, 2 * WINDOW - 2), COORDINATES, replace=False)) for _ in range(SAMPLES)]
            if long:
                self.tables.append((bits, [self._table(long, WINDOW, bits, c) for c in samples]))
        self.short = np.zeros((len(self.items), min(int(self.lengths.max(initial=0)), LONG - 1)), "i4")
        self.pieces = self._pieces(np.flatnonzero(self.lengths < LONG).tolist())

    def _pieces(self, mine: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By number of words: (hashed keys there are, sorted keys, item and offset) of the pieces of short items."""
        found: dict[int, list] = {}
        for k in mine:
            n = len(self.items[k][1])
            self.short[k, :n] = [self.vocabulary[w] for w in self.items[k][1]]
            cuts = [i * n // (min(self.slack[k], n - 1) + 1) for i in range(min(self.slack[k], n - 1) + 2)]
            for a, b in zip(cuts, cuts[1:]):
                found.setdefault(int(b - a), []).append((k, a))
        out = {}
        for size, whose in sorted(found.items()):
            at, key = np.array(whose), np.zeros(len(whose), "u8")
            for j in range(size):
                key = self._mix(key, self.short[at[:, 0], at[:, 1] + j])
            there = np.zeros(1 << PAIR_BITS, bool)
            there[key >> np.uint64(64 - PAIR_BITS)] = True
            order = np.argsort(key, kind="stable")
            out[size] = there, key[order], at[order]
        return out

    def _table(self, mine: list[int], size: int, bits: np.ndarray, coordinates: np.ndarray):
        flat, starts, whose = [], [], []
        for k in mine:
            ids = [self.vocabulary[w] for w in self.items[k][1]]
            for offset in range(len(ids) - size + 1):
                starts.append(len(flat) + offset)
                whose.append((k, offset))
            flat += [*ids, *[0] * 2 * size]
        at, symbols = np.array(starts), np.array(flat)
        first = written = symbols[at]
        key, allowed = self._mix(np.zeros(len(at), "u8"), first), [np.bincount(first, minlength=bits.shape[1]) > 0]
        for j in range(coordinates[-1]):
            at = at + bits[j, symbols[at]]
            if j + 1 in coordinates:
                written = symbols[at]
                key = self._mix(key, written)
                allowed.append(np.bincount(written, minlength=bits.shape[1]) > 0)
        order = np.argsort(key, kind="stable")
        return coordinates, allowed, key[order], np.array(whose)[order]

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 0x9E3779B1 + b * 0x85EBCA6B >> 12) & ((1 << PAIR_BITS) - 1)

    @staticmethod
    def _mix(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = (key ^ symbol.astype("u8")) * np.uint64(0x9E3779B97F4A7C15)
        return key ^ (key >> np.uint64(31))

    def candidates(self, symbols: np.ndarray) -> np.ndarray:
        """Rows (item, place where the item would begin) over the words of many texts in one array, in order."""
        found = [*self._of_windows(symbols), *self._of_pieces(symbols)]
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), "i8")

    def _of_windows(self, symbols: np.ndarray) -> Iterator[np.ndarray]:
        known = np.flatnonzero((symbols[:-1] > 0) & (symbols[1:] > 0))
        known = known[self.pairs[self._pair(symbols[known].astype("i8"), symbols[known + 1].astype("i8"))]]
        for bits, samples in self.tables:
            padded = np.concatenate([symbols, np.zeros(len(bits) + 1, symbols.dtype)])
            for coordinates, allowed, keys, whose in samples:
                start = known[allowed[0][padded[known]]]
                at, key, j = start, self._mix(np.zeros(len(start), "u8"), padded[start]), 0
                for c, may in zip(coordinates.tolist(), allowed[1:]):
                    while j < c and len(at):
                        at = at + bits[j, padded[at]]
                        j += 1
                    here = padded[at]
                    ok = may[here]
                    start, at, key = start[ok], at[ok], self._mix(key[ok], here[ok])
                    j = c
                yield from self._joined(start, key, keys, whose)

    def _of_pieces(self, symbols: np.ndarray) -> Iterator[np.ndarray]:
        keys, run = np.zeros(len(symbols), "u8"), np.ones(len(symbols), bool)
        for j in range(min(max(self.pieces, default=0), len(symbols))):
            n = len(symbols) - j
            keys, run = self._mix(keys[:n], symbols[j:]), run[:n] & (symbols[j:] > 0)
            if j + 1 in self.pieces:
                there, mine, whose = self.pieces[j + 1]
                at = np.flatnonzero(run & there[keys >> np.uint64(64 - PAIR_BITS)])
                for part in self._joined(at, keys[at], mine, whose):
                    yield self._possible(np.unique(part, axis=0), symbols)

    @staticmethod
    def _joined(start: np.ndarray, key: np.ndarray, keys: np.ndarray, whose: np.ndarray) -> Iterator[np.ndarray]:
        """(item, begin) of each place and each entry of its key, in parts of about PLACES rows."""
        lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
        start, lo, n = start[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        part = (np.cumsum(n) - n) // PLACES
        for p in np.unique(part).tolist():
            s, at, m = start[part == p], lo[part == p], n[part == p]
            entry = np.repeat(at - (np.cumsum(m) - m), m) + np.arange(m.sum())
            yield np.column_stack([whose[entry, 0], np.repeat(s, m) - whose[entry, 1]])

    def _possible(self, found: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The candidates of short items that miss no more words than may be edited, each looked for where edits can move it."""
        pad, kept = 2 * LONG, []
        padded = np.concatenate([np.zeros(pad, symbols.dtype), symbols, np.zeros(2 * pad, symbols.dtype)])
        slack = self.slack[found[:, 0]]
        for e in np.unique(slack).tolist():
            mine = found[slack == e]
            missing = np.zeros(len(mine), "i8")
            for j in range(self.short.shape[1]):
                word, at = self.short[mine[:, 0], j], mine[:, 1] + pad + j
                there = word == 0  # past the item's end
                for t in range(-min(e, LONG), min(e, LONG) + 1):
                    there |= padded[at + t] == word
                missing += ~there
                mine, missing = mine[missing <= e], missing[missing <= e]
            kept.append(mine)
        return np.concatenate(kept)

    def hits(self, texts: list[str | None], share: float) -> list[tuple[int, int, int, int]]:
        """(place of the text, item id, words of the item, edits) of every text that holds an item; ``share``: that of the index or more."""
        docs = [words_of(t) for t in texts]
        lengths = np.array([len(d) for d in docs])
        get = self.vocabulary.get
        symbols = np.fromiter((get(w, 0) for d in docs for w in d), "i4", int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths
        best: dict[tuple[int, int], int] = {}
        found = self.candidates(symbols)
        n, begins = self.lengths[found[:, 0]], found[:, 1]
        places = np.column_stack([begins, begins + n // 2, begins + n - 1]).clip(0, max(len(symbols) - 1, 0))
        whose = np.searchsorted(starts, places, "right") - 1  # the candidate may begin or end past its text
        for (k, begin), of in zip(found.tolist(), whose.tolist()):
            item_id, item = self.items[k]
            slack = int(len(item) * (1 - share) + 1e-9)
            for d in {*of}:
                if best.get((d, k)) == 0:
                    continue
                lo = max(begin - int(starts[d]) - 2 * slack, 0)
                part = docs[d][lo : max(begin - int(starts[d]) + len(item) + 2 * slack, 0)]
                if sum(map(self.own_words[k].__contains__, part)) < len(item) - slack:
                    continue
                if (Counter(item) & Counter(part)).total() < len(item) - slack:
                    continue
                edits, _ = infix_distance(item, part)
                if edits <= slack and edits < best.get((d, k), edits + 1):
                    best[d, k] = edits
        return [(d, self.items[k][0], len(self.items[k][1]), e) for (d, k), e in sorted(best.items())]


def _blocks(items: DataFrame, item_id: str, item_text: str):
    """The items as broadcast lists of (id, words), each of at most about BLOCK_BYTES of text; how many there are."""
    size = items.agg(F.coalesce(F.sum(F.octet_length(item_text) + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64(item_id, item_text), F.lit(blocks)) == k).select(item_id, item_text)
        rows = sorted(mine.collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        yield items.sparkSession.sparkContext.broadcast([(i, words_of(t)) for i, t in rows]), blocks


def _sliced(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    step = max(1, int(len(texts) * SLICE_BYTES / max(texts.nbytes, 1)))
    for at in range(0, len(texts), step):
        yield at, texts.slice(at, step).to_pylist()


def _is_clean(held, share: float):
    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(held.value, share)
        for batch in released(batches):
            keep = np.ones(len(batch), bool)
            for at, texts in _sliced(batch):
                keep[[at + d for d, *_ in index.hits(texts, share)]] = False
            yield pa.array(keep)

    return clean


def drop_contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no item; all columns stay."""
    scratch = Scratch(docs.sparkSession)
    for held, blocks in _blocks(items, item_id, item_text):
        docs = docs.where(_is_clean(held, share)(F.col(text)))
        if blocks > 1:  # one block at a time on the driver and in the tasks
            docs = scratch.write(docs)
            held.destroy()
    return docs


def contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(``key``, ``item_id``, item_words, edits): every item that a document holds up to the allowed edits."""
    parts, scratch = [], Scratch(docs.sparkSession)
    for held, blocks in _blocks(items, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = Index(held.value, share)
            for batch in released(batches):
                keys, texts = batch.columns
                for at, part in _sliced(texts):
                    if rows := index.hits(part, share):
                        d, i, n, e = (pa.array(x, pa.int64()) for x in zip(*rows))
                        yield pa.RecordBatch.from_arrays([keys.slice(at).take(d), i, n, e], ["key", "item", "item_words", "edits"])

        kind = docs.schema[key].dataType.simpleString()
        part = docs.select(key, text).mapInArrow(run, f"key {kind}, item bigint, item_words bigint, edits bigint")
        if blocks > 1:
            part = scratch.write(part)
            held.destroy()
        parts.append(part)
    found = reduce(DataFrame.unionByName, parts)
    return found.select(F.col("key").alias(key), F.col("item").alias(item_id), "item_words", "edits")


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of ``benchmark`` in every whole text of ``documents``, at a word similarity of 0.8 or more."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
