"""Byte-level BPE: the tokenizers library over Arrow batches, with offsets, and the exact way back.

A vocabulary is a file of ``base64(token bytes) rank`` lines. Every byte stands for one printable
character (the byte table below), so a byte vocabulary can be given to the tokenizers library, which
merges characters. A merge is allowed for *every* split of a token into two known tokens, in the order
of the ranks, because rank-driven encoders merge any neighbours whose union is known.

Texts are first cut by the pattern; each match ("piece") is encoded by itself, and pieces repeat so much
that each worker keeps a bounded memo of them. Nothing is cut to a prefix, and no special tokens exist.

Defined results: null text encodes as the empty text; empty text gives no ids; ids that no token has
raise; decoded bytes that are not whole characters are replaced when text (not bytes) is asked for; repeated
rows are encoded each; texts of any length are encoded whole; outputs take the place of columns of their
names, all others stay; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versewell.llm.common import others, released, table

MEMO_PIECES, MEMO_CHARS = 250_000, 48


def byte_table() -> list[str]:
    """Character of each byte: printable Latin-1 keeps its own, the others get those from U+0100 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in keep else next(spare)) for b in range(256)]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@cache
def is_class(one: str, char: str) -> bool:
    """Whether tiktoken's regular expressions count ``char`` as one of the class ``one``."""
    import tiktoken

    return bool(tiktoken.Encoding("class", pat_str=one, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}).encode_ordinary(char))


class ByteBpe:
    """Encoder and decoder of one vocabulary; built once per Python worker (see ``get``)."""

    _built: dict[str, ByteBpe] = {}

    def __init__(self, vocabulary: bytes, pattern: str):
        import regex
        from tokenizers import Tokenizer, models

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        self.find = self.pattern.findall
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.sizes = np.array([len(b) for b in self.bytes_of] or [0], "i8")
        chars = byte_table()
        as_chars = {token: "".join(map(chars.__getitem__, token)) for token in ranks}
        merges = [
            (as_chars[token[:k]], as_chars[token[k:]])
            for token in sorted(ranks, key=ranks.__getitem__)
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        ]
        vocab = {as_chars[token]: rank for token, rank in ranks.items()}
        self.tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges, cache_capacity=0))
        self.chars_of_bytes = {b: c for b, c in enumerate(chars)}
        self.memo: dict[str, bytes] = {}

    @classmethod
    def get(cls, vocabulary: bytes, pattern: str) -> ByteBpe:
        key = hashlib.sha256(vocabulary + pattern.encode()).hexdigest()
        if key not in cls._built:
            cls._built[key] = cls(vocabulary, pattern)
        return cls._built[key]

    def cut(self, text: str) -> list[str]:
        """Matches of the pattern. Characters newer than this Python's Unicode tables go by the classes of tiktoken's."""
        try:
            text.encode("latin-1")
            return self.find(text)
        except UnicodeEncodeError:
            odd = [c for c in set(text) if unicodedata.category(c) == "Cn"]
        if not odd:
            return self.find(text)
        stand_in = {ord(c): "\u00df" if is_class(r"\p{L}", c) else "\u0660" if is_class(r"\p{N}", c) else "\ue000" for c in odd}
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(stand_in))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.cut(text or "") for text in texts]
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        new = list(set().union(*cut).difference(self.memo))
        mapped = [p.encode().decode("latin-1").translate(self.chars_of_bytes) for p in new]
        found = self.tokenizer.encode_batch_fast(mapped, add_special_tokens=False)
        self.memo.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(new, found))
        out = [b"".join(map(self.memo.__getitem__, pieces)) for pieces in cut]
        for p in new:
            if len(p) > MEMO_CHARS:
                del self.memo[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        """Bytes of one text's ids."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes, decoded: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of each token. A token that holds only a part of a character covers it."""
        ends = np.cumsum(self.sizes[np.frombuffer(ids, "<u4")])
        if not len(ends):
            return np.zeros(0, "<u4"), np.zeros(0, "<u4")
        raw = np.frombuffer(self.decode(ids) if decoded is None else decoded, "u1")
        char = np.cumsum((raw & 0xC0) != 0x80, dtype="<u4")  # characters begun up to each byte
        return char[np.concatenate([[0], ends[:-1]])] - 1, char[ends - 1]


def encode(df: DataFrame, vocabulary: bytes, pattern: str, text: str = "text", out: str = "bpe") -> DataFrame:
    """Add ``out``: struct<ids, starts, ends> (character offsets, end exclusive) of the whole text."""
    kind = T.StructType([T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("ids", "starts", "ends")])
    held = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = ByteBpe.get(held.value, pattern)
        for batch in released(batches):
            rows = []
            for ids in bpe.encode(batch.to_pylist()):
                starts, ends = bpe.offsets(ids)
                rows.append({"ids": np.frombuffer(ids, "<i4"), "starts": starts.astype("i4"), "ends": ends.astype("i4")})
            yield pa.array(rows, pa.struct([(n, pa.list_(pa.int32())) for n in ("ids", "starts", "ends")]))

    return df.select(*others(df, out), run(F.col(text)).alias(out))


def decode(df: DataFrame, vocabulary: bytes, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text of an ids column; broken characters become U+FFFD, null ids stay null."""
    held = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf(T.StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = ByteBpe.get(held.value, pattern)
        for batch in released(batches):
            rows = (None if x is None else bpe.decode(np.array(x, "<u4").tobytes()) for x in batch.to_pylist())
            yield pa.array([x if x is None else x.decode("utf-8", "replace") for x in rows], pa.string())

    return df.select(*others(df, out), run(F.col(ids)).alias(out))


def digests(df: DataFrame, vocabulary: bytes, pattern: str, text: str = "text", ids: bool = False, slice_bytes: int = 1 << 20) -> DataFrame:
    """Per row, what it encodes to and decodes back to: n_tokens and the SHA-256 of ids, of decoded bytes and of offsets.

    The offsets are the first character of each token, then the end of each, as unsigned 32-bit integers.
    ``ids``: also the ids themselves.
    """
    kind = f"struct<n_tokens bigint, ids_sha256 string, decoded_sha256 string, offsets_sha256 string{', ids array<int>' * ids}>"
    with_ids = ids
    held = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = ByteBpe.get(held.value, pattern)
        for batch in released(batches):
            n, ids_hex, text_hex, place_hex, whole = [], [], [], [], []
            step = max(1, int(len(batch) * slice_bytes / max(batch.nbytes, 1)))
            for at in range(0, len(batch), step):
                for ids in bpe.encode(batch.slice(at, step).to_pylist()):
                    n.append(len(ids) // 4)
                    if with_ids:
                        whole.append(ids)
                    ids_hex.append(hashlib.sha256(ids).hexdigest())
                    decoded = bpe.decode(ids)
                    text_hex.append(hashlib.sha256(decoded).hexdigest())
                    place_hex.append(hashlib.sha256(np.concatenate(bpe.offsets(ids, decoded))).hexdigest())
            hexes = {"ids_sha256": ids_hex, "decoded_sha256": text_hex, "offsets_sha256": place_hex}
            columns = {"n_tokens": pa.array(n, pa.int64()), **{k: pa.array(v, pa.string()) for k, v in hexes.items()}}
            if with_ids:
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                columns["ids"] = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(whole), "<i4")))
            yield pa.StructArray.from_arrays(list(columns.values()), list(columns))

    return df.withColumn("__bpe", run(F.col(text))).select(*others(df, "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256", *["ids"] * with_ids), "__bpe.*")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents`` by the 50k multilingual byte vocabulary."""
    import public_tokenizers

    vocabulary = read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, vocabulary, public_tokenizers.PATTERN).drop("text")
