"""Secret scans: keywords by an Aho-Corasick automaton, anchored expressions at its hits, then checksums.

One pass of the automaton over the text (letters A-Z lower-cased) finds every place where a keyword stands;
an expression is tried at those places only, from left to right, never inside the match before it, which is
what a scan of the whole text by that expression gives. Long runs of hexadecimal digits have no keyword:
the text is mapped to two letters (digit or not) and the "keyword" is a run of 24. All steps are linear in
the text: the characters before a run are counted from the run before it on.

Kinds: ``assign``, ``access`` and ``hex``, and two that carry a checksum in their last six characters
(base-62 CRC-32 of the characters between prefix and checksum), which must be right: ``git`` and ``npm``.

Defined results: null and empty texts have no spans; offsets are code points, ends exclusive; texts are
scanned whole, however long; repeated rows are scanned each; the output takes the place of a column of its
name, all other columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versewell.llm.common import others, released, table

HEX_RUN = 24
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "git", "npm")
#: kind -> keywords (lower case), expression, group that counts, least length of it
RULES = {
    "assign": (
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I),
        2,
        6,
    ),
    "access": (("akia",), re.compile("AKIA[A-Z0-9]+"), 0, 20),
    "git": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile("gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])"), 0, 40),
    "npm": (("npm_",), re.compile("npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])"), 0, 40),
}
CHECKED = ("git", "npm")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    while n or len(out) < 6:
        n, k = divmod(n, 62)
        out = DIGITS[k] + out
    return out


@cache
def _automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for kind, (words, *_) in RULES.items():
        for word in words:
            automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


_IS_HEX = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by start, then kind as listed."""
    if not text:
        return []
    raw = text.encode()
    spans, free = [], dict.fromkeys(RULES, 0)
    hits = ((end - n + 1, kind) for end, (kind, n) in _automaton().iter(raw.lower().decode()))
    for start, kind in sorted(hits):
        _, expression, group, least = RULES[kind]
        if start >= free[kind] and (m := expression.match(text, start)):
            free[kind] = m.end()
            if m.end(group) - m.start(group) >= least and (kind not in CHECKED or checksum(m[0][4:-6]) == m[0][-6:]):
                spans.append((kind, m.start(), m.end()))
    mapped, run = raw.translate(_IS_HEX), b"x" * HEX_RUN
    at, done, chars = mapped.find(run), 0, 0  # so many bytes are so many characters
    while at >= 0:
        end = mapped.find(b" ", at)
        end = len(mapped) if end < 0 else end
        start = chars + len(raw[done:at].decode())
        done, chars = end, start + end - at
        spans.append(("hex", start, chars))
        at = mapped.find(run, end)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Add ``out``: array<struct<kind, start, end>>."""

    @F.arrow_udf("array<struct<kind string, start int, end int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in released(batches):
            yield pa.array([[dict(zip(("kind", "start", "end"), s)) for s in scan(x.as_py())] for x in batch], kind)

    return df.select(*others(df, out), run(F.col(text)).alias(out))


def masked(text: str | None) -> str | None:
    """The text with each stretch of overlapping spans replaced by the kinds that meet there."""
    spans = scan(text)
    if not spans:
        return text
    out, done, kinds, begin, end = [], 0, [], spans[0][1], spans[0][2]
    for kind, start, stop in [*spans, ("", len(text) + 1, len(text) + 1)]:
        if start >= end:
            out += [text[done:begin], f"[{'+'.join(dict.fromkeys(kinds))}]"]
            done, kinds, begin, end = end, [], start, stop
        kinds.append(kind)
        end = max(end, stop)
    return "".join([*out, text[done:]])


def mask_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace every secret in ``text`` by its kinds in brackets; texts without secrets stay as they are."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in released(batches):
            yield pa.array([masked(x.as_py()) for x in batch], pa.string())

    return df.withColumn(text, run(F.col(text)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan every whole text of ``documents``."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"),
    )
