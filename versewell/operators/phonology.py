"""Syllable jobs: parsing, weights, comparison and its errors. Each is one Arrow pass; nothing is shuffled by syllable."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from versewell.functions import phonology as P
from versewell.plans import views as V
from versewell.sources.storage import written

SYLLABLE = "struct<onset array<string>, vowel string, long boolean, marks string, coda array<string>, word int>"
COUNTS = ("ref", "heard", "missing", "added", "replaced", "syllables", "phonemes", "vowels")
MORE = ("breaths", "sandhi", "sounds", "vowel_slips")
PADAS = f"array<struct<{', '.join(f'{c} int' for c in P.PADA)}>>"
RESULT = f"struct<{', '.join(f'{c} int' for c in (*COUNTS, *MORE))}, lines array<int>, padas {PADAS}, errors array<struct<kind string, at int, ref string, heard string>>>"
EXAMPLES, ANUSHTUBH = 12, 8


def syllabify(df: DataFrame, text: str, out: str = "aksharas") -> DataFrame:
    names = ("onset", "vowel", "long", "marks", "coda", "word")
    kind = pa.list_(pa.struct([("onset", pa.list_(pa.string())), ("vowel", pa.string()), ("long", pa.bool_()), ("marks", pa.string()), ("coda", pa.list_(pa.string())), ("word", pa.int32())]))

    def run(batch: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(names, s)) for s in P.syllables(x.as_py())] for x in batch], kind)

    return df.withColumn(out, F.arrow_udf(run, f"array<{SYLLABLE}>")(F.col(text)))


def weigh(df: DataFrame, aksharas: str = "aksharas", out: str = "weights") -> DataFrame:
    """Light or heavy, natively from the parsed syllables."""
    a = F.col(aksharas)
    heavy = lambda x, i: (x["vowel"] == "") | x["long"] | (x["marks"] != "") | (F.size(x["coda"]) > 0) | F.coalesce(F.size(F.get(a, i + 1)["onset"]) >= 2, F.lit(False))
    return df.withColumn(out, F.array_join(F.transform(a, lambda x, i: F.when(heavy(x, i), "G").otherwise("L")), ""))


def compare_phonology(pairs: DataFrame, ref: str, heard: str, out: str = "p", per_pada: Column | None = None, offset: Column | None = None) -> DataFrame:
    """Add ``out``: scores and counts of a hearing against a text, its errors, and its figures by line and by pāda.

    ``per_pada``: syllables in a pāda (null: no metre), counted from the syllable ``offset`` on.
    """
    pada = pa.list_(pa.struct([(c, pa.int32()) for c in P.PADA]))
    error = pa.list_(pa.struct([("kind", pa.string()), ("at", pa.int32()), ("ref", pa.string()), ("heard", pa.string())]))
    kind = pa.struct([*[(c, pa.int32()) for c in (*COUNTS, *MORE)], ("lines", pa.list_(pa.int32())), ("padas", pada), ("errors", error)])

    def run(a: pa.Array, b: pa.Array, n: pa.Array, skipped: pa.Array) -> pa.Array:
        return pa.array([P.compare(*(v.as_py() for v in row)) for row in zip(a, b, n, skipped)], kind)

    metre = F.lit(None) if per_pada is None else per_pada, F.lit(0) if offset is None else offset
    return pairs.withColumn(out, F.arrow_udf(run, RESULT)(F.col(ref), F.col(heard), *[c.cast("int") for c in metre]))


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive turns as reference and hearing."""
    nxt = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return V.table(spark, d, "conversations").select("conv_id", "turn", "text", nxt.alias("heard")).where("heard IS NOT NULL")


def q_syllabify(spark: SparkSession, d: str) -> DataFrame:
    a = weigh(syllabify(V.table(spark, d, "conversations"), "text"))
    return a.select("conv_id", "turn", F.size("aksharas").alias("aksharas"), F.size(F.filter("aksharas", lambda x: x["long"])).alias("long_vowels"), "weights")


def compared_turns(spark: SparkSession, d: str) -> DataFrame:
    return compare_phonology(turn_pairs(spark, d), "text", "heard", per_pada=F.lit(ANUSHTUBH))


def q_weights(spark: SparkSession, d: str) -> DataFrame:
    """Light and heavy syllables of every turn: the pattern, and how many of each."""
    a = weigh(syllabify(V.table(spark, d, "conversations"), "text"))
    heavy = F.regexp_count("weights", F.lit("G")).cast("long")
    return a.select("conv_id", "turn", "weights", heavy.alias("heavy"), (F.length("weights") - heavy).alias("light"))


def q_compare(spark: SparkSession, d: str) -> DataFrame:
    return compared_turns(spark, d).select("conv_id", "turn", *[f"p.{c}" for c in (*COUNTS, *MORE)], "p.lines", "p.padas")


def error_histogram(errors: DataFrame, by: list[str], examples: int = EXAMPLES) -> DataFrame:
    """How often each kind of error occurs, and its first examples in the order of ``by`` and its place.

    ``errors``: kind, at, ref, heard and ``by``. Examples are found by a window that keeps no more than their number
    for each key, before any group is formed.
    """
    first = W.partitionBy("kind").orderBy(*by, "at", "place")
    shown = F.struct(*by, "at", "place", "ref", "heard")
    some = errors.withColumn("n", F.row_number().over(first)).where(F.col("n") <= examples)
    some = some.groupBy("kind").agg(F.sort_array(F.collect_list(shown)).alias("examples"))
    return errors.groupBy("kind").agg(F.count("*").alias("errors")).join(some, "kind")


def q_errors(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of errors over all turns, with the first twelve of each."""
    listed = F.transform("p.errors", lambda e, k: F.struct(e["kind"].alias("kind"), e["at"].alias("at"), k.alias("place"), e["ref"].alias("ref"), e["heard"].alias("heard")))
    errors = written(compared_turns(spark, d).select("conv_id", "turn", F.inline(listed)))
    return error_histogram(errors, ["conv_id", "turn"]).select("kind", "errors", F.to_json("examples").alias("examples"))


SCRIPTS = {"Deva": 0x0900, "Beng": 0x0980, "Gujr": 0x0A80, "Telu": 0x0C00, "Knda": 0x0C80}


def convert_script(text, source: str, target: str):
    """Text of one Indic script in another: the blocks have the same layout, so characters are shifted, natively."""
    block = lambda name: "".join(chr(SCRIPTS[name] + k) for k in range(0x80))
    return F.translate(text, block(source), block(target))


def transliterate(words: DataFrame, word: str, out: str = "deva") -> DataFrame:
    """Add the Devanagari spelling of distinct Latin words."""
    return words.withColumn(out, F.arrow_udf(lambda x: pa.array([P.written(w.as_py() or "") for w in x], pa.string()), "string")(F.col(word)))


def q_transliterate(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct word of the corpus once in Devanagari, with the number of its documents."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    w = V.table(spark, d, "documents").select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("documents"))
    return transliterate(w, "word")


def q_convert_script(spark: SparkSession, d: str) -> DataFrame:
    """The same words in Kannada, and whether the way back is exact."""
    w = q_transliterate(spark, d).withColumn("knda", convert_script(F.col("deva"), "Deva", "Knda"))
    return w.select("word", "knda", (convert_script(F.col("knda"), "Knda", "Deva") == F.col("deva")).alias("exact"))


QUERIES = {"transliterate": q_transliterate, "convert_script": q_convert_script, "syllabify": q_syllabify, "syllable_weights": q_weights, "compare_phonology": q_compare, "agg_error_histogram": q_errors}
ORACLE: dict[str, str] = {}
