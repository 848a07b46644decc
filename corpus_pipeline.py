"""Cleaning ``documents`` for training, in five stages; each works on all that the one before it kept.

1. language ID: documents without a recognised language go (no letter, or a score under MIN_SCORE);
2. near-duplicates: of each component at a similarity of 0.8 of five-word shingles its smallest id stays;
3. decontamination: documents that hold a passage of ``benchmark`` go;
4. secrets: passwords, keys and tokens in texts are masked, all documents stay;
5. byte-level BPE: token ids of each text, with digests of the ids and of the text that they decode to.

Stages 1 to 4 return the columns of ``documents``. The stages learn from what they are given: the language
model is fitted on a bounded sample of the labelled documents of its own input.

Defined results: null, empty and letterless texts go in stage 1. A row without an id counts, in stage 2, by a key
made of its text, larger than any id, so it goes where a row with an id is its copy. Rows of equal id (or none)
and equal text leave one row; rows of equal id and different texts are one document and stay or go together. Texts
of any length are read whole; extra columns stay up to the last stage, which keeps doc_id, lang and source beside
its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versewell.llm import bpe, decontam, language, near_dup, secret_scan
from versewell.llm.common import Scratch, table

MIN_SCORE = 0.4  # chance is 0.25 with four languages; clean held-out documents score 0.44 and more
ORACLE_SQL = None  # no SQL for a recurrent network, edit distances or BPE


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language.identify(docs, language.fit(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    by_text = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    keyed = docs.withColumn("__key", F.coalesce("doc_id", by_text))
    found = near_dup.near_duplicates(keyed, key="__key")
    marks = found.groupBy("__key").agg(F.max(F.col("__key") != F.col("component_id")).alias("copy"), F.count("*").alias("n"))
    marks = Scratch(spark).write(marks.where("copy OR n > 1"))
    once = keyed.join(marks, "__key", "left_anti")
    again = keyed.join(marks.where("NOT copy"), "__key", "left_semi").withColumn("__print", F.xxhash64("text")).dropDuplicates(["__key", "__print"])
    return once.select(*docs.columns).unionByName(again.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.mask_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(docs.select("doc_id", "lang", "source", "text"), vocabulary, public_tokenizers.PATTERN, ids=True).drop("text")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
