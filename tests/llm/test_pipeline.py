"""The corpus pipeline: what goes, what stays, and the columns between its stages."""

import corpus_pipeline as P
from tests.conftest import SMALL
from versewell.llm import decontam, near_dup


def test_stages(spark, duck):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = P.language_id(spark, docs, SMALL)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()
    one = P.near_duplicates(spark, docs, SMALL)
    found = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {i for i, c in found.items() if i == c}
    clean = P.decontamination(spark, docs, SMALL)
    items = {i: decontam.words_of(t) for i, t in duck.sql("SELECT item_id, text FROM benchmark").fetchall()}
    dirty = {d for d, t in before.items() if any(decontam.infix_distance(w, decontam.words_of(t))[0] <= len(w) * 0.2 for w in items.values())}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(before) - dirty
    masked = P.secrets(spark, docs, SMALL)
    assert masked.columns == docs.columns and masked.count() == docs.count() and masked.where("n_chars <> length(text)").count() == 0


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    long = "das ist ein langes Wort und noch eines " * 40_000  # more than a megabyte
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "one two three", "en", "s", 7), (3, "one two three", "en", "s", 7), (None, "one two three", "en", "s", 7),
            (None, "four five six", "en", "s", 7), (None, "four five six", "de", "s", 7), (4, "seven", "en", None, 1), (4, "eight", "en", None, 1), (5, long, "de", "s", 1), (6, long, "de", "s", 1)]
    odd = spark.createDataFrame(rows, docs.schema).selectExpr("*", "1 AS score", "'k' AS `key`", "2 AS __n")
    said = lambda df: sorted((r.doc_id or -1, len(r.text or "")) for r in df.collect())
    whole = said(odd)
    assert said(P.language_id(spark, odd, SMALL)) == [r for r in whole if r[1]]
    assert said(P.near_duplicates(spark, odd, SMALL)) == [(-1, 13), (1, 0), (2, 0), (3, 13), (4, 5), (4, 5), (5, len(long))]
    assert said(P.decontamination(spark, odd, SMALL)) == whole and said(P.secrets(spark, odd, SMALL)) == whole
    last = {(r.doc_id or -1, r.n_tokens) for r in P.token_ids(spark, odd, SMALL).collect()}
    assert len(last) >= 6 and {n for d, n in last if d in (1, 2)} == {0}
    for name, stage in P.STAGES:
        found = stage(spark, odd, SMALL)
        assert name == "token_ids" or found.columns == odd.columns, name
        assert stage(spark, odd.where("1 = 0"), SMALL).count() == 0, name


def test_run(spark):
    rows = P.run(spark, SMALL).collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows) and len({r.doc_id for r in rows}) == len(rows)
