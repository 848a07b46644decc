"""Values that the scoring and text functions must give, and properties of the alignment helper."""

import random

import pytest
from pyspark.sql import functions as F

from versewell.functions import scoring as S
from versewell.operators import frames, linking, reports, texts

CATS = "phoneme int, vowel int, syllable int, emphasis int, pitch int, phrasing int, timing int, content int, pronunciation int, dynamics int"
SCHEMA = CATS + ", missing boolean, slips array<struct<kind:string,unsure:boolean>>"


def overall(spark, slips=(), **scores):
    names = [c.split()[0] for c in CATS.split(", ")]
    row = (*[scores.get(n) for n in names], False, list(slips))
    return spark.createDataFrame([row], SCHEMA).select(S.item_overall().alias("o")).first().o


def test_item_overall(spark):
    assert overall(spark, phoneme=100, vowel=100, syllable=100) == 100
    assert overall(spark, content=95, pronunciation=90) == 93  # an old record adds up on its own weights
    assert overall(spark) is None
    perfect = dict(phoneme=92, vowel=92, syllable=92)
    assert overall(spark, [("restart", False)], **perfect) == 78
    assert overall(spark, [("restart", True)], **perfect) == 92  # an unsure slip costs nothing
    assert overall(spark, [("restart", False), ("repeat", False)], **perfect) == 78  # once


@pytest.mark.parametrize(("score", "grade"), [(90, "excellent"), (89, "good"), (80, "good"), (65, "fair"), (64, "practice"), (0, "practice"), (None, None)])
def test_grades(spark, score, grade):
    df = spark.createDataFrame([(score,)], "s int").select(S.grade_of(F.col("s")).alias("g"))
    assert df.first().g == grade


def test_normalized(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-5.0,), (49.5,), (400.0,)], "v double")
    assert [r[0] for r in df.select(S.normalized(F.col("v"), 30)).collect()] == [30, 30, 30, 0, 50, 100]


def test_shift_period(spark):
    day = F.lit("2026-01-31").cast("date")
    row = spark.range(1).select(reports.shift_period(day, "month", 1).alias("m"), reports.shift_period(F.lit("2026-10-08").cast("date"), "week", -1).alias("w")).first()
    assert (str(row.m), str(row.w)) == ("2026-02-01", "2026-10-01")


def test_runs_fill_gaps(spark):
    df = spark.createDataFrame([(1, i) for i in (0, 1, 3, 4, 8, 9, 20)], "k int, idx int")
    got = {tuple(r)[1:] for r in frames.runs(df, "k", "idx", gap=1, least=2).collect()}
    assert got == {(0, 4), (8, 9)}


def test_diff_prefers_deletion_and_is_symmetric_in_length():
    assert texts.lcs_ops(["a"], ["b"]) == [("delete", 0, -1), ("insert", -1, 0)]
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
        equal = [(i, j) for op, i, j in texts.lcs_ops(a, b) if op == "equal"]
        assert len(equal) == best[-1][-1] == sum(op == "equal" for op, _, _ in texts.lcs_ops(b, a))
        assert all(a[i] == b[j] for i, j in equal)


def test_diff_of_long_texts_in_halves(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(texts, "MAX_BITS", 20)
    for _ in range(100):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 20))] for _ in range(2))
        halves = texts.lcs_ops(a, b)
        monkeypatch.setattr(texts, "MAX_BITS", 1 << 31)
        whole = texts.lcs_ops(a, b)
        monkeypatch.setattr(texts, "MAX_BITS", 20)
        assert sum(op == "equal" for op, *_ in halves) == sum(op == "equal" for op, *_ in whole)
        assert [i for _, i, _ in halves if i >= 0] == list(range(len(a))) and [j for _, _, j in halves if j >= 0] == list(range(len(b)))


def test_compare_words(spark):
    rows = [(["dharma", "kshetre"], ["dharmakshetre"]), (["a", "b"], ["c"]), ([], ["x"]), (["one", "two"], []), (["ab" * 900], ["ab" * 900])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = [tuple(r.heard) for r in texts.compare_words(df, "a", "b").collect()]
    assert got == [(2, 0, 0, 1.0), (0, 2, 1, 0.0), (0, 0, 1, 0.0), (0, 2, 0, 0.0), (1, 0, 0, 1.0)]


def test_degenerate(spark):
    cases = {"": True, None: True, "123 456": True, "la la la la la la la": True, "a fine line of ordinary words": False, "no " * 20: True}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.d for r in df.select("t", texts.is_degenerate(F.col("t")).alias("d")).collect()} == cases


def test_metre_forms(spark):
    padas = "GGGGLGGG" + "GGGGLGLG"
    df = spark.createDataFrame([(padas * 2,), ("L" * 31,), ("",)], "w string")
    got = [tuple(r) for r in df.select(*texts.metre(F.col("w"))).collect()]
    assert got == [("anushtubh", True, "pathyā"), ("anushtubh", False, None), (None, False, None)]


def test_presets_of_pairs(spark):
    # fixed values: voice and age of the learner and of the reference, and what is allowed
    rows = [(None, None, None, None), ("female", "18to39", "male", "40to59"), ("male", "18to39", "male", "40to59"), ("child", "under8", "male", "40to59"), ("child", "8to11", None, None), ("female", "60plus", "female", "18to39"),
            ("male", "12to15", "male", "18to39"), ("preferNotToSay", None, "male", None), ("male", None, "male", "8to11"), ("male", "16to17", "male", "40to59")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, v string, a string, rv string, ra string")
    got = {r.k: tuple(r)[1:] for r in df.select("k", *[c.alias(n) for n, c in linking.presets(*map(F.col, ("v", "a", "rv", "ra"))).items()]).collect()}
    adult = (0.5, 0.75, 1.33, 1.1, 10)
    assert got == {0: (*adult, 0.74, 1.35), 1: (*adult, 0.8, 1.25), 2: (*adult, 0.86, 1.16), 3: (1.0, 0.67, 1.5, 1.3, 30, 0.67, 1.5), 4: (0.75, 0.67, 1.5, 1.2, 20, 0.67, 1.5), 5: (0.5, 0.67, 1.33, 1.1, 10, 0.86, 1.16),
                   6: (0.6, 0.75, 1.33, 1.1, 15, 0.8, 1.25), 7: (*adult, 0.74, 1.35), 8: (*adult, 0.67, 1.5), 9: (*adult, 0.8, 1.25)}
