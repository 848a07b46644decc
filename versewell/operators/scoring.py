"""Scores of items, attempts and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versewell.functions import scoring as S
from versewell.plans import views as V

CATEGORIES = tuple(S.WEIGHTS)


def with_overall(items: DataFrame) -> DataFrame:
    """Items with ``overall`` and ``grade``: null for missing ones, practice for any slip."""
    items = items.withColumn("overall", F.when(~F.col("missing"), S.item_overall()))
    return items.withColumn("grade", S.grade_with_slips(F.col("overall"), F.size("slips") > 0))


def attempt_overall(items: DataFrame, kinds: DataFrame) -> DataFrame:
    """Mean of item overalls: in a quiz an item that was not recited counts 0, in a session it is left out."""
    scored = with_overall(items).join(kinds, "assessment")
    value = F.when(F.col("missing"), F.lit(None)).when(F.col("kind") == "quiz", F.when(F.col("matched"), F.col("overall")).otherwise(0)).when(F.col("matched"), F.col("overall"))
    return scored.groupBy("assessment", "kind").agg(
        S.half_up(F.avg(value)).cast("long").alias("mean_overall"), F.count_if("matched").alias("recited"), F.count_if(~F.col("missing")).alias("counted"),
        F.bool_or(F.size("slips") > 0).alias("any_slip"), F.bool_or((F.size("slips") > 0) & F.col("matched")).alias("recited_slip"),
        F.bool_or(F.exists("slips", lambda s: s["kind"].isin("partial", "skipped") & ~s["unsure"])).alias("partial"),
    )


def assessments(items: DataFrame, kinds: DataFrame) -> DataFrame:
    """Overall and grade of every assessment that has items, in one shape for quizzes and sessions."""
    a = attempt_overall(items, kinds)
    quiz = F.col("kind") == "quiz"
    overall = F.when(quiz, F.col("mean_overall")).when(F.col("recited") > 0, F.col("mean_overall")).otherwise(0)
    slip = F.when(quiz, F.col("any_slip")).otherwise(F.col("recited_slip") | F.col("partial"))
    return a.select("assessment", "kind", "recited", "counted", overall.alias("overall"), S.grade_with_slips(overall, slip).alias("grade"))


def q_item_overall(spark: SparkSession, d: str) -> DataFrame:
    return with_overall(V.items(spark, d)).select("assessment", "item", "overall", "grade")


def q_attempt_overall(spark: SparkSession, d: str) -> DataFrame:
    kinds = V.assessments(spark, d).select("assessment", "kind")
    return assessments(V.items(spark, d), kinds)


def q_attempt_summary(spark: SparkSession, d: str) -> DataFrame:
    """Category means, counts and average of the quiz categories per assessment."""
    items = with_overall(V.items(spark, d))
    mean = lambda c: S.half_up(F.avg(F.when(~F.col("missing"), F.col(c)))).cast("long")
    a = items.groupBy("assessment").agg(
        *[mean(c).alias(c) for c in CATEGORIES], F.count_if(~F.col("missing")).alias("counted"), F.count_if("matched").alias("recited"),
        F.sum(F.size("slips")).alias("slips"), S.half_up(F.avg("overall")).cast("long").alias("overall"),
    )
    kept = F.filter(F.array(*S.QUIZ_CATEGORIES), lambda x: x.isNotNull())
    total = F.aggregate(kept, F.lit(0).cast("long"), lambda x, y: x + y)
    average = F.when(F.size(kept) > 0, S.half_up(total / F.size(kept)).cast("long"))
    return a.select("*", average.alias("average"), S.grade_with_slips(F.col("overall"), F.col("slips") > 0).alias("grade"))


def q_correctness(spark: SparkSession, d: str) -> DataFrame:
    """Share of items whose judged quiz categories all pass, per assessment."""
    ok = V.items(spark, d).withColumn("ok", S.verdict())
    a = ok.groupBy("assessment").agg(F.count_if(F.col("ok")).alias("correct"), F.count("ok").alias("counted"))
    return a.withColumn("pct", F.when(F.col("counted") > 0, S.half_up(100 * F.col("correct") / F.col("counted")).cast("long")))


def q_pass_rates(spark: SparkSession, d: str) -> DataFrame:
    """Pass rate of each category over all items: one pass, unpivoted afterwards."""
    items = V.items(spark, d).where(~F.col("missing"))
    judged = items.agg(*[x for c in CATEGORIES for x in (F.count(c).alias(f"n_{c}"), F.count_if(100 - F.col(c) <= S.TOLERANCE[c]).alias(f"ok_{c}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"ok_{c}").alias("ok"), F.col(f"n_{c}").alias("n")) for c in CATEGORIES])
    out = judged.select(F.inline(rows)).where("n > 0")
    return out.withColumn("pct", S.half_up(100 * F.col("ok") / F.col("n")).cast("long"))


def q_band_grade(spark: SparkSession, d: str) -> DataFrame:
    return V.items(spark, d).select("assessment", "item", "phoneme", S.grade_of(F.col("phoneme")).alias("grade"))


def q_scoring_config(spark: SparkSession, d: str) -> DataFrame:
    """Weights from three columns made sane, never all zero; null prices stand for absent ones."""
    line = V.table(spark, d, "lineitem")
    raw = {"phoneme": F.col("l_quantity") * 4 - 60, "vowel": F.when(F.col("l_returnflag") != "N", F.col("l_discount") * 1000), "syllable": F.col("l_tax") * 100 - 5}
    w = line.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[S.normalized(x, S.WEIGHTS[c]).alias(c) for c, x in raw.items()])
    zero = (F.col("phoneme") + F.col("vowel") + F.col("syllable")) == 0
    return w.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[F.when(zero, S.WEIGHTS[c]).otherwise(F.col(c)).cast("long").alias(c) for c in raw])


def q_clean_slips(spark: SparkSession, d: str) -> DataFrame:
    """Per take the first 40 well-formed slips, in order; view events are of no known kind."""
    e = V.intervals(spark, d)
    known = F.when(F.col("kind") == "purchase", "stall").when(F.col("kind") == "click", "restart").when(F.col("kind") == "error", "dropped")
    slip = F.struct("span", known.alias("kind"), (F.floor(F.col("t0") * 100 + 0.5) / 100).alias("at"), F.floor(F.col("value")).cast("long").alias("pada"))
    takes = e.groupBy("take").agg(F.sort_array(F.collect_list(slip)).alias("slips"))
    kept = F.slice(F.filter("slips", lambda s: s["kind"].isNotNull()), 1, 40)
    out = takes.select("take", F.inline(kept))
    return out.select("take", "span", "kind", "at", F.when(F.col("pada").between(0, 32), F.col("pada")).alias("pada"))


def q_match_gate(spark: SparkSession, d: str) -> DataFrame:
    """Same material by sound (contrast null or under 0.87), or by words (0.75 over at least four words)."""
    line = V.table(spark, d, "lineitem")
    contrast = F.when(F.col("l_returnflag") != "N", F.col("l_discount") * 10)
    sim, words = 1 - F.col("l_tax") * 5, F.col("l_linenumber")
    by_sound = contrast.isNull() | (contrast < 0.87)
    by_words = (words >= 4) & (sim >= 0.75)
    by = F.when(by_sound, "sound").when(by_words, "words")
    return line.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (by_sound | by_words).alias("ok"), by.alias("decided_by"))


def q_item_scores(spark: SparkSession, d: str) -> DataFrame:
    """Item scores from sound and word results: not recited is 0, not comparable missing, unjudged pitch null."""
    i = V.items(spark, d)
    score = lambda c: F.when(F.col("missing"), F.lit(None)).when(~F.col("matched"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.col(c))))
    return i.select("assessment", "item", "missing", F.when(F.col("missing"), False).otherwise(F.col("matched")).alias("matched"), *[score(c).cast("long").alias(c) for c in CATEGORIES])


def q_flagship(spark: SparkSession, d: str) -> DataFrame:
    """Overall, grade and correctness of every assessment."""
    done = q_attempt_overall(spark, d).select("assessment", "kind", "overall", "grade", "recited")
    return done.join(q_correctness(spark, d).select("assessment", "pct"), "assessment")


_OLD = "(phoneme IS NULL AND vowel IS NULL AND syllable IS NULL AND (content IS NOT NULL OR pronunciation IS NOT NULL OR dynamics IS NOT NULL))"


def _mean_sql(weights: dict[str, int]) -> str:
    total = " + ".join(f"coalesce({c}, 0) * {w}" for c, w in weights.items())
    weight = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w} ELSE 0 END" for c, w in weights.items())
    return f"CASE WHEN ({weight}) > 0 THEN floor(({total})::DOUBLE / ({weight}) + 0.5)::BIGINT END"


_GRADE = "CASE WHEN {0} IS NULL THEN NULL WHEN {1} THEN 'practice' WHEN {0} >= 90 THEN 'excellent' WHEN {0} >= 80 THEN 'good' WHEN {0} >= 65 THEN 'fair' ELSE 'practice' END"
_RAW = f"CASE WHEN {_OLD} THEN {_mean_sql(S.LEGACY_WEIGHTS)} ELSE {_mean_sql(S.WEIGHTS)} END"
_FIXED = "slip IN ('restart', 'falseStart', 'repeat') AND NOT unsure"
V.SQL["v_scored"] = f"""SELECT *, {_GRADE.format('overall', 'slip IS NOT NULL')} AS grade FROM (
  SELECT * EXCLUDE (raw), CASE WHEN missing THEN NULL WHEN {_FIXED} THEN floor(raw * (1 - 0.15::DOUBLE) + 0.5)::BIGINT ELSE raw END AS overall FROM (SELECT *, {_RAW} AS raw FROM v_items))"""
V.SQL["v_overall"] = f"""SELECT assessment, kind, recited, counted, overall, {_GRADE.format('overall', 'slipped')} AS grade FROM (
  SELECT assessment, kind, recited, counted, CASE WHEN kind = 'quiz' OR recited > 0 THEN mean_overall ELSE 0 END AS overall, CASE WHEN kind = 'quiz' THEN any_slip ELSE recited_slip OR part END AS slipped FROM (
    SELECT assessment, kind, count(*) FILTER (matched) AS recited, count(*) FILTER (NOT missing) AS counted, bool_or(slip IS NOT NULL) AS any_slip,
      bool_or(slip IS NOT NULL AND matched) AS recited_slip, bool_or(coalesce(slip IN ('partial', 'skipped') AND NOT unsure, false)) AS part,
      floor(avg(CASE WHEN missing THEN NULL WHEN kind = 'quiz' THEN CASE WHEN matched THEN overall ELSE 0 END WHEN matched THEN overall END) + 0.5)::BIGINT AS mean_overall
    FROM v_scored JOIN (SELECT assessment, kind FROM v_assessments) USING (assessment) GROUP BY assessment, kind))"""
_OK_OLD = " AND ".join(f"coalesce(100 - {c} <= {S.TOLERANCE[c]}, true)" for c in ("content", "pronunciation"))
_OK_NEW = " AND ".join(f"coalesce(100 - {c} <= {S.TOLERANCE[c]}, true)" for c in S.QUIZ_CATEGORIES)
V.SQL["v_correct"] = f"""SELECT assessment, count(*) FILTER (ok) AS correct, count(ok) AS counted, CASE WHEN count(ok) > 0 THEN floor(100.0::DOUBLE * count(*) FILTER (ok) / count(ok) + 0.5)::BIGINT END AS pct FROM (
  SELECT assessment, CASE WHEN missing THEN NULL WHEN {_OLD} THEN CASE WHEN content IS NOT NULL OR pronunciation IS NOT NULL THEN {_OK_OLD} END
    WHEN phoneme IS NOT NULL OR vowel IS NOT NULL OR syllable IS NOT NULL THEN {_OK_NEW} END AS ok FROM v_items) GROUP BY assessment"""
_LINE_ID = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
_N = "greatest(0, least(100, floor({} + 0.5)))::BIGINT"

QUERIES = {
    "agg_item_overall": q_item_overall,
    "agg_attempt_overall": q_attempt_overall,
    "agg_attempt_summary": q_attempt_summary,
    "agg_correctness": q_correctness,
    "agg_pass_rates": q_pass_rates,
    "band_grade_lookup": q_band_grade,
    "normalize_scoring_config": q_scoring_config,
    "clean_slips": q_clean_slips,
    "match_gate": q_match_gate,
    "item_scores": q_item_scores,
    "flagship_assessments": q_flagship,
}
ORACLE = {
    "agg_item_overall": V.sql("SELECT assessment, item, overall, grade FROM v_scored", "v_items", "v_scored"),
    "agg_attempt_overall": V.sql("SELECT * FROM v_overall", "v_items", "v_scored", "v_assessments", "v_overall"),
    "agg_attempt_summary": V.sql(
        f""",, m AS (SELECT assessment, {', '.join(f"floor(avg(CASE WHEN NOT missing THEN {c} END) + 0.5)::BIGINT AS {c}" for c in CATEGORIES)},
  count(*) FILTER (NOT missing) AS counted, count(*) FILTER (matched) AS recited, count(slip) AS slips, floor(avg(overall) + 0.5)::BIGINT AS overall FROM v_scored GROUP BY assessment)
SELECT *, floor(list_avg([phoneme, vowel, syllable]) + 0.5)::BIGINT AS average, {_GRADE.format('overall', 'slips > 0')} AS grade FROM m""", "v_items", "v_scored"),
    "agg_correctness": V.sql("SELECT * FROM v_correct", "v_items", "v_correct"),
    "agg_pass_rates": V.sql(
        " UNION ALL ".join(f"SELECT '{c}' AS category, count(*) FILTER (100 - {c} <= {S.TOLERANCE[c]}) AS ok, count({c}) AS n, floor(100.0::DOUBLE * count(*) FILTER (100 - {c} <= {S.TOLERANCE[c]}) / count({c}) + 0.5)::BIGINT AS pct FROM v_items WHERE NOT missing HAVING count({c}) > 0" for c in CATEGORIES),
        "v_items"),
    "band_grade_lookup": V.sql(f"SELECT assessment, item, phoneme, {_GRADE.format('phoneme', 'false')} AS grade FROM v_items", "v_items"),
    "normalize_scoring_config": f"""WITH w AS (SELECT {_LINE_ID}, {_N.format('l_quantity * 4 - 60')} AS phoneme, CASE WHEN l_returnflag <> 'N' THEN {_N.format('l_discount * 1000')} ELSE 25 END AS vowel,
  {_N.format('l_tax * 100 - 5')} AS syllable FROM lineitem)
SELECT {_LINE_ID}, CASE WHEN z THEN 30 ELSE phoneme END::BIGINT AS phoneme, CASE WHEN z THEN 25 ELSE vowel END::BIGINT AS vowel, CASE WHEN z THEN 15 ELSE syllable END::BIGINT AS syllable
FROM (SELECT *, phoneme + vowel + syllable = 0 AS z FROM w)""",
    "clean_slips": V.sql(
        """SELECT take, span, kind, "at", CASE WHEN pada BETWEEN 0 AND 32 THEN pada END AS pada FROM (
  SELECT take, span, CASE kind WHEN 'purchase' THEN 'stall' WHEN 'click' THEN 'restart' ELSE 'dropped' END AS kind, floor(t0 * 100 + 0.5) / 100 AS "at", floor(value)::BIGINT AS pada,
    row_number() OVER (PARTITION BY take ORDER BY span) AS n FROM v_intervals WHERE kind IN ('purchase', 'click', 'error')) WHERE n <= 40""", "v_intervals"),
    "match_gate": f"""WITH x AS (SELECT {_LINE_ID}, CASE WHEN l_returnflag <> 'N' THEN l_discount * 10 END AS contrast, 1 - l_tax * 5 AS sim, l_linenumber AS words FROM lineitem)
SELECT {_LINE_ID}, contrast IS NULL OR contrast < 0.87 OR (words >= 4 AND sim >= 0.75) AS ok, CASE WHEN contrast IS NULL OR contrast < 0.87 THEN 'sound' WHEN words >= 4 AND sim >= 0.75 THEN 'words' END AS decided_by FROM x""",
    "item_scores": V.sql(
        "SELECT assessment, item, missing, CASE WHEN missing THEN false ELSE matched END AS matched, "
        + ", ".join(f"CASE WHEN missing THEN NULL WHEN NOT matched THEN 0 ELSE greatest(0, least(100, {c})) END::BIGINT AS {c}" if c else "" for c in CATEGORIES) + " FROM v_items", "v_items"),
    "flagship_assessments": V.sql("SELECT assessment, kind, overall, grade, recited, pct FROM v_overall JOIN (SELECT assessment, pct FROM v_correct) USING (assessment)", "v_items", "v_scored", "v_assessments", "v_overall", "v_correct"),
}
