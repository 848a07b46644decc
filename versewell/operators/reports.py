"""Reports, progress and badges over all learners: periods, streaks, moments, levels and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from versewell.functions import scoring as S
from versewell.operators import scoring as O
from versewell.plans import views as V

LEVELS = (3, 5, 10)  # qualifying days for badge levels 1, 2, 3
DEVICE = -1  # learner key of takes without a learner


def history(spark: SparkSession, d: str) -> DataFrame:
    """Assessments with learner, day and overall."""
    heads = V.assessments(spark, d)
    done = O.assessments(V.items(spark, d), heads.select("assessment", "kind"))
    return heads.drop("kind").join(done, "assessment").withColumn("learner", F.coalesce("learner", F.lit(DEVICE)))


def sloka_takes(spark: SparkSession, d: str) -> DataFrame:
    """One row per learner, sloka and assessment, with the item's overall (the best of repeated items)."""
    heads = V.assessments(spark, d).select("assessment", F.coalesce("learner", F.lit(DEVICE)).alias("learner"), "at", "day")
    items = O.with_overall(V.items(spark, d))
    best = items.groupBy("assessment", (F.col("sloka") % 50).alias("sloka")).agg(F.max("overall").alias("overall")).where("overall IS NOT NULL")
    return best.join(heads, "assessment")


def in_period(day: Column, period: str, around: str) -> Column:
    """Half-open range of the day, Monday week or month around a date."""
    at = F.lit(around).cast("date")
    if period == "all":
        return F.lit(True)
    start = F.trunc(at, period)if period != "day" else at
    end = {"day": F.date_add(start, 1), "week": F.date_add(start, 7), "month": F.add_months(start, 1)}[period]
    return (day >= start) & (day < end)


def shift_period(day: Column, period: str, n: int) -> Column:
    """The same period n periods on: a month shift lands on the first, a week shift keeps the weekday."""
    return {"day": F.date_add(day, n), "week": F.date_add(day, 7 * n), "month": F.add_months(F.trunc(day, "month"), n)}[period]


def streaks(days: DataFrame, key: str, day: str = "day") -> DataFrame:
    """Runs of consecutive days per key: gaps and islands over distinct days."""
    d = days.select(key, day).distinct()
    n = F.row_number().over(W.partitionBy(key).orderBy(day))
    return d.withColumn("island", F.date_sub(F.col(day), n)).groupBy(key, "island").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("days")).drop("island")


def week_streaks(days: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Runs of consecutive Monday weeks with at least ``least`` practice days."""
    weeks = days.select(key, "day").distinct().groupBy(key, F.trunc("day", "week").alias("week")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    n = F.row_number().over(W.partitionBy(key).orderBy("week"))
    island = F.date_sub(F.col("week"), n * 7)
    return weeks.withColumn("island", island).groupBy(key, "island").agg(F.min("week").alias("first_week"), F.count("*").alias("weeks")).drop("island")


def best_before(takes: DataFrame) -> DataFrame:
    """Takes so far, best before, first and last take of each learner and sloka."""
    w = W.partitionBy("learner", "sloka").orderBy("at", "assessment")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    return takes.select(
        "learner", "sloka", "assessment", "overall", F.row_number().over(w).alias("takes"), F.max("overall").over(before).alias("best"),
        F.first("overall").over(before).alias("first_overall"), F.lag("overall").over(w).alias("last_overall"),
    )


def moments(takes: DataFrame) -> DataFrame:
    """Moments of every take of a sloka, ranked; the two most notable of each assessment, or a plateau alone."""
    w = W.partitionBy("learner", "sloka").orderBy("at", "assessment")
    before, grade = w.rowsBetween(W.unboundedPreceding, -1), S.grade_of(F.col("overall"))
    rank = lambda g: F.when(g == "practice", 0).when(g == "fair", 1).when(g == "good", 2).otherwise(3)
    today = W.partitionBy("learner", "sloka", "day").orderBy("at", "assessment")
    t = takes.withColumn("grade", grade).select(
        "*", F.row_number().over(w).alias("n"), F.max("overall").over(before).alias("best"), F.max(F.when(F.col("grade") == "excellent", 1)).over(before).alias("had"),
        (F.max("overall").over(w.rowsBetween(-2, 0)) - F.max("overall").over(w.rowsBetween(-5, -3))).alias("up"), F.first("grade").over(before).alias("first_grade"),
        F.row_number().over(today).alias("today"), F.max("overall").over(today).alias("today_best"), F.lag("day").over(w).alias("last_day"),
    )
    said = {
        ("firstExcellent", 1): (F.col("grade") == "excellent") & F.col("had").isNull(),
        ("newBest", 2): F.col("overall") > F.col("best"),
        ("climbing", 3): (F.col("n") >= 4) & (F.col("up") >= 5),
        ("longClimb", 4): (F.col("n") >= 5) & (rank(F.col("grade")) > rank(F.col("first_grade"))),
        ("persistence", 5): (F.col("today") >= 3) & (F.col("overall") >= F.col("today_best")),
        ("welcomeBack", 7): F.datediff("day", "last_day") >= 14,
        ("plateau", 9): (F.col("n") >= 5) & (F.col("up") < 5) & F.col("grade").isin("practice", "fair"),
    }
    each = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(r).alias("rank"), F.lit(k).alias("kind"))) for (k, r), c in said.items()])
    rows = t.select("learner", "assessment", "sloka", F.inline(F.filter(each, lambda x: x.isNotNull())))
    top = W.partitionBy("learner", "assessment").orderBy("rank", "sloka")
    whole = W.partitionBy("learner", "assessment")
    rows = rows.withColumn("n", F.row_number().over(top)).withColumn("least", F.min("rank").over(whole)).withColumn("worst", F.max("rank").over(whole))
    alone = (F.col("worst") == 9) & (F.col("least") > 4)
    plateaus = F.row_number().over(W.partitionBy("learner", "assessment", "kind").orderBy("sloka"))
    shown = rows.withColumn("p", plateaus).where(F.when(alone, (F.col("kind") == "plateau") & (F.col("p") == 1)).otherwise((F.col("n") <= 2) & (F.col("kind") != "plateau")))
    return shown.select("learner", "assessment", "sloka", "kind", "rank")


def clean_attempts(items: DataFrame) -> DataFrame:
    """Assessments of which every item was compared, recited and without a slip."""
    fine = F.col("matched") & ~F.col("missing") & (F.size("slips") == 0)
    return items.groupBy("assessment").agg(F.bool_and(F.coalesce(fine, F.lit(False))).alias("clean")).where("clean").select("assessment")


def qualified(history_: DataFrame, least: int = 90, clean: DataFrame | None = None) -> DataFrame:
    """Quiz attempts good enough for a badge: an overall of ``least``, and among ``clean`` where that is given."""
    ok = history_.where((F.col("kind") == "quiz") & (F.col("overall") >= least))
    return ok if clean is None else ok.join(clean, "assessment", "left_semi")


def qualifying(history_: DataFrame, least: int = 90, clean: DataFrame | None = None) -> DataFrame:
    """Attempts that count for a badge: qualified, one per learner, quiz and day, numbered."""
    ok = qualified(history_, least, clean)
    first = F.row_number().over(W.partitionBy("learner", "quiz", "day").orderBy("at", "assessment"))
    per_day = ok.withColumn("one", first).where("one = 1")
    return per_day.withColumn("n", F.row_number().over(W.partitionBy("learner", "quiz").orderBy("day")))


def badge_levels(counting: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Badge of every learner and quiz that reached level 1: level, and the day of each level."""
    at = [F.max(F.when(F.col("n") == n, F.col("day"))).alias(f"level{k}_at") for k, n in enumerate(levels, 1)]
    b = counting.groupBy("learner", "quiz").agg(F.max("n").alias("days"), *at).where(F.col("days") >= levels[0])
    level = sum((F.when(F.col("days") >= n, 1).otherwise(0) for n in levels), F.lit(0))
    return b.select("learner", "quiz", level.alias("level"), *[f"level{k}_at" for k in range(1, len(levels) + 1)])


def diff_badges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Badges earned now, or raised from an earlier level."""
    was = old.select("learner", "quiz", F.col("level").alias("was"))
    j = new.join(was, ["learner", "quiz"], "left").where("was IS NULL OR level > was")
    return j.select("learner", "quiz", "level", F.when(F.col("was").isNull(), "earned").otherwise("raised").alias("change"), F.col("was").alias("from_level"))


def merge_badges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new badges as one table: never lowered or taken away, the first day kept."""
    a = old.select("learner", "quiz", F.col("level").alias("l0"), F.col("level1_at").alias("e0"))
    b = new.select("learner", "quiz", F.col("level").alias("l1"), F.col("level1_at").alias("e1"))
    return a.join(b, ["learner", "quiz"], "full").select("learner", "quiz", F.greatest("l0", "l1").alias("level"), F.coalesce("e0", "e1").alias("earned_at"))


CUT = "1998-01-01"
LEAST_STAND_IN = 60  # the stand-in scores seldom reach 90


def _badges(spark, d, until: str | None = None) -> DataFrame:
    h = history(spark, d).withColumn("quiz", F.col("quiz") % 3)
    return badge_levels(qualifying(h.where(F.col("day") < until) if until else h, LEAST_STAND_IN))


def q_summary(spark: SparkSession, d: str) -> DataFrame:
    """Assessments, quizzes, mean, best and distinct slokas per learner."""
    h = history(spark, d)
    slokas = V.items(spark, d).where(~F.col("missing")).select("assessment", "sloka")
    heads = h.groupBy("learner").agg(
        F.count("*").alias("assessments"), F.count_if(F.col("kind") == "quiz").alias("quizzes"), F.count_if(F.col("kind") != "quiz").alias("evaluations"),
        S.half_up(F.avg("overall")).cast("long").alias("mean"), F.max("overall").alias("best"),
    )
    seen = h.select("assessment", "learner").join(slokas, "assessment").groupBy("learner").agg(F.count_distinct("sloka").alias("slokas"))
    return heads.join(seen, "learner", "left").withColumn("slokas", F.coalesce("slokas", F.lit(0)))


def q_quiz_summary(spark: SparkSession, d: str) -> DataFrame:
    h = history(spark, d).where("kind = 'quiz'")
    last = F.max_by(F.struct("overall", "grade"), F.struct("at", "assessment"))
    return h.groupBy("quiz").agg(F.count("*").alias("attempts"), last.alias("l"), F.max("overall").alias("best")).select("quiz", "attempts", F.col("l.overall").alias("last_overall"), F.col("l.grade").alias("last_grade"), "best")


def q_quiz_trend(spark: SparkSession, d: str) -> DataFrame:
    """Series of every quiz attempt in long form: overall and each quiz category's mean."""
    means = O.q_attempt_summary(spark, d).select("assessment", *S.QUIZ_CATEGORIES)
    h = history(spark, d).where("kind = 'quiz'")
    n = F.row_number().over(W.partitionBy("quiz", "learner").orderBy("at", "assessment"))
    wide = h.withColumn("attempt", n).select("quiz", "learner", "attempt", "assessment", "overall").join(means, "assessment")
    return wide.unpivot(["quiz", "learner", "attempt"], ["overall", *S.QUIZ_CATEGORIES], "series", "value")


def q_period(spark: SparkSession, d: str) -> DataFrame:
    a = V.assessments(spark, d)
    parts = [a.where(in_period(F.col("day"), p, "1997-06-18")).select(F.lit(p).alias("period"), "assessment", "learner") for p in ("day", "week", "month")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_shift(spark: SparkSession, d: str) -> DataFrame:
    a = V.assessments(spark, d)
    return a.select("assessment", *[shift_period(F.col("day"), p, n).alias(f"{p}_{'next' if n > 0 else 'last'}") for p in ("day", "week", "month") for n in (1, -1)])


def q_day_streak(spark: SparkSession, d: str) -> DataFrame:
    days = V.assessments(spark, d).select((F.col("learner") % 40).alias("learner"), "day").where("learner IS NOT NULL")
    return streaks(days, "learner")


def q_week_streak(spark: SparkSession, d: str) -> DataFrame:
    days = V.assessments(spark, d).select((F.col("learner") % 10).alias("learner"), "day").where("learner IS NOT NULL")
    return week_streaks(days, "learner")


def q_best_before(spark: SparkSession, d: str) -> DataFrame:
    return best_before(sloka_takes(spark, d))


def q_moments(spark: SparkSession, d: str) -> DataFrame:
    return moments(sloka_takes(spark, d))


def q_badges(spark: SparkSession, d: str) -> DataFrame:
    return _badges(spark, d)


def q_diff_badges(spark: SparkSession, d: str) -> DataFrame:
    return diff_badges(_badges(spark, d, CUT), _badges(spark, d))


def q_merge_badges(spark: SparkSession, d: str) -> DataFrame:
    return merge_badges(_badges(spark, d, CUT), _badges(spark, d))


def q_division(spark: SparkSession, d: str) -> DataFrame:
    """Learners whose badged quizzes cover every verse group of a chapter: relational division by counting."""
    badged = _badges(spark, d).select("learner", "quiz").distinct()
    parts = V.slokas(spark, d).select((F.col("chapter") % 6).alias("chapter"), (F.col("verse") % 4).alias("verse"), (F.col("sloka") % 3).alias("quiz")).distinct()
    need = parts.select("chapter", "verse").distinct().groupBy("chapter").agg(F.count("*").alias("need"))
    have = badged.join(parts, "quiz").select("learner", "chapter", "verse").distinct().groupBy("learner", "chapter").agg(F.count("*").alias("have"))
    return have.join(need, "chapter").where("have = need").select("learner", "chapter", F.col("need").alias("verses"))


def q_union(spark: SparkSession, d: str) -> DataFrame:
    """Quiz attempts and sessions in one shape, keyed as in reports."""
    h = history(spark, d)
    quiz = h.where("kind = 'quiz'")
    n = F.row_number().over(W.partitionBy("quiz").orderBy("at", "assessment"))
    quiz = quiz.select(F.concat_ws(":", F.lit("quiz"), "quiz", n).alias("key"), "kind", F.col("quiz").alias("quiz_id"), "day", "overall")
    session = h.where("kind <> 'quiz'").select(F.concat_ws(":", F.lit("session"), "assessment").alias("key"), "kind", F.col("assessment").alias("session_id"), "day", "overall")
    return quiz.unionByName(session, allowMissingColumns=True)


def q_newest(spark: SparkSession, d: str) -> DataFrame:
    """Assessments newest first, with their place inside the month (the order is per month, so it stays distributed)."""
    place = F.row_number().over(W.partitionBy(F.trunc("day", "month")).orderBy(F.desc("at"), "assessment"))
    return V.assessments(spark, d).select("assessment", F.trunc("day", "month").alias("month"), place.alias("place"))


def q_grouped(spark: SparkSession, d: str) -> DataFrame:
    """Folder view: items with the count and best overall of their sloka as heading."""
    i = O.with_overall(V.items(spark, d)).join(V.slokas(spark, d).select("sloka", "folder"), "sloka")
    w = W.partitionBy("folder", "sloka")
    return i.select("folder", "sloka", "assessment", "item", "overall", F.count("*").over(w).alias("takes"), F.max("overall").over(w).alias("best"))


def q_folder_counts(spark: SparkSession, d: str) -> DataFrame:
    """Recordings per folder, empty folders kept."""
    n, c = V.table(spark, d, "nation"), V.table(spark, d, "customer")
    return n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("recordings"))


def q_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Verses in all and recorded: per dataset, per chapter, per folder."""
    verses = V.slokas(spark, d)
    recorded = V.items(spark, d).where("matched AND NOT missing AND phoneme >= 90").select("sloka").distinct().withColumn("recorded", F.lit(1))
    j = verses.join(recorded, "sloka", "left")
    return j.groupingSets([[], [F.col("chapter")], [F.col("folder")]], F.col("chapter"), F.col("folder")).agg(F.count("*").alias("verses"), F.coalesce(F.sum("recorded"), F.lit(0)).alias("recorded")).select("chapter", "folder", "verses", "recorded")


def q_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """25 slokas, round robin over folders in a seeded order."""
    p = V.slokas(spark, d).withColumn("h", F.md5(F.concat(F.lit("7:"), F.col("sloka").cast("string")).cast("binary")))
    n = F.row_number().over(W.partitionBy("folder").orderBy("h"))
    return p.withColumn("round", n).orderBy("round", F.md5(F.col("folder").cast("binary"))).limit(25).select("sloka", "folder", "round")


def q_verse_order(spark: SparkSession, d: str) -> DataFrame:
    """Place of every sloka in verse order inside its chapter."""
    w = W.partitionBy("chapter").orderBy("verse", "sloka")
    return V.slokas(spark, d).select("sloka", "chapter", "verse", F.row_number().over(w).alias("place"))


V.SQL["v_history"] = "SELECT assessment, coalesce(learner, -1) AS learner, \"at\", day, quiz, v_overall.kind, recited, counted, overall, grade FROM v_overall JOIN (SELECT * EXCLUDE (kind) FROM v_assessments) USING (assessment)"
V.SQL["v_takes"] = """SELECT assessment, sloka, overall, learner, "at", day FROM (SELECT assessment, sloka % 50 AS sloka, max(overall) AS overall FROM v_scored WHERE overall IS NOT NULL GROUP BY 1, 2)
  JOIN (SELECT assessment, coalesce(learner, -1) AS learner, "at", day FROM v_assessments) USING (assessment)"""
_H = ("v_items", "v_scored", "v_assessments", "v_overall", "v_history")
_T = ("v_items", "v_scored", "v_assessments", "v_takes")
_G = O._GRADE.format("overall", "false")


def _badge_sql(name: str, where: str) -> str:
    return f"""{name}_n AS (SELECT learner, quiz, day, row_number() OVER (PARTITION BY learner, quiz ORDER BY day) AS n FROM (SELECT DISTINCT learner, quiz % 3 AS quiz, day FROM v_history WHERE kind = 'quiz' AND overall >= 60 AND {where})),
{name} AS (SELECT learner, quiz, ((max(n) >= 3)::INT + (max(n) >= 5)::INT + (max(n) >= 10)::INT) AS level, max(CASE WHEN n = 3 THEN day END) AS level1_at, max(CASE WHEN n = 5 THEN day END) AS level2_at, max(CASE WHEN n = 10 THEN day END) AS level3_at
FROM {name}_n GROUP BY ALL HAVING max(n) >= 3)"""


_NEW, _BEFORE = _badge_sql("now", "true"), _badge_sql("earlier", f"day < DATE '{CUT}'")

QUERIES = {
    "agg_report_summary": q_summary, "agg_quiz_summary": q_quiz_summary, "agg_quiz_trend": q_quiz_trend, "filter_period": q_period, "shift_period": q_shift,
    "win_day_streak": q_day_streak, "win_week_streak": q_week_streak, "win_best_before": q_best_before, "win_moments": q_moments, "win_badge_levels": q_badges,
    "diff_badges": q_diff_badges, "merge_badges": q_merge_badges, "agg_badge_verse_division": q_division, "union_assessments": q_union, "sort_newest_first": q_newest,
    "sort_grouped_by_sloka": q_grouped, "agg_folder_counts": q_folder_counts, "agg_coverage_grouping_sets": q_coverage, "sample_round_robin": q_round_robin, "sort_verse_order": q_verse_order,
}
ORACLE = {
    "agg_report_summary": V.sql(
        """SELECT learner, count(*) AS assessments, count(*) FILTER (kind = 'quiz') AS quizzes, count(*) FILTER (kind <> 'quiz') AS evaluations, floor(avg(overall) + 0.5)::BIGINT AS mean, max(overall) AS best,
  coalesce(any_value(slokas), 0) AS slokas FROM v_history LEFT JOIN (SELECT coalesce(learner, -1) AS learner, count(DISTINCT sloka) AS slokas FROM v_items JOIN v_assessments USING (assessment) WHERE NOT missing GROUP BY 1) USING (learner) GROUP BY learner""", *_H),
    "agg_quiz_summary": V.sql(
        """SELECT quiz, count(*) AS attempts, arg_max(overall, ("at", assessment)) AS last_overall, arg_max(grade, ("at", assessment)) AS last_grade, max(overall) AS best FROM (SELECT * REPLACE (coalesce(overall, NULL) AS overall) FROM v_history) WHERE kind = 'quiz' GROUP BY quiz""", *_H),
    "agg_quiz_trend": V.sql(
        f""",, m AS (SELECT assessment, {', '.join(f"floor(avg(CASE WHEN NOT missing THEN {c} END) + 0.5)::BIGINT AS {c}" for c in S.QUIZ_CATEGORIES)} FROM v_scored GROUP BY assessment),
x AS (SELECT quiz, learner, row_number() OVER (PARTITION BY quiz, learner ORDER BY "at", assessment) AS attempt, overall, phoneme, vowel, syllable FROM v_history JOIN m USING (assessment) WHERE kind = 'quiz')
{' UNION ALL '.join(f"SELECT quiz, learner, attempt, '{c}' AS series, {c} AS value FROM x" for c in ('overall', *S.QUIZ_CATEGORIES))}""", *_H),
    "filter_period": V.sql(
        """SELECT period, assessment, learner FROM v_assessments, (VALUES ('day', DATE '1997-06-18', DATE '1997-06-19'), ('week', DATE '1997-06-16', DATE '1997-06-23'), ('month', DATE '1997-06-01', DATE '1997-07-01')) p(period, lo, hi) WHERE day >= lo AND day < hi""", "v_assessments"),
    "shift_period": V.sql(
        """SELECT assessment, (day + 1)::DATE AS day_next, (day - 1)::DATE AS day_last, (day + 7)::DATE AS week_next, (day - 7)::DATE AS week_last, (date_trunc('month', day) + INTERVAL 1 MONTH)::DATE AS month_next, (date_trunc('month', day) - INTERVAL 1 MONTH)::DATE AS month_last FROM v_assessments""", "v_assessments"),
    "win_day_streak": V.sql(
        """SELECT learner, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM (SELECT learner, day, day - row_number() OVER (PARTITION BY learner ORDER BY day)::INT AS island FROM (SELECT DISTINCT learner % 40 AS learner, day FROM v_assessments WHERE learner IS NOT NULL)) GROUP BY learner, island""", "v_assessments"),
    "win_week_streak": V.sql(
        """SELECT learner, min(week) AS first_week, count(*) AS weeks FROM (SELECT learner, week, week - 7 * row_number() OVER (PARTITION BY learner ORDER BY week)::INT AS island FROM (
  SELECT learner, date_trunc('week', day)::DATE AS week FROM (SELECT DISTINCT learner % 10 AS learner, day FROM v_assessments WHERE learner IS NOT NULL) GROUP BY ALL HAVING count(*) >= 3)) GROUP BY learner, island""", "v_assessments"),
    "win_best_before": V.sql(
        """SELECT learner, sloka, assessment, overall, row_number() OVER w AS takes, max(overall) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, first_value(overall) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS first_overall, lag(overall) OVER w AS last_overall
FROM v_takes WINDOW w AS (PARTITION BY learner, sloka ORDER BY "at", assessment)""", *_T),
    "win_moments": V.sql(
        f""",, g AS (SELECT *, {_G} AS grade FROM v_takes),
t AS (SELECT *, row_number() OVER w AS n, max(overall) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, max(CASE WHEN grade = 'excellent' THEN 1 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had,
  max(overall) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) - max(overall) OVER (w ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS up, first_value(grade) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fg,
  row_number() OVER (PARTITION BY learner, sloka, day ORDER BY "at", assessment) AS today, max(overall) OVER (PARTITION BY learner, sloka, day ORDER BY "at", assessment ROWS UNBOUNDED PRECEDING) AS tb, lag(day) OVER w AS ld
  FROM g WINDOW w AS (PARTITION BY learner, sloka ORDER BY "at", assessment)),
r AS (SELECT *, list_position(['practice', 'fair', 'good', 'excellent'], grade) AS gr, list_position(['practice', 'fair', 'good', 'excellent'], fg) AS fr FROM t),
k AS (SELECT learner, assessment, sloka, 'firstExcellent' AS kind, 1 AS rank FROM r WHERE grade = 'excellent' AND had IS NULL UNION ALL SELECT learner, assessment, sloka, 'newBest', 2 FROM r WHERE overall > best
 UNION ALL SELECT learner, assessment, sloka, 'climbing', 3 FROM r WHERE n >= 4 AND up >= 5 UNION ALL SELECT learner, assessment, sloka, 'longClimb', 4 FROM r WHERE n >= 5 AND gr > fr
 UNION ALL SELECT learner, assessment, sloka, 'persistence', 5 FROM r WHERE today >= 3 AND overall >= tb UNION ALL SELECT learner, assessment, sloka, 'welcomeBack', 7 FROM r WHERE day - ld >= 14
 UNION ALL SELECT learner, assessment, sloka, 'plateau', 9 FROM r WHERE n >= 5 AND up < 5 AND grade IN ('practice', 'fair')),
z AS (SELECT *, row_number() OVER (PARTITION BY learner, assessment ORDER BY rank, sloka) AS n, min(rank) OVER (PARTITION BY learner, assessment) AS lo, max(rank) OVER (PARTITION BY learner, assessment) AS hi, row_number() OVER (PARTITION BY learner, assessment, kind ORDER BY sloka) AS p FROM k)
SELECT learner, assessment, sloka, kind, rank FROM z WHERE CASE WHEN hi = 9 AND lo > 4 THEN kind = 'plateau' AND p = 1 ELSE n <= 2 AND kind <> 'plateau' END""", *_T),
    "win_badge_levels": V.sql(f",, {_NEW} SELECT * FROM now", *_H),
    "diff_badges": V.sql(f",, {_NEW}, {_BEFORE} SELECT learner, quiz, n.level, CASE WHEN e.level IS NULL THEN 'earned' ELSE 'raised' END AS change, e.level AS from_level FROM now n LEFT JOIN earlier e USING (learner, quiz) WHERE e.level IS NULL OR n.level > e.level", *_H),
    "merge_badges": V.sql(f",, {_NEW}, {_BEFORE} SELECT learner, quiz, greatest(n.level, e.level) AS level, coalesce(e.level1_at, n.level1_at) AS earned_at FROM now n FULL JOIN earlier e USING (learner, quiz)", *_H),
    "agg_badge_verse_division": V.sql(
        f""",, {_NEW}, p AS (SELECT DISTINCT chapter % 6 AS chapter, verse % 4 AS verse, sloka % 3 AS quiz FROM v_slokas), need AS (SELECT chapter, count(DISTINCT verse) AS verses FROM p GROUP BY chapter)
SELECT learner, chapter, any_value(verses) AS verses FROM now JOIN p USING (quiz) JOIN need USING (chapter) GROUP BY learner, chapter HAVING count(DISTINCT verse) = any_value(verses)""", *_H, "v_slokas"),
    "union_assessments": V.sql(
        """SELECT 'quiz:' || quiz || ':' || row_number() OVER (PARTITION BY quiz ORDER BY "at", assessment) AS key, kind, quiz AS quiz_id, day, overall, NULL::BIGINT AS session_id FROM v_history WHERE kind = 'quiz'
UNION ALL SELECT 'session:' || assessment, kind, NULL, day, overall, assessment FROM v_history WHERE kind <> 'quiz'""", *_H),
    "sort_newest_first": V.sql("""SELECT assessment, date_trunc('month', day)::DATE AS month, row_number() OVER (PARTITION BY date_trunc('month', day) ORDER BY "at" DESC, assessment) AS place FROM v_assessments""", "v_assessments"),
    "sort_grouped_by_sloka": V.sql("SELECT folder, sloka, assessment, item, overall, count(*) OVER (PARTITION BY folder, sloka) AS takes, max(overall) OVER (PARTITION BY folder, sloka) AS best FROM v_scored JOIN (SELECT sloka, folder FROM v_slokas) USING (sloka)", "v_items", "v_scored", "v_slokas"),
    "agg_folder_counts": "SELECT n_name, count(c_custkey) AS recordings FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name",
    "agg_coverage_grouping_sets": V.sql("SELECT chapter, folder, count(*) AS verses, count(r.sloka) AS recorded FROM v_slokas v LEFT JOIN (SELECT DISTINCT sloka FROM v_items WHERE matched AND NOT missing AND phoneme >= 90) r USING (sloka) GROUP BY GROUPING SETS ((), (chapter), (folder))", "v_items", "v_slokas"),
    "sample_round_robin": V.sql("SELECT sloka, folder, round FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY md5('7:' || sloka)) AS round FROM v_slokas) ORDER BY round, md5(folder) LIMIT 25", "v_slokas"),
    "sort_verse_order": V.sql("SELECT sloka, chapter, verse, row_number() OVER (PARTITION BY chapter ORDER BY verse, sloka) AS place FROM v_slokas", "v_slokas"),
}
