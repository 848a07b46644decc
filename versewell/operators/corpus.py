"""Reference corpus and recordings: stored documents, validation, mapping, plans, sound scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from versewell.operators import frames, texts
from versewell.plans import views as V
from versewell.sources import documents as D


def q_json_documents(spark: SparkSession, d: str) -> DataFrame:
    """Quizzes written as JSON documents (some cut short) and read back: attempts and best of each readable one."""
    o = V.table(spark, d, "orders")
    attempt = F.struct(F.col("o_orderkey").alias("no"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"), F.floor(F.col("o_totalprice") % 101).alias("overall"))
    quiz = o.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(attempt)).alias("attempts")).withColumn("name", F.concat(F.lit("quiz "), F.col("id")))
    text = F.to_json(F.struct("id", "name", "attempts"))
    path = D.scratch_path(spark)
    quiz.select(F.when(F.col("id") % 10 == 3, text.substr(F.lit(1), F.length(text) - 2)).otherwise(text).alias("value")).write.text(path)
    docs = D.read_json(spark, path, D.QUIZ)
    best = F.array_max(F.transform("attempts", lambda a: a["overall"]))
    return docs.select("id", "name", F.size("attempts").cast("long").alias("attempts"), best.alias("best"), F.element_at("attempts", -1)["at"].alias("last_at"))


def q_translations(spark: SparkSession, d: str) -> DataFrame:
    """Translations as JSON lines, the last line of an id winning, merged into the verses."""
    line = V.table(spark, d, "lineitem")
    path = D.scratch_path(spark)
    rows = line.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"), F.concat_ws("-", "l_orderkey", "l_suppkey", "l_linenumber").alias("text"), F.struct("l_orderkey", "l_suppkey", "l_linenumber").alias("n"))
    rows.write.json(path)
    read = spark.read.schema("id long, text string, n struct<l_orderkey: long, l_suppkey: long, l_linenumber: int>").json(path)
    return V.slokas(spark, d).select("sloka").join(D.last_by_id(read, "id", "n"), F.col("sloka") == F.col("id"), "left").select("sloka", "text")


def q_features_sink(spark: SparkSession, d: str) -> DataFrame:
    """Features stored by version; those of a stale version are ignored."""
    f = V.frames(spark, d).groupBy("recording").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "rms_db"))), lambda x: x["rms_db"]).alias("rms_db"))
    path = D.scratch_path(spark)
    D.write_features(f.where("recording % 4 = 0"), path, 1)
    D.write_features(f.where("recording % 4 <> 0"), path, 2)
    return D.read_features(spark, path, 2).select("recording", F.size("rms_db").cast("long").alias("frames"), F.element_at("rms_db", 1).alias("first_db"))


def q_recording_meta(spark: SparkSession, d: str) -> DataFrame:
    """Patches over current metadata: an absent field keeps, an explicit null clears, unknown vocabulary is refused."""
    c = V.table(spark, d, "customer")
    now = c.select("c_custkey", F.col("c_mktsegment").alias("style"), F.col("c_acctbal").alias("lead"))
    patch = c.where("c_custkey % 3 = 0").select(
        "c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("style"))).otherwise(F.array(F.lit("lead"))).alias("fields"),
        F.when(F.col("c_nationkey") < 8, "BUILDING").when(F.col("c_nationkey") < 16, "SHOUTED").alias("new_style"), F.when(F.col("c_nationkey") % 2 == 0, -F.col("c_acctbal")).alias("new_lead"),
    )
    j = now.join(patch, "c_custkey", "left")
    has = lambda f: F.coalesce(F.array_contains("fields", f), F.lit(False))
    valid = F.col("new_style").isNull() | F.col("new_style").isin("BUILDING", "MACHINERY", "HOUSEHOLD", "FURNITURE", "AUTOMOBILE")
    return j.select("c_custkey", F.when(has("style") & valid, F.col("new_style")).otherwise(F.col("style")).alias("style"), F.when(has("lead"), F.col("new_lead")).otherwise(F.col("lead")).alias("lead"))


def q_map_names(spark: SparkSession, d: str) -> DataFrame:
    """Recording names to verses: chapter and verse read from the url, doubtful where the page names another language."""
    p = V.table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"/([a-z]{2})/(\d+)", 1).alias("lang"), F.regexp_extract("url", r"/([a-z]{2})/(\d+)", 2).cast("long").alias("n"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("said"))
    v = V.slokas(spark, d).select(F.col("sloka").alias("n"), "chapter", "verse")
    j = p.join(v, "n", "left")
    state = F.when(F.col("chapter").isNull(), "unmapped").when(F.col("said") != F.col("lang"), "doubtful").otherwise("mapped")
    return j.select("page_id", "chapter", "verse", state.alias("state"))


def q_plan(spark: SparkSession, d: str) -> DataFrame:
    """Syllables of each line of a text, and the running checkpoints."""
    lines = F.filter(F.split("text", "\n"), lambda t: F.length(F.trim(t)) > 0)
    x = V.table(spark, d, "documents").select("doc_id", F.posexplode(lines).alias("pada", "t")).withColumn("n", texts.vowel_groups(F.col("t")).cast("long"))
    return x.select("doc_id", "pada", "n", F.sum("n").over(W.partitionBy("doc_id").orderBy("pada")).alias("checkpoint"))


def q_metre_for_record(spark: SparkSession, d: str) -> DataFrame:
    """Metre of a conversation's best text: what the system typed, else the first user turn, else the first reply."""
    c = V.table(spark, d, "conversations")
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    best = c.groupBy("conv_id").agg(F.min_by(F.struct("role", "text"), F.struct(rank.alias("r"), "turn")).alias("b"))
    family, exact, _ = texts.metre(texts.weight_pattern(F.element_at(F.split("b.text", "\n"), 1)))
    return best.select("conv_id", F.col("b.role").alias("role"), family.alias("family"), exact.alias("exact"))


def q_sound_scores(spark: SparkSession, d: str) -> DataFrame:
    """Share of a recording's active frames that no deviation covers, and the weighted blend of two kinds."""
    f = V.frames(spark, d).where("rms_db > -14").select("recording", "idx")
    bad = frames.runs(V.frames(spark, d).where("kind = 'error' OR rms_db > -1"), "recording", "idx", 1, 2).select(F.col("recording").alias("r"), "first", "last")
    hit = f.join(bad, (F.col("recording") == F.col("r")) & F.expr("idx BETWEEN first AND last"), "left_semi").groupBy("recording").agg(F.count("*").alias("hit"))
    n = f.groupBy("recording").agg(F.count("*").alias("n")).join(hit, "recording", "left")
    score = V.half_up(100 * (1 - F.coalesce("hit", F.lit(0)) / F.col("n")))
    return n.select("recording", score.cast("long").alias("content"))


def q_phrasing(spark: SparkSession, d: str) -> DataFrame:
    """F-measure of pauses: those of the reference (view events) kept in the take (click events) within a minute."""
    e = V.intervals(spark, d)
    ref, take = e.where("kind = 'view'").select("take", "span", "t0"), e.where("kind = 'click'").select(F.col("take").alias("tk"), F.col("span").alias("s"), F.col("t0").alias("t"))
    near = (F.col("take") == F.col("tk")) & F.expr("t BETWEEN t0 - 60 AND t0 + 60")
    kept = ref.join(take, near, "left_semi").groupBy("take").agg(F.count("*").alias("kept"))
    good = take.join(ref, near, "left_semi").groupBy(F.col("tk").alias("take")).agg(F.count("*").alias("good"))
    n = e.groupBy("take").agg(F.count_if(F.col("kind") == "view").alias("n_ref"), F.count_if(F.col("kind") == "click").alias("n_take"))
    j = n.join(kept, "take", "left").join(good, "take", "left").fillna(0, ["kept", "good"])
    recall, precision = F.try_divide("kept", "n_ref"), F.try_divide("good", "n_take")
    f1 = F.when((F.col("n_ref") == 0) & (F.col("n_take") == 0), 100.0).otherwise(F.coalesce(F.try_divide(200 * recall * precision, recall + precision), F.lit(0.0)))
    return j.select("take", F.round(f1, 4).alias("phrasing"))


def q_pada_starts(spark: SparkSession, d: str) -> DataFrame:
    """Start of each line by its share of syllables in the text before it, in a recording of a minute."""
    plan = q_plan(spark, d)
    total = F.max("checkpoint").over(W.partitionBy("doc_id"))
    return plan.select("doc_id", "pada", F.round(F.coalesce(F.try_divide(60 * (F.col("checkpoint") - F.col("n")), total), F.lit(0.0)), 6).alias("start"))


def q_award(spark: SparkSession, d: str) -> DataFrame:
    """Badges awarded in monthly batches over a snapshot that only rises: what each learner and quiz holds at the end.

    Every batch is an idempotent upsert (greatest level, first day), so the fold is one aggregate over batches.
    """
    o = V.table(spark, d, "orders").where("o_totalprice > 200000").select((F.col("o_custkey") % 50).alias("learner"), F.to_date("o_orderdate").alias("day")).distinct()
    n = F.row_number().over(W.partitionBy("learner").orderBy("day"))
    level = F.when(F.col("n") >= 10, 3).when(F.col("n") >= 5, 2).when(F.col("n") >= 3, 1)
    b = o.withColumn("n", n).withColumn("level", level).where("level IS NOT NULL")
    batches = b.groupBy("learner", F.trunc("day", "month").alias("month")).agg(F.max("level").alias("level"), F.min("day").alias("earned"))
    return batches.groupBy("learner").agg(F.max("level").alias("level"), F.min("earned").alias("earned_at"))


QUERIES = {
    "src_json_documents": q_json_documents, "src_translation_jsonl": q_translations, "snk_features_parquet": q_features_sink, "clean_recording_meta": q_recording_meta,
    "map_names_to_verses": q_map_names, "akshara_plan": q_plan, "metre_for_record": q_metre_for_record, "sound_scores": q_sound_scores, "phrasing_score": q_phrasing, "pada_starts": q_pada_starts, "award_badges_batches": q_award,
}
_PLAN = f"""l AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda t: length(trim(t, ' ')) > 0)) AS t, generate_subscripts(list_filter(string_split(text, chr(10)), lambda t: length(trim(t, ' ')) > 0), 1) - 1 AS pada FROM documents),
p AS (SELECT doc_id, pada, n, sum(n) OVER (PARTITION BY doc_id ORDER BY pada) AS checkpoint FROM (SELECT doc_id, pada, len(regexp_extract_all({texts._PLAIN.format('t')}, '[aeiou]+')) AS n FROM l))"""
ORACLE = {
    "src_json_documents": "SELECT o_custkey AS id, 'quiz ' || o_custkey AS name, count(*) AS attempts, max(floor(o_totalprice % 101))::BIGINT AS best, strftime(arg_max(o_orderdate, o_orderkey), '%Y-%m-%d') AS last_at FROM orders WHERE o_custkey % 10 <> 3 GROUP BY o_custkey",
    "src_translation_jsonl": V.sql("SELECT sloka, t.text FROM v_slokas LEFT JOIN (SELECT l_partkey, arg_max(l_orderkey || '-' || l_suppkey || '-' || l_linenumber, (l_orderkey, l_suppkey, l_linenumber)) AS text FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) t ON l_partkey = sloka", "v_slokas"),
    "snk_features_parquet": V.sql("SELECT recording, count(*) AS frames, arg_min(rms_db, idx) AS first_db FROM v_frames WHERE recording % 4 <> 0 GROUP BY recording", "v_frames"),
    "clean_recording_meta": """SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 AND NOT (c_nationkey >= 8 AND c_nationkey < 16) THEN CASE WHEN c_nationkey < 8 THEN 'BUILDING' END ELSE c_mktsegment END AS style,
CASE WHEN c_custkey % 6 = 3 THEN CASE WHEN c_nationkey % 2 = 0 THEN -c_acctbal END ELSE c_acctbal END AS lead FROM customer""",
    "map_names_to_verses": V.sql(
        r"""SELECT page_id, chapter, verse, CASE WHEN chapter IS NULL THEN 'unmapped' WHEN said <> lang THEN 'doubtful' ELSE 'mapped' END AS state
FROM (SELECT page_id, regexp_extract(url, '/([a-z]{2})/(\d+)', 1) AS lang, try_cast(regexp_extract(url, '/([a-z]{2})/(\d+)', 2) AS BIGINT) AS n, regexp_extract(html, 'lang="([a-z]+)"', 1) AS said FROM pages) LEFT JOIN v_slokas ON sloka = n""", "v_slokas"),
    "akshara_plan": f"WITH {_PLAN} SELECT * FROM p",
    "pada_starts": f"WITH {_PLAN} SELECT doc_id, pada, round(CASE WHEN max(checkpoint) OVER (PARTITION BY doc_id) > 0 THEN 60 * (checkpoint - n) / max(checkpoint) OVER (PARTITION BY doc_id) ELSE 0.0 END, 6) AS start FROM p",
    "metre_for_record": f"""WITH b AS (SELECT conv_id, arg_min(role, (CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, turn)) AS role, arg_min(text, (CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, turn)) AS text FROM conversations GROUP BY conv_id)
SELECT conv_id, role, {texts._FAMILY} AS family, length(w) IN (32, 44) AS exact FROM (SELECT conv_id, role, {texts._W.format('string_split(text, chr(10))[1]')} AS w FROM b)""",
    "sound_scores": V.sql(
        f""",, f AS (SELECT recording, idx FROM v_frames WHERE rms_db > -14), b AS ({frames._runs_sql("SELECT recording, idx FROM v_frames WHERE kind = 'error' OR rms_db > -1", 1, 2)})
SELECT recording, floor(100 * (1 - count(*) FILTER (EXISTS (SELECT 1 FROM b WHERE b.recording = f.recording AND idx BETWEEN first AND last)) / count(*)) + 0.5)::BIGINT AS content FROM f GROUP BY recording""", "v_frames"),
    "phrasing_score": V.sql(
        """,, r AS (SELECT take, t0, EXISTS (SELECT 1 FROM v_intervals c WHERE c.kind = 'click' AND c.take = v.take AND c.t0 BETWEEN v.t0 - 60 AND v.t0 + 60) AS ok FROM v_intervals v WHERE kind = 'view'), c AS (SELECT take, t0, EXISTS (SELECT 1 FROM r WHERE r.take = v.take AND v.t0 BETWEEN r.t0 - 60 AND r.t0 + 60) AS ok FROM v_intervals v WHERE kind = 'click'),
x AS (SELECT take, (SELECT count(*) FROM r WHERE r.take = a.take) AS nr, (SELECT count(*) FROM r WHERE r.take = a.take AND ok) AS k, (SELECT count(*) FROM c WHERE c.take = a.take) AS nt, (SELECT count(*) FROM c WHERE c.take = a.take AND ok) AS g FROM (SELECT DISTINCT take FROM v_intervals) a)
SELECT take, round(CASE WHEN nr = 0 AND nt = 0 THEN 100.0::DOUBLE WHEN nr = 0 OR nt = 0 OR k = 0 OR g = 0 THEN 0.0 ELSE 200 * (k / nr) * (g / nt) / (k / nr + g / nt) END, 4) AS phrasing FROM x""", "v_intervals"),
    "award_badges_batches": """WITH n AS (SELECT learner, day, row_number() OVER (PARTITION BY learner ORDER BY day) AS n FROM (SELECT DISTINCT o_custkey % 50 AS learner, o_orderdate::DATE AS day FROM orders WHERE o_totalprice > 200000))
SELECT learner, max(CASE WHEN n >= 10 THEN 3 WHEN n >= 5 THEN 2 ELSE 1 END) AS level, min(day) AS earned_at FROM n WHERE n >= 3 GROUP BY learner""",
}
