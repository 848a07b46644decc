"""Joins that pair takes with references, reconcile indexes, link recordings to verses and lay customisations over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from versewell.plans import views as V

WORD_SPLIT = "[\\x09-\\x0D\\x20]+"


def worklist(takes: DataFrame, selections: DataFrame, done: DataFrame) -> DataFrame:
    """Every take with its selected slokas, without pairs that have a report."""
    return takes.join(selections, "take").join(done, ["take", "sloka"], "left_anti")


def reconcile(index: DataFrame, disk: DataFrame) -> DataFrame:
    """Index rows (path, base) against files on disk: kept, moved (same base name, one to one), added or removed."""
    a, b = index.select(F.col("path").alias("p0"), F.col("base").alias("b0")), disk.select(F.col("path").alias("p1"), F.col("base").alias("b1"))
    j = a.join(b, F.col("p0") == F.col("p1"), "full")
    kept = j.where("p0 IS NOT NULL AND p1 IS NOT NULL").select("p0", "p1", F.lit("kept").alias("state"))
    gone = j.where("p1 IS NULL").select("p0", F.col("b0").alias("base"), F.row_number().over(W.partitionBy("b0").orderBy("p0")).alias("n"))
    new = j.where("p0 IS NULL").select("p1", F.col("b1").alias("base"), F.row_number().over(W.partitionBy("b1").orderBy("p1")).alias("n"))
    rest = gone.join(new, ["base", "n"], "full")
    state = F.when(F.col("p0").isNull(), "added").when(F.col("p1").isNull(), "removed").otherwise("moved")
    return kept.unionByName(rest.select("p0", "p1", state.alias("state")))


def q_worklist(spark: SparkSession, d: str) -> DataFrame:
    o, line = V.table(spark, d, "orders"), V.table(spark, d, "lineitem")
    takes = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("take"), F.col("o_custkey").alias("learner"))
    sel = line.select(F.col("l_orderkey").alias("take"), F.col("l_partkey").alias("sloka")).distinct()
    done = line.where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("take"), F.col("l_partkey").alias("sloka"))
    return worklist(takes, sel, done)


def q_reconcile(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select("doc_id", "source", "lang")
    base = F.concat(F.lit("f"), F.floor(F.col("doc_id") / 3).cast("string"))
    index = docs.where("doc_id % 10 < 8").select(F.concat_ws("/", "source", base, F.col("doc_id").cast("string")).alias("path"), base.alias("base"))
    disk = docs.where("doc_id % 10 > 1").select(F.concat_ws("/", F.when(F.col("doc_id") % 4 == 0, F.col("lang")).otherwise(F.col("source")), base, F.col("doc_id").cast("string")).alias("path"), base.alias("base"))
    return reconcile(index, disk)


def q_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Customisations over verses: maps merged, lists appended, fields replaced."""
    p = V.table(spark, d, "part")
    verses = p.select("p_partkey", "p_name", F.create_map(F.lit("en"), F.col("p_name"), F.lit("de"), F.col("p_brand")).alias("tr"), F.array("p_type").alias("variants"))
    over = p.where("p_size < 10").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).alias("name"), F.create_map(F.lit("de"), F.col("p_type")).alias("tr2"), F.array("p_brand").alias("v2"))
    j = verses.join(over, "p_partkey", "left")
    merged = F.coalesce(F.map_concat(F.map_filter("tr", lambda k, v: ~F.coalesce(F.map_contains_key(F.col("tr2"), k), F.lit(False))), "tr2"), F.col("tr"))
    return j.select("p_partkey", F.coalesce("name", "p_name").alias("name"), merged["en"].alias("en"), merged["de"].alias("de"), F.array_join(F.concat("variants", F.coalesce("v2", F.array().cast("array<string>"))), "|").alias("variants"))


def q_stale(spark: SparkSession, d: str) -> DataFrame:
    """Links whose copied text hash differs from the document's; null where the document is gone."""
    docs = V.table(spark, d, "documents")
    links = docs.select(F.when(F.col("doc_id") % 9 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("target"), F.col("doc_id").alias("link"), F.sha2(F.when(F.col("doc_id") % 5 == 0, F.trim("text")).when(F.col("doc_id") % 7 == 0, F.upper("lang")).otherwise(F.col("text")), 256).alias("copied"))
    now = docs.select(F.col("doc_id").alias("target"), F.sha2("text", 256).alias("hash"))
    return links.join(now, "target", "left").select("link", (F.col("copied") != F.col("hash")).alias("stale"))


def q_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    c, o = V.table(spark, d, "customer"), V.table(spark, d, "orders").where("o_totalprice > 400000")
    on = F.col("c_custkey") == F.col("o_custkey")
    linked = c.join(o, on, "left_semi").select("c_custkey", F.lit("linked").alias("state"))
    return linked.unionByName(c.join(o, on, "left_anti").select("c_custkey", F.lit("unlinked").alias("state")))


# ranges of verses by metre family in a chapter: fixed values of this stand-in
RANGES = ((2, 5, 8, "trishtubh"), (2, 20, 20, "trishtubh"), (8, 9, 11, "trishtubh"), (11, 15, 40, "trishtubh"), (15, 2, 5, "trishtubh"))


def q_family(spark: SparkSession, d: str) -> DataFrame:
    """Metre family of every sloka by its chapter's range table (a handful of rows, broadcast)."""
    table = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RANGES)) + " AS r(chapter, lo, hi, family)")
    j = V.slokas(spark, d).join(F.broadcast(table.withColumnRenamed("chapter", "ch")), F.expr("ch = chapter AND verse BETWEEN lo AND hi"), "left")
    return j.select("sloka", F.coalesce("family", F.lit("anushtubh")).alias("family"))


def q_chapter_recordings(spark: SparkSession, d: str) -> DataFrame:
    """Verses of each chapter with their recordings; a combined recording covers each of its parts."""
    s = V.slokas(spark, d)
    rec = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("rec"), F.col("l_partkey").alias("sloka"), (F.col("l_linenumber") % 3).alias("more")).join(s.select("sloka", "chapter", "verse"), "sloka")
    parts = rec.select("rec", "chapter", F.explode(F.sequence(F.col("verse"), F.least(F.col("verse") + F.col("more"), F.lit(40)))).alias("verse")).distinct()
    verses = s.select("chapter", "verse").distinct()
    return verses.join(parts, ["chapter", "verse"], "left").groupBy("chapter", "verse").agg(F.count("rec").alias("recordings"), F.min("rec").alias("first_rec"))


def q_diag(spark: SparkSession, d: str) -> DataFrame:
    """One diagnostic row per take and reference: the pair's numbers, or why there are none."""
    line = V.table(spark, d, "lineitem")
    pairs = line.groupBy(F.col("l_orderkey").alias("take"), F.col("l_partkey").alias("sloka")).agg(F.max("l_discount").alias("contrast"), F.max("l_tax").alias("words"), F.bool_or(F.col("l_returnflag") == "N").alias("failed"))
    takes = V.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("take"))
    error = F.when(F.col("sloka").isNull(), "no pair").when(F.col("failed"), "not comparable")
    return takes.join(pairs, "take", "left").select("take", "sloka", F.when(error.isNull(), F.round("contrast", 2)).alias("contrast"), F.when(error.isNull(), F.round("words", 2)).alias("words"), error.alias("error"))


def reference_words(df: DataFrame, verse: str, typed: str, fixed: str) -> DataFrame:
    """Add ``words`` and ``origin``: the linked verse, else the typed text, else the corrected transcript, each whole."""
    sources = (("verse", verse), ("typed", typed), ("transcript", fixed))
    origin = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(name)) for name, c in sources])
    return df.withColumn("words", F.coalesce(*[c for _, c in sources])).withColumn("origin", origin)


def q_reference_words(spark: SparkSession, d: str) -> DataFrame:
    """Words that a pair is judged by; a document of good quality stands for a verse, another labelled one for typed text."""
    docs, labels = V.table(spark, d, "documents"), V.table(spark, d, "labels")
    j = docs.join(labels.groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")
    j = j.select("doc_id", F.expr("CASE WHEN quality = 1 THEN text END").alias("v"), F.expr("CASE WHEN quality = 0 THEN text END").alias("t"), F.expr("CASE WHEN lang <> 'en' THEN text END").alias("f"))
    found = reference_words(j, "v", "t", "f")
    return found.select("doc_id", F.sha2("words", 256).alias("words_hash"), F.length("words").cast("long").alias("chars"), "origin")


def shingled(df: DataFrame, key: str, n: int = 5, text: str = "text") -> DataFrame:
    """(``key``, grams): 64-bit hashes of the distinct word shingles of each text that has any."""
    words = F.filter(F.split(F.lower(text), WORD_SPLIT), lambda w: w != "")
    grams = F.transform(F.sequence(F.lit(1), F.size("__w") - n + 1), lambda i: F.xxhash64(F.array_join(F.slice("__w", i, n), " ")))
    some = df.select(F.col(key), words.alias("__w")).where(F.size("__w") >= n)
    return some.select(key, F.when(F.size("__w") >= n, F.array_distinct(grams)).alias("grams"))


def _each(grams: str) -> Column:
    """Explode: of an expression, since for a column Spark adds a filter on its size, pushed down and worked out from the text anew."""
    return F.explode(F.coalesce(F.col(grams), F.array().cast("array<bigint>")))


def identify_reference(docs: DataFrame, refs: DataFrame, doc: str, ref: str, broadcast_grams: int = 1 << 20) -> DataFrame:
    """The reference that shares most word shingles with each document (ties: the smallest), and how many.

    References of equal shingles are one class. Where the references' shingles are at most ``broadcast_grams`` they
    travel to the documents, which then aren't shuffled by shingle; beyond that both sides are, and no shingle is left out.
    """
    classes = shingled(refs, ref).groupBy(F.array_sort("grams").alias("grams")).agg(F.min(ref).alias(ref))
    r = classes.select(ref, _each("grams").alias("gram"))
    if classes.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0] <= broadcast_grams:
        r = F.broadcast(r)
    hits = shingled(docs, doc).select(doc, _each("grams").alias("gram")).join(r, "gram").groupBy(doc, ref).agg(F.count("*").alias("shared"))
    best = hits.groupBy(doc).agg(F.max(F.struct("shared", (-F.col(ref)).alias("least"))).alias("b"))
    return best.select(doc, (-F.col("b.least")).alias(ref), "b.shared")


def q_identify(spark: SparkSession, d: str) -> DataFrame:
    return identify_reference(V.table(spark, d, "documents"), V.table(spark, d, "benchmark"), "doc_id", "item_id")


def q_link_verses(spark: SparkSession, d: str) -> DataFrame:
    """Link record of every identified document: the reference's text hash, and how it was mapped."""
    found, b = q_identify(spark, d), V.table(spark, d, "benchmark")
    j = found.join(b.select("item_id", F.sha2("text", 256).alias("text_hash")), "item_id")
    return j.select("doc_id", "item_id", "text_hash", F.when(F.col("shared") >= 10, "words").otherwise("doubtful").alias("mapped_by"))


def q_relabel(spark: SparkSession, d: str) -> DataFrame:
    """Segments whose best reference is at least 0.55 alike and 0.25 better than the assumed one (first maximum wins)."""
    line = V.table(spark, d, "lineitem")
    s = line.groupBy(F.col("l_orderkey").alias("seg"), F.col("l_partkey").alias("ref")).agg(F.max(F.col("l_discount") * 10).alias("sim"), F.sum("l_linenumber").alias("words"))
    w = W.partitionBy("seg")
    s = s.withColumn("assumed", F.min_by("sim", "ref").over(w)).withColumn("n", F.row_number().over(w.orderBy(F.desc("sim"), "ref"))).withColumn("all", F.sum("words").over(w))
    return s.where((F.col("n") == 1) & (F.col("sim") >= 0.55) & (F.col("sim") >= F.col("assumed") + 0.25) & (F.col("all") >= 4)).select("seg", "ref", F.round("sim", 3).alias("sim"))


# Allowances for adults, those of other ages (tolerance of pitch in semitones, slowest and fastest pace,
# floor of content, tolerance of pronunciation), ages of children, and ranges of voice warps.
ADULT = (0.5, 0.75, 1.33, 1.1, 10)
OF_AGE = {"under8": (1.0, 0.67, 1.5, 1.3, 30), "8to11": (0.75, 0.67, 1.5, 1.2, 20), "12to15": (0.6, 0.75, 1.33, 1.1, 15), "60plus": (0.5, 0.67, 1.33, 1.1, 10)}
CHILDREN, YOUNG, UNKNOWN = ("under8", "8to11", "12to15", "16to17"), ("under8", "8to11"), "preferNotToSay"
WARPS = {"child": (0.67, 1.5), "same": (0.86, 1.16), "other": (0.8, 1.25), "unknown": (0.74, 1.35)}
ALLOWED = ("pitch_tolerance", "slowest", "fastest", "content_floor", "pronunciation_tolerance")


def presets(voice: Column, age: Column, ref_voice: Column, ref_age: Column) -> dict[str, Column]:
    """What a comparison allows for, given who recites and who recorded the reference (null: not known).

    Ages widen the bands; the pairing of voices bounds the warps that may be tried, so that a warp can't explain a
    mispronunciation away.
    """
    out = {}
    for k, name in enumerate(ALLOWED):
        value = F.lit(ADULT[k])
        for group, values in OF_AGE.items():
            value = F.when(age == group, values[k]).otherwise(value)
        out[name] = value
    one, two = (F.when(v != UNKNOWN, v) for v in (voice, ref_voice))
    is_in = lambda a, groups: F.coalesce(a.isin(*groups), F.lit(False))
    young = is_in(age, YOUNG) | is_in(ref_age, YOUNG) | F.coalesce(one == "child", F.lit(False)) | F.coalesce(two == "child", F.lit(False))
    grown = ~is_in(age, CHILDREN) & ~is_in(ref_age, CHILDREN)
    kind = F.when(young, "child").when((one == two) & grown, "same").when(one.isNotNull() & two.isNotNull(), "other").otherwise("unknown")
    for k, name in enumerate(("least_warp", "most_warp")):
        out[name] = F.coalesce(*[F.when(kind == x, bounds[k]) for x, bounds in WARPS.items()])
    return out


def q_presets(spark: SparkSession, d: str) -> DataFrame:
    """Allowances for each customer as a learner; voices and ages of both sides come from their columns."""
    of = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))
    c = V.table(spark, d, "customer")
    voice, ref_voice = of(VOICES, F.col("c_nationkey")), of(VOICES, F.col("c_custkey"))
    age, ref_age = of(AGES, F.floor(F.col("c_custkey") / 4)), of(AGES, F.col("c_nationkey") + 2)
    return c.select("c_custkey", *[x.alias(name) for name, x in presets(voice, age, ref_voice, ref_age).items()])


VOICES, AGES = ("male", "female", "child", UNKNOWN), ("under8", "8to11", "12to15", "16to17", "18to39", "60plus", "unspecified")


def q_combine(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive verses composed to one entry, if all of its parts exist."""
    s = V.slokas(spark, d).groupBy("chapter", "verse").agg(F.min("name").alias("line"))
    want = s.where("verse % 3 = 1").select("chapter", F.col("verse").alias("first"), F.explode(F.sequence("verse", F.col("verse") + 2)).alias("verse"))
    j = want.join(s, ["chapter", "verse"], "left").groupBy("chapter", "first").agg(F.count("line").alias("parts"), F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("verse", "line")))).alias("l"))
    return j.where("parts = 3").select("chapter", "first", F.array_join(F.transform("l", lambda x: x["line"]), " / ").alias("text"))


def q_subtree(spark: SparkSession, d: str) -> DataFrame:
    """Pages under /en on their host: the folder itself or below it, never a mere prefix."""
    p = V.table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/?#]*/?([^?#]*)", 1), "/+$", "").alias("folder"))
    ok = ~F.col("folder").rlike(r"(^|/)\.") & (F.size(F.split("folder", "/")) <= 3)
    return p.where(ok & ((F.col("folder") == "en") | F.col("folder").startswith("en/"))).select("page_id", "folder")


def q_clean_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profiles with known vocabularies, a name, and pace fields inside their bounds (else dropped)."""
    c = V.table(spark, d, "customer")
    voice = F.element_at(F.create_map(*[F.lit(x) for x in ("BUILDING", "male", "MACHINERY", "female", "HOUSEHOLD", "child")]), F.col("c_mktsegment"))
    ratio = F.col("c_acctbal") / 4000
    return c.where(F.trim("c_name") != "").select("c_custkey", voice.alias("voice"), F.when(ratio.between(0.4, 2.5), F.floor(ratio * 10000 + 0.5) / 10000).alias("tempo_ratio"), F.when((F.col("c_acctbal") / 2).between(100, 4000), F.floor(F.col("c_acctbal") / 2 + 0.5)).alias("pause_ms"))


def q_merge_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts per conversation: background results only fill gaps, empty ones are rejected, a typed one wins."""
    c = V.table(spark, d, "conversations").where("length(trim(text)) > 0")
    lang = F.when(F.col("turn") % 2 == 0, "sa").otherwise("en")
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    first = F.row_number().over(W.partitionBy("conv_id", "lang").orderBy("rank", "turn"))
    t = c.select("conv_id", "turn", lang.alias("lang"), rank.alias("rank"), F.sha2("text", 256).alias("hash")).withColumn("n", first)
    current = F.first("lang").over(W.partitionBy("conv_id").orderBy("rank", "turn"))
    return t.where("n = 1").select("conv_id", "lang", "hash", (F.col("lang") == current).alias("is_current"))


QUERIES = {
    "join_take_reference": q_worklist, "join_reconcile_index": q_reconcile, "join_custom_overlay": q_overlay, "join_stale_links": q_stale, "semi_linked_anti_unlinked": q_semi_anti,
    "range_verse_family": q_family, "join_chapter_recordings": q_chapter_recordings, "join_diag": q_diag, "join_reference_words": q_reference_words, "fuzzy_identify_reference": q_identify,
    "join_link_verses": q_link_verses, "fuzzy_relabel_best": q_relabel, "presets_for_pair": q_presets, "combine_verses": q_combine, "filter_folder_subtree": q_subtree,
    "clean_profile_pace": q_clean_profile, "merge_transcripts": q_merge_transcripts,
}
_GRAMS = """dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x09-\\x0D\\x20]+'), lambda w: w <> '') AS w FROM documents), bw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\\x09-\\x0D\\x20]+'), lambda w: w <> '') AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS gram FROM dw, range(1, 20000) r(i) WHERE i <= len(w) - 4), bg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS gram FROM bw, range(1, 2000) r(i) WHERE i <= len(w) - 4),
hit AS (SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN bg USING (gram) GROUP BY ALL), best AS (SELECT doc_id, item_id, shared FROM hit QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, item_id) = 1)"""
ORACLE = {
    "join_take_reference": """SELECT DISTINCT l_orderkey AS take, o_custkey AS learner, l_partkey AS sloka FROM lineitem l JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' AND NOT EXISTS (SELECT 1 FROM lineitem n WHERE n.l_orderkey = l.l_orderkey AND n.l_partkey = l.l_partkey AND n.l_returnflag = 'N')""",
    "join_reconcile_index": """WITH i AS (SELECT source || '/f' || (doc_id // 3) || '/' || doc_id AS path, 'f' || (doc_id // 3) AS base FROM documents WHERE doc_id % 10 < 8), k AS (SELECT CASE WHEN doc_id % 4 = 0 THEN lang ELSE source END || '/f' || (doc_id // 3) || '/' || doc_id AS path, 'f' || (doc_id // 3) AS base FROM documents WHERE doc_id % 10 > 1),
g AS (SELECT path AS p0, base, row_number() OVER (PARTITION BY base ORDER BY path) AS n FROM i WHERE path NOT IN (SELECT path FROM k)), a AS (SELECT path AS p1, base, row_number() OVER (PARTITION BY base ORDER BY path) AS n FROM k WHERE path NOT IN (SELECT path FROM i))
SELECT i.path AS p0, k.path AS p1, 'kept' AS state FROM i JOIN k ON i.path = k.path UNION ALL SELECT p0, p1, CASE WHEN p0 IS NULL THEN 'added' WHEN p1 IS NULL THEN 'removed' ELSE 'moved' END FROM g FULL JOIN a USING (base, n)""",
    "join_custom_overlay": """SELECT p_partkey, CASE WHEN p_size < 10 AND p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, p_name AS en, CASE WHEN p_size < 10 THEN p_type ELSE p_brand END AS de, CASE WHEN p_size < 10 THEN p_type || '|' || p_brand ELSE p_type END AS variants FROM part""",
    "join_stale_links": """SELECT l.doc_id AS link, CASE WHEN t.doc_id IS NOT NULL THEN sha256(CASE WHEN l.doc_id % 5 = 0 THEN trim(l.text, ' ') WHEN l.doc_id % 7 = 0 THEN upper(l.lang) ELSE l.text END) <> sha256(t.text) END AS stale FROM documents l LEFT JOIN documents t ON t.doc_id = CASE WHEN l.doc_id % 9 = 0 THEN -l.doc_id - 1 ELSE l.doc_id END""",
    "semi_linked_anti_unlinked": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 'linked' ELSE 'unlinked' END AS state FROM customer",
    "range_verse_family": V.sql(f"SELECT sloka, coalesce(family, 'anushtubh') AS family FROM v_slokas s LEFT JOIN (VALUES {', '.join(map(str, RANGES))}) r(chapter, lo, hi, family) ON r.chapter = s.chapter AND verse BETWEEN lo AND hi", "v_slokas"),
    "join_chapter_recordings": V.sql(
        """,, p AS (SELECT DISTINCT l_orderkey AS rec, chapter, unnest(range(verse, least(verse + l_linenumber % 3, 40) + 1)) AS verse FROM lineitem JOIN v_slokas ON sloka = l_partkey), q AS (SELECT DISTINCT * FROM p)
SELECT chapter, verse, count(rec) AS recordings, min(rec) AS first_rec FROM (SELECT DISTINCT chapter, verse FROM v_slokas) LEFT JOIN q USING (chapter, verse) GROUP BY ALL""", "v_slokas"),
    "join_diag": """WITH p AS (SELECT l_orderkey AS take, l_partkey AS sloka, max(l_discount) AS contrast, max(l_tax) AS words, bool_or(l_returnflag = 'N') AS failed FROM lineitem GROUP BY ALL), j AS (SELECT o_orderkey AS take, sloka, contrast, words, CASE WHEN sloka IS NULL THEN 'no pair' WHEN failed THEN 'not comparable' END AS error FROM orders LEFT JOIN p ON take = o_orderkey WHERE o_orderstatus = 'F')
SELECT take, sloka, CASE WHEN error IS NULL THEN round(contrast, 2) END AS contrast, CASE WHEN error IS NULL THEN round(words, 2) END AS words, error FROM j""",
    "join_reference_words": """WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id), j AS (SELECT d.doc_id, text, CASE WHEN text IS NULL THEN NULL WHEN quality = 1 THEN 'verse' WHEN quality = 0 THEN 'typed' WHEN lang <> 'en' THEN 'transcript' END AS origin FROM documents d LEFT JOIN l USING (doc_id))
SELECT doc_id, CASE WHEN origin IS NOT NULL THEN sha256(text) END AS words_hash, CASE WHEN origin IS NOT NULL THEN length(text) END::BIGINT AS chars, origin FROM j""",
    "fuzzy_identify_reference": f"WITH {_GRAMS} SELECT doc_id, item_id, shared FROM best",
    "join_link_verses": f"WITH {_GRAMS} SELECT doc_id, item_id, sha256(text) AS text_hash, CASE WHEN shared >= 10 THEN 'words' ELSE 'doubtful' END AS mapped_by FROM best JOIN benchmark USING (item_id)",
    "fuzzy_relabel_best": """WITH s AS (SELECT l_orderkey AS seg, l_partkey AS ref, max(l_discount * 10) AS sim, sum(l_linenumber) AS words FROM lineitem GROUP BY ALL), r AS (SELECT *, first_value(sim) OVER (PARTITION BY seg ORDER BY ref) AS assumed, row_number() OVER (PARTITION BY seg ORDER BY sim DESC, ref) AS n, sum(words) OVER (PARTITION BY seg) AS al FROM s)
SELECT seg, ref, round(sim, 3) AS sim FROM r WHERE n = 1 AND sim >= 0.55::DOUBLE AND sim >= assumed + 0.25::DOUBLE AND al >= 4""",
    "presets_for_pair": f"""WITH c AS (SELECT c_custkey, {list(VOICES)}[c_nationkey % 4 + 1] AS v, {list(VOICES)}[c_custkey % 4 + 1] AS rv, {list(AGES)}[c_custkey // 4 % 7 + 1] AS a, {list(AGES)}[(c_nationkey + 2) % 7 + 1] AS ra FROM customer),
k AS (SELECT *, CASE WHEN a IN {YOUNG} OR ra IN {YOUNG} OR v = 'child' OR rv = 'child' THEN 'child' WHEN v = rv AND v <> '{UNKNOWN}' AND a NOT IN {CHILDREN} AND ra NOT IN {CHILDREN} THEN 'same' WHEN v <> '{UNKNOWN}' AND rv <> '{UNKNOWN}' THEN 'other' ELSE 'unknown' END AS kind FROM c)
SELECT c_custkey, {", ".join(f"CASE a {' '.join(f"WHEN '{g}' THEN {v[k]}" for g, v in OF_AGE.items())} ELSE {ADULT[k]} END{'::DOUBLE' if k < 4 else ''} AS {name}" for k, name in enumerate(ALLOWED))},
{", ".join(f"CASE kind {' '.join(f"WHEN '{g}' THEN {v[k]}" for g, v in WARPS.items())} END::DOUBLE AS {name}" for k, name in enumerate(("least_warp", "most_warp")))} FROM k""",
    "combine_verses": V.sql(
        """,, s AS (SELECT chapter, verse, min(name) AS line FROM v_slokas GROUP BY ALL) SELECT f.chapter, f.verse AS first, string_agg(s.line, ' / ' ORDER BY s.verse) AS text FROM s f JOIN s ON s.chapter = f.chapter AND s.verse BETWEEN f.verse AND f.verse + 2 WHERE f.verse % 3 = 1 GROUP BY ALL HAVING count(*) = 3""", "v_slokas"),
    "filter_folder_subtree": r"""SELECT page_id, folder FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1), '/+$', '') AS folder FROM pages) WHERE NOT regexp_matches(folder, '(^|/)\.') AND len(string_split(folder, '/')) <= 3 AND (folder = 'en' OR folder LIKE 'en/%')""",
    "clean_profile_pace": """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'male' WHEN 'MACHINERY' THEN 'female' WHEN 'HOUSEHOLD' THEN 'child' END AS voice, CASE WHEN c_acctbal / 4000 BETWEEN 0.4 AND 2.5 THEN floor(c_acctbal / 4000 * 10000 + 0.5) / 10000 END AS tempo_ratio, CASE WHEN c_acctbal / 2 BETWEEN 100 AND 4000 THEN floor(c_acctbal / 2 + 0.5)::BIGINT END AS pause_ms FROM customer WHERE trim(c_name) <> ''""",
    "merge_transcripts": """WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'sa' ELSE 'en' END AS lang, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS rank, sha256(text) AS hash FROM conversations WHERE length(trim(text)) > 0), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lang ORDER BY rank, turn) AS n, first_value(lang) OVER (PARTITION BY conv_id ORDER BY rank, turn) AS cur FROM t)
SELECT conv_id, lang, hash, lang = cur AS is_current FROM n WHERE n = 1""",
}
