"""Jobs on verse datasets. The driver's tables hold none: datasets and source texts are written from ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versewell.plans import views as V
from versewell.sources import verses as S

SIZE, CHAPTERS, PER_CHAPTER = 500, 16, 38


def slokas(spark: SparkSession, d: str) -> DataFrame:
    """Slokas in datasets of a folder's, at most SIZE of the library each."""
    s = V.slokas(spark, d)
    return s.withColumn("dataset", F.concat_ws("-", "folder", F.floor(F.col("sloka") / SIZE))).withColumn("id", F.concat_ws(".", "chapter", "verse"))


def files(spark: SparkSession, d: str) -> DataFrame:
    """Manifest and verses of each dataset as files; every other part of the library has an outdated hash."""
    none = F.lit(None).cast("int")
    chapter = lambda k: F.struct(k.cast("int").alias("chapter"), F.lit(PER_CHAPTER).alias("verses"), F.struct(F.concat(F.lit("chapter "), k).alias("deva")).alias("name"))
    lines = F.when(F.col("sloka") % 13 == 0, F.array().cast("array<string>")).otherwise(F.array("name"))
    entry = F.struct("sloka", "id", F.lit("verse").alias("kind"), F.col("chapter").cast("int").alias("chapter"), F.col("verse").cast("int").alias("verse"), none.alias("verseEnd"), lines.alias("deva"))
    data = slokas(spark, d).groupBy("dataset").agg(F.sort_array(F.collect_list(entry)).alias("verses"), (F.min(F.floor(F.col("sloka") / SIZE)) % 2).alias("odd"))
    data = data.withColumn("text", F.to_json(F.struct(F.lit("1.0.0").alias("schemaVersion"), "dataset", F.transform(F.sequence(F.lit(1), F.lit(CHAPTERS)), chapter).alias("chapters"), "verses")))
    sha = F.when(F.col("odd") == 1, F.lit("0")).otherwise(F.sha2(F.encode("text", "UTF-8"), 256))
    manifest = F.to_json(F.struct(F.col("dataset").alias("id"), F.lit("1").alias("version"), F.create_map(F.lit("verses.json"), sha).alias("sha256")))
    both = F.array(F.struct(F.lit("verses.json").alias("file"), F.col("text").alias("text")), F.struct(F.lit("manifest.json").alias("file"), manifest.alias("text")))
    return data.select(F.lit(0).alias("root"), F.col("dataset").alias("folder"), F.inline(both)).select("root", "folder", "file", F.encode("text", "UTF-8").alias("content"))


def q_verse_dataset(spark: SparkSession, d: str) -> DataFrame:
    _, _, verses = S.parse_datasets(files(spark, d))
    return verses.select("dataset", "place", "id", "hash")


def q_validate(spark: SparkSession, d: str) -> DataFrame:
    found = S.validate(*S.parse_datasets(files(spark, d)))
    return found.groupBy("dataset", "level", "rule").agg(F.count("*").alias("broken"))


def q_parse_source(spark: SparkSession, d: str) -> DataFrame:
    """Names as source texts: an attribution for some, two lines, a marker, a note, and a correction."""
    s = slokas(spark, d)
    words = F.split("name", " ")
    who = F.when(F.col("sloka") % 5 == 0, F.lit("अर्जुन उवाच |\r\n")).otherwise("")
    note = F.when(F.col("sloka") % 7 == 0, F.lit(" (var x y)")).otherwise("")
    two = [F.element_at(words, 1), F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " ")]
    slok = F.concat(who, two[0], F.lit(" |\n"), two[1], note, F.lit(" ||"), "chapter", F.lit("-"), "verse", F.lit("||"))
    source = s.select(F.col("sloka").alias("id"), slok.alias("slok"), F.concat(two[0], F.lit(" .\n"), two[1], F.lit(" ||1-1||")).alias("transliteration"))
    overrides = s.where("sloka % 11 = 0").select(F.col("sloka").alias("id"), F.lit(1).alias("nr"), F.lit("e").alias("wrong"), F.lit("E").alias("right"))
    p = S.parse_source_verse(source, overrides)
    return p.select("id", "who", "speaker_line", F.array_join("deva", "/").alias("deva"), F.array_join("iast", "/").alias("iast"))


QUERIES = {"src_verse_dataset": q_verse_dataset, "validate_dataset": q_validate, "parse_source_verse": q_parse_source}
_S = f"(SELECT *, folder || '-' || (sloka // {SIZE}) AS dataset, chapter || '.' || verse AS id FROM v_slokas)"
_T = "CASE WHEN sloka % 11 = 0 THEN replace({}, 'e', 'E') ELSE {} END"
_L = ["string_split(name, ' ')[1]", "array_to_string(string_split(name, ' ')[2:], ' ')"]
ORACLE = {
    "src_verse_dataset": V.sql(f"SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY sloka) - 1 AS place, id, sha256(CASE WHEN sloka % 13 = 0 THEN '' ELSE trim(regexp_replace(name, ' +', ' ', 'g')) END) AS hash FROM {_S}", "v_slokas"),
    "validate_dataset": V.sql(
        f"""SELECT dataset, level, rule, count(*) AS broken FROM (
SELECT dataset, 'error' AS level, 'listed twice' AS rule FROM {_S} GROUP BY dataset, id HAVING count(*) > 1
UNION ALL SELECT dataset, 'error', 'no lines' FROM {_S} WHERE sloka % 13 = 0
UNION ALL SELECT dataset, 'error', 'chapter is not listed' FROM {_S} WHERE chapter > {CHAPTERS}
UNION ALL SELECT dataset, 'error', 'count of the chapter' FROM (SELECT d.dataset, c.chapter, count(s.id) AS have FROM (SELECT DISTINCT dataset FROM {_S}) d CROSS JOIN range(1, {CHAPTERS + 1}) c(chapter) LEFT JOIN {_S} s ON s.dataset = d.dataset AND s.chapter = c.chapter GROUP BY 1, 2) WHERE have <> {PER_CHAPTER}
UNION ALL SELECT DISTINCT dataset, 'warning', 'verses differ from the manifest''s hash' FROM {_S} WHERE (sloka // {SIZE}) % 2 = 1) GROUP BY ALL""", "v_slokas"),
    "parse_source_verse": V.sql(
        f"""SELECT sloka AS id, CASE WHEN sloka % 5 = 0 THEN 'arjuna' END AS who, CASE WHEN sloka % 5 = 0 THEN 'अर्जुन उवाच' END AS speaker_line,
{_T.format(*[f"({_L[0]} || ' ।/' || trim({_L[1]} || ' ॥'))"] * 2)} AS deva, {_L[0]} || ' |/' || trim({_L[1]} || ' ||') AS iast FROM v_slokas""", "v_slokas"),
}
