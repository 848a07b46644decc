"""Verse datasets: folders of a manifest and a file of verses, read, hashed and checked as tables; source texts parsed.

Any number of datasets are read in one job: files are rows, JSON is parsed by schema, each rule of validation is a
filter or an anti-join that gives (dataset, id, level, rule) rows.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Kinds of entries, speakers, families of metre, and the lines that name who speaks.
KINDS = ("verse", "combined", "opening", "colophon", "invocation", "dhyana")
SPEAKERS = {"krishna": r"(श्री\s*)?भगवा(नु|न्\s*उ)वाच", "arjuna": r"अर्जुन\s*उवाच", "sanjaya": r"स(ञ्ज|ंज)य\s*उवाच", "dhritarashtra": r"धृतराष्ट्र\s*उवाच"}
FAMILIES = ("anushtubh", "trishtubh")
SPEAKER_LINE = rf"^({'|'.join(SPEAKERS.values())})\s*[।|]?$"
MARKER = r"\s*\|\|\s*[०-९0-9]+\s*(-\s*[०-९0-9]+\s*)?\|\|\s*$"
NOTE = r"\s*\((or|var)\b[^)]*\)\s*"

NAME = "struct<deva string, iast string, en string>"
SPEAKER = "struct<who string, deva string, iast string>"
METRE = "struct<family string, name string>"
VERSE = f"id string, kind string, chapter int, verse int, verseEnd int, speaker {SPEAKER}, deva array<string>, iast array<string>, metre {METRE}, translations map<string, string>, padas array<string>, recitedWith string"
MANIFEST = "id string, version string, files map<string, string>, sha256 map<string, string>, translations map<string, struct<name string, translator string, licence string>>"
DATA = f"schemaVersion string, dataset string, version string, chapters array<struct<chapter int, verses int, name {NAME}>>, verses array<struct<{VERSE}>>"


def nfc(text: Column) -> Column:
    """Canonical composition, by Arrow batches (Arrow's own function doesn't compose)."""

    def run(batch: pa.Array) -> pa.Array:
        return pa.array([None if x is None else x if x.isascii() else unicodedata.normalize("NFC", x) for x in batch.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)


def trimmed_lines(text: Column) -> Column:
    """Lines without spaces around them; empty ones are none."""
    return F.filter(F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def normalized_text(text: Column) -> Column:
    """Composed, one line per half-verse, single spaces: equal texts hash alike."""
    return F.array_join(F.transform(trimmed_lines(nfc(text)), lambda x: F.regexp_replace(x, r"(?U)\s+", " ")), "\n")


def verse_hash(speaker_line: Column, deva: Column) -> Column:
    """SHA-256 of the body with its speaker line."""
    body = F.concat_ws("\n", speaker_line, F.array_join(F.coalesce(deva, F.array().cast("array<string>")), "\n"))
    return F.sha2(normalized_text(body), 256)


def parsed_id(id_: Column) -> dict[str, Column]:
    """kind, chapter, verse and verseEnd that an id says; all null if it is none."""
    part = lambda pattern, k: F.nullif(F.regexp_extract(id_, pattern, k), F.lit(""))
    numbers, named, alone = r"^(\d+)\.(\d+)(?:-(\d+))?$", r"^(\d+)\.(opening|colophon)$", r"^(invocation|dhyana)(?:\.\d+)?$"
    chapter = F.coalesce(part(numbers, 1), part(named, 1)).cast("int")
    verse, end = part(numbers, 2).cast("int"), part(numbers, 3).cast("int")
    kind = F.coalesce(F.when(end.isNotNull(), F.when(end > verse, "combined")).when(verse.isNotNull(), "verse"), part(named, 2), part(alone, 1))
    known = kind.isNotNull()
    return {"kind": kind, "chapter": F.when(known, chapter), "verse": F.when(known, verse), "verseEnd": F.when(known, end)}


def read_datasets(spark: SparkSession, *roots: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(datasets, chapters, verses) of all folders below the roots that hold a manifest."""
    each = [spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).load(r).withColumn("root", F.lit(k)) for k, r in enumerate(roots)]
    return parse_datasets(reduce(DataFrame.unionByName, each).select("root", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "content"))


def parse_datasets(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(datasets, chapters, verses) of files (root, folder, file, content).

    datasets: folder, dataset, version, problem (it can't be read), changed (its verses don't have the manifest's hash).
    Of equal ids the first root's readable one counts. verses carry ``hash``.
    """
    text = F.decode("content", "UTF-8")
    manifest = files.where("file = 'manifest.json'").select("root", "folder", F.from_json(text, MANIFEST).alias("m"))
    manifest = manifest.withColumn("file", F.coalesce(F.col("m.files")["verses"], F.lit("verses.json")))
    read = manifest.join(files.select("folder", "file", F.from_json(text, DATA).alias("d"), F.sha2("content", 256).alias("sha")), ["folder", "file"], "left")
    problem = F.when(F.col("m.id").isNull() | (F.col("m.id") == ""), "manifest without an id").when(F.col("sha").isNull(), "no file of verses").when(F.col("d.verses").isNull(), "verses can't be read")
    said = F.col("m.sha256")[F.col("file")]
    read = read.withColumn("problem", problem).withColumn("changed", F.coalesce(said != F.col("sha"), F.lit(False)))
    first = F.row_number().over(W.partitionBy("m.id").orderBy(F.col("problem").isNotNull(), "root", "folder"))
    read = read.withColumn("n", first).where("n = 1 OR m.id IS NULL")
    datasets = read.select("folder", F.col("m.id").alias("dataset"), "m.version", "problem", "changed", F.map_keys("m.translations").alias("languages"), F.col("d.schemaVersion").alias("schemaVersion"), F.col("d.dataset").alias("named"))
    sound = read.where("problem IS NULL").select(F.col("m.id").alias("dataset"), "d")
    chapters = sound.select("dataset", F.inline("d.chapters"))
    verses = sound.select("dataset", F.posexplode("d.verses").alias("place", "v")).select("dataset", "place", "v.*")
    return datasets, chapters, verses.withColumn("hash", verse_hash(F.col("speaker.deva"), F.col("deva")))


def validate(datasets: DataFrame, chapters: DataFrame, verses: DataFrame, counts: DataFrame | None = None, families: DataFrame | None = None) -> DataFrame:
    """(dataset, id, level, rule): what breaks a rule. Errors keep a dataset from being served.

    ``counts`` (chapter, verses) and ``families`` (chapter, verse, family): tables of the work, for warnings.
    """
    told = parsed_id(F.col("id"))
    v = verses.select("*", *[c.alias(f"id_{k}") for k, c in told.items()])
    ok = v.where("id_kind IS NOT NULL")
    lines = F.size(F.filter("deva", lambda x: F.trim(x) == "")) == 0
    bad_lines = F.col("deva").isNull() | (F.size("deva") == 0) | ~lines
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"id_{c}"))
    of_id = {
        ("error", "unknown kind"): F.coalesce(~F.col("kind").isin(*KINDS), F.lit(True)),
        ("error", "kind differs from the id"): F.col("kind").isin(*KINDS) & differs("kind"),
        ("error", "fields differ from the id"): differs("chapter") | differs("verse") | differs("verseEnd"),
        ("error", "no lines"): bad_lines,
        ("error", "speaker line inside the text"): ~bad_lines & F.trim(F.element_at("deva", 1)).rlike(SPEAKER_LINE),
        ("error", "unknown speaker"): F.col("speaker.who").isNotNull() & ~F.col("speaker.who").isin(*SPEAKERS),
        ("error", "unknown metre"): F.col("metre").isNotNull() & ~F.coalesce(F.col("metre.family").isin(*FAMILIES), F.lit(False)),
        ("warning", "text is not composed"): ~bad_lines & (F.array_join("deva", "\n") != nfc(F.array_join("deva", "\n"))),
        ("warning", "lines of the two scripts differ"): ~bad_lines & (F.size("iast") > 0) & (F.size("iast") != F.size("deva")),
        ("warning", "not four padas"): ~bad_lines & F.col("padas").isNotNull() & (F.size("padas") != 4),
        ("warning", "recited with no verse"): F.col("recitedWith").isNotNull() & parsed_id(F.col("recitedWith"))["kind"].isNull(),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"))) for (level, rule), c in of_id.items()]), lambda x: x.isNotNull())
    rule = lambda df, level, text, id_="id": df.select("dataset", F.col(id_).cast("string").alias("id"), F.lit(level).alias("level"), F.lit(text).alias("rule"))
    listed = chapters.where("chapter >= 1").select("dataset", "chapter").distinct()
    here = ok.where("id_kind = 'verse'").groupBy("dataset", F.col("id_chapter").alias("chapter")).agg(F.count("*").alias("have"))
    per_chapter = chapters.where("chapter >= 1").join(here, ["dataset", "chapter"], "left").withColumn("have", F.coalesce("have", F.lit(0)))
    parts = ok.where("id_kind = 'combined'").select("dataset", F.col("id").alias("whole"), F.explode(F.sequence("id_verse", "id_verseEnd")).alias("n"), "id_chapter")
    parts = parts.withColumn("id", F.concat_ws(".", "id_chapter", "n"))
    used = ok.select("dataset", F.explode(F.map_keys("translations")).alias("language")).distinct()
    named = datasets.where("languages IS NOT NULL").select("dataset", "languages")
    found = [
        rule(v.where("id_kind IS NULL"), "error", "not a verse id"),
        ok.select("dataset", "id", F.inline(broken)),
        rule(ok.groupBy("dataset", "id").agg(F.count("*").alias("n")).where("n > 1"), "error", "listed twice"),
        rule(ok.where("id_chapter IS NOT NULL").join(listed, (ok["dataset"] == listed["dataset"]) & (F.col("id_chapter") == listed["chapter"]), "left_anti"), "error", "chapter is not listed"),
        rule(parts.join(ok.select("dataset", "id"), ["dataset", "id"], "left_anti").select("dataset", "whole", "id").distinct(), "error", "a part is missing", "whole"),
        rule(chapters.where("chapter IS NULL OR chapter < 1"), "error", "chapter without a number", "chapter"),
        rule(chapters.where("chapter >= 1").groupBy("dataset", "chapter").agg(F.count("*").alias("n")).where("n > 1"), "error", "chapter listed twice", "chapter"),
        rule(chapters.where("chapter >= 1 AND (verses IS NULL OR verses < 1)"), "error", "chapter without a count", "chapter"),
        rule(chapters.where("chapter >= 1 AND name.deva IS NULL"), "warning", "chapter without a name", "chapter"),
        rule(per_chapter.where("verses IS NOT NULL AND have <> verses"), "error", "count of the chapter", "chapter"),
        rule(used.join(named, "dataset").where("NOT array_contains(languages, language)"), "warning", "language is not in the manifest", "language"),
        rule(datasets.where("problem IS NULL AND NOT coalesce(schemaVersion, '') LIKE '1.%'"), "error", "version of the schema", "schemaVersion"),
        rule(datasets.where("problem IS NULL AND (named IS NULL OR named <> dataset)"), "error", "named otherwise than in the manifest", "named"),
        rule(datasets.where("problem IS NOT NULL"), "error", "can't be read", "folder"),
        rule(datasets.where("changed"), "warning", "verses differ from the manifest's hash", "folder"),
    ]
    if counts is not None:
        table = counts.select("chapter", F.col("verses").alias("of_work"))
        found.append(rule(per_chapter.join(table, "chapter").where("have <> of_work"), "warning", "count of the work's chapter", "chapter"))
    if families is not None:
        of_work = families.select(F.col("chapter").alias("id_chapter"), F.col("verse").alias("id_verse"), "family")
        of_verse = ok.where("id_kind = 'verse' AND metre IS NOT NULL").join(of_work, ["id_chapter", "id_verse"])
        found.append(rule(of_verse.where(F.col("metre.family").isin(*FAMILIES) & (F.col("metre.family") != F.col("family"))), "warning", "metre differs from the work's"))
    return reduce(DataFrame.unionByName, found)


def speaker_of(line: Column) -> Column:
    """Who speaks, by an attribution line of its own; null for any other line."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(line, "[|।॥]", " "), r"(?U)\s+", " "))
    return F.coalesce(*[F.when(plain.rlike(f"^{form}$"), who) for who, form in SPEAKERS.items()])


def parse_source_verse(sources: DataFrame, overrides: DataFrame | None = None, text: str = "slok", latin: str = "transliteration", id_: str = "id") -> DataFrame:
    """Add who, speaker_line, deva, iast_speaker, iast: a source's text without its marker and notes, in its own dandas.

    ``overrides`` (id, nr, wrong, right): corrections of single verses, in the order of ``nr``.
    """
    single = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    lines = trimmed_lines(F.regexp_replace(F.replace(nfc(F.coalesce(text, F.lit(""))), F.lit("\r"), F.lit("")), MARKER, " ॥"))
    roman = trimmed_lines(F.regexp_replace(F.replace(nfc(F.coalesce(latin, F.lit(""))), F.lit("\r"), F.lit("")), MARKER, " ||"))
    rest = lambda c, has: F.when(has, F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(F.col(c))

    def dandas(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, r"\s*\|\|\s*$", " ॥"), r"\s*\|\s*$", " ।")
        return F.replace(F.replace(x, F.lit("||"), F.lit("॥")), F.lit("|"), F.lit("।"))

    def roman_line(x: Column) -> Column:
        x = F.regexp_replace(F.replace(x, F.lit(".a"), F.lit("’a")), r"\s*\|\|\s*$", " ||")
        return F.regexp_replace(x, r"\s*\.\s*$", " |")

    s = sources.withColumn("__d", lines).withColumn("__r", F.transform(roman, roman_line))
    head, roman_head = F.get("__d", F.lit(0)), F.get("__r", F.lit(0))
    attributed = roman_head.contains("uvāca") & ~roman_head.contains("||") & (F.size(F.split(roman_head, " ")) <= 3)
    s = s.withColumn("who", speaker_of(head)).withColumn("speaker_line", F.when(F.col("who").isNotNull(), single(F.regexp_replace(head, "[|।॥]", " "))))
    s = s.withColumn("deva", F.transform(rest("__d", F.col("who").isNotNull()), lambda x: single(F.regexp_replace(dandas(x), NOTE, " "))))
    s = s.withColumn("iast_speaker", F.when(F.coalesce(attributed, F.lit(False)), F.regexp_replace(roman_head, r"\s*\|\s*$", "")))
    s = s.withColumn("iast", rest("__r", F.col("iast_speaker").isNotNull())).drop("__d", "__r")
    if overrides is None:
        return s
    fixes = overrides.groupBy(id_).agg(F.sort_array(F.collect_list(F.struct("nr", "wrong", "right"))).alias("__fixes"))
    s = s.join(fixes, id_, "left")
    fixed = F.aggregate("__fixes", F.col("deva"), lambda found, f: F.transform(found, lambda x: F.replace(x, f["wrong"], f["right"])))
    return s.withColumn("deva", F.when(F.col("__fixes").isNotNull(), fixed).otherwise(F.col("deva"))).drop("__fixes")


def unused_overrides(parsed: DataFrame, overrides: DataFrame, id_: str = "id") -> DataFrame:
    """Corrections that find nothing, against the text parsed without them."""
    j = overrides.join(parsed.select(id_, "deva"), id_, "left")
    return j.where(~F.coalesce(F.exists("deva", lambda x: x.contains(F.col("wrong"))), F.lit(False))).select(id_, "nr", "wrong")
