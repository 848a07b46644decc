"""Datasets of verses: reading, hashes, every rule of validation, source texts."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from versewell.sources import verses as S

# fixed values: a few verses with their speakers
LINES = ["हृषीकेशं तदा वाक्यमिदमाह महीपते ।", "सेनयोरुभयोर्मध्ये रथं स्थापय मेऽच्युत ॥"]


def verse(id_, kind="verse", **more):
    numbers = [int(x) if x.isdigit() else None for x in (*id_.replace("-", ".").split("."), "", "")[:3]]
    out = {"id": id_, "kind": kind, "chapter": numbers[0], "verse": numbers[1], "verseEnd": numbers[2], "speaker": {"who": "arjuna", "deva": None}, "deva": LINES, "metre": {"family": "anushtubh"}, "translations": {"en": "x"}}
    return out | more


def dataset(verses, chapters=None, **more):
    return {"schemaVersion": "1.0.0", "dataset": "gita", "chapters": chapters or [{"chapter": 1, "verses": 2, "name": {"deva": "अर्जुनविषादयोग"}}], "verses": verses} | more


def put(folder, data, name="verses.json", **manifest):
    folder.mkdir(parents=True)
    raw = json.dumps(data, ensure_ascii=False).encode() if not isinstance(data, bytes) else data
    (folder / name).write_bytes(raw)
    m = {"id": "gita", "version": "1", "files": {"verses": name}, "sha256": {name: hashlib.sha256(raw).hexdigest()}, "translations": {"en": {"name": "English"}}} | manifest
    (folder / "manifest.json").write_text(json.dumps(m))


SOUND = [verse("1.1", speaker={"who": "arjuna", "deva": "अर्जुन उवाच"}), verse("1.2"), verse("1.1-2", "combined"), verse("1.colophon", "colophon", metre=None, speaker=None)]


def test_reading(spark, tmp_path):
    put(tmp_path / "one" / "gita", dataset(SOUND))
    put(tmp_path / "two" / "gita", dataset(SOUND[:1]))  # of the same id: the first root's counts
    put(tmp_path / "one" / "broken", b"{nonsense", id="broken")
    put(tmp_path / "two" / "broken", dataset(SOUND, dataset="broken"), "text.json", id="broken")  # a sound one is not shadowed
    put(tmp_path / "one" / "edited", dataset(SOUND, dataset="edited"), id="edited", sha256={"verses.json": "0" * 64})
    put(tmp_path / "one" / "nameless", dataset(SOUND), id=None)
    datasets, chapters, verses = S.read_datasets(spark, str(tmp_path / "one"), str(tmp_path / "two"))
    got = {r.dataset: (r.folder.rsplit("/", 2)[-2], r.problem, r.changed) for r in datasets.collect()}
    assert got == {"gita": ("one", None, False), "broken": ("two", None, False), "edited": ("one", None, True), None: ("one", "manifest without an id", False)}
    assert verses.groupBy("dataset").count().collect() and {r.dataset: r["count"] for r in verses.groupBy("dataset").count().collect()} == {"gita": 4, "broken": 4, "edited": 4}
    first = verses.where("dataset = 'gita' AND id = '1.1'").first()
    assert first.hash == hashlib.sha256("\n".join(["अर्जुन उवाच", *LINES]).encode()).hexdigest()
    assert S.validate(datasets, chapters, verses).where("level = 'error'").select("dataset", "rule").distinct().collect() == [(None, "can't be read")]
    assert [tuple(r) for r in S.validate(datasets, chapters, verses).where("level = 'warning'").select("dataset", "rule").collect()] == [("edited", "verses differ from the manifest's hash")]


def broken(spark, tmp_path, verses, chapters=None, counts=None, families=None, manifest=None, **more):
    put(tmp_path / "d", dataset(verses, chapters, **more), **(manifest or {}))
    return sorted(((r.id, r.level, r.rule) for r in S.validate(*S.read_datasets(spark, str(tmp_path)), counts, families).collect()), key=str)


E, WARN = "error", "warning"
CASES = {
    "sound": (SOUND, []),
    "id": ([*SOUND, verse("1.x", chapter=1)], [("1.x", E, "not a verse id")]),
    "range": ([*SOUND, verse("1.5-3", "combined")], [("1.5-3", E, "not a verse id")]),
    "twice": ([*SOUND[:2], SOUND[2], SOUND[2]], [("1.1-2", E, "listed twice")]),
    "kind": ([*SOUND[:3], verse("1.colophon", "verse", metre=None)], [("1.colophon", E, "kind differs from the id")]),
    "no kind": ([*SOUND[:3], verse("1.colophon", None, metre=None)], [("1.colophon", E, "unknown kind")]),
    "fields": ([SOUND[0], verse("1.2", verse=3)], [("1.2", E, "fields differ from the id")]),
    "chapter": ([*SOUND, verse("9.9")], [("9.9", E, "chapter is not listed")]),
    "part": ([*SOUND, verse("1.2-4", "combined")], [("1.2-4", E, "a part is missing")] * 2),
    "lines": ([SOUND[0], verse("1.2", deva=[])], [("1.2", E, "no lines")]),
    "blank": ([SOUND[0], verse("1.2", deva=["x", " "])], [("1.2", E, "no lines")]),
    "inside": ([SOUND[0], verse("1.2", deva=["अर्जुन उवाच ।", *LINES])], [("1.2", E, "speaker line inside the text")]),
    "speaker": ([SOUND[0], verse("1.2", speaker={"who": "nobody"})], [("1.2", E, "unknown speaker")]),
    "metre": ([SOUND[0], verse("1.2", metre={"family": "sonnet"})], [("1.2", E, "unknown metre")]),
    "iast": ([SOUND[0], verse("1.2", iast=["one"])], [("1.2", WARN, "lines of the two scripts differ")]),
    "padas": ([SOUND[0], verse("1.2", padas=["a", "b"])], [("1.2", WARN, "not four padas")]),
    "composed": ([SOUND[0], verse("1.2", deva=["e\u0301"])], [("1.2", WARN, "text is not composed")]),
    "with": ([SOUND[0], verse("1.2", recitedWith="x")], [("1.2", WARN, "recited with no verse")]),
    "count": (SOUND[:1], [("1", E, "count of the chapter")]),
    "language": ([SOUND[0], verse("1.2", translations={"de": "y"})], [("de", WARN, "language is not in the manifest")]),
}


@pytest.mark.parametrize("name", CASES)
def test_rules(spark, tmp_path, name):
    verses, want = CASES[name]
    got = broken(spark, tmp_path, verses)
    assert got == sorted(want)


def test_rules_of_chapters_and_tables(spark, tmp_path):
    chapters = [{"chapter": 1, "verses": 2, "name": {"deva": "a"}}, {"chapter": 1, "verses": 2}, {"chapter": None, "verses": 1}, {"chapter": 2, "verses": None, "name": {"deva": "b"}}]
    counts = spark.createDataFrame([(1, 47)], "chapter int, verses int")
    families = spark.createDataFrame([(1, 1, "anushtubh"), (1, 2, "trishtubh")], "chapter int, verse int, family string")
    got = broken(spark, tmp_path, SOUND, chapters, counts, families, schemaVersion="2.0", dataset="other")
    assert {r for _, _, r in got} == {"chapter listed twice", "chapter without a number", "chapter without a count", "chapter without a name", "count of the work's chapter", "metre differs from the work's", "version of the schema", "named otherwise than in the manifest"}


def test_source_texts(spark):
    rows = [
        ("1.1", "धृतराष्ट्र उवाच |\r\nधर्मक्षेत्रे कुरुक्षेत्रे समवेता युयुत्सवः |\nमामकाः पाण्डवाश्चैव किमकुर्वत सञ्जय ||१-१||", "dhṛtarāṣṭra uvāca .\ndharmakṣetre kurukṣetre .\nmāmakāḥ pāṇḍavāścaiva.api ||1-1||"),
        ("1.19", "नभश्च पृथिवीं चैव |\nतुमुलोऽभ्यनुनादयन् (or लोव्यनु) ||१-१९||", None), ("2.1", "उवाच पार्थ पश्यैतान् |", ""), ("x", None, None), ("1.c", "ॐ तत्सदिति ||१||", "oṃ tatsaditi ||1||"),
    ]
    overrides = spark.createDataFrame([("1.1", 1, "किम", "कम"), ("1.1", 2, "कमकु", "ककु"), ("1.19", 1, "gone", "x")], "id string, nr int, wrong string, right string")
    df = spark.createDataFrame(rows, "id string, slok string, transliteration string")
    got = {r.id: r for r in S.parse_source_verse(df).collect()}
    assert (got["1.1"].who, got["1.1"].speaker_line, got["1.1"].deva[1]) == ("dhritarashtra", "धृतराष्ट्र उवाच", "मामकाः पाण्डवाश्चैव किमकुर्वत सञ्जय ॥")
    assert got["1.1"].deva[0].endswith("युयुत्सवः ।") and got["1.1"].iast_speaker.startswith("dhṛtarāṣṭra uvāca") and got["1.1"].iast == ["dharmakṣetre kurukṣetre |", "māmakāḥ pāṇḍavāścaiva’api ||"]
    assert got["1.19"].deva == ["नभश्च पृथिवीं चैव ।", "तुमुलोऽभ्यनुनादयन् ॥"] and got["1.19"].who is None and got["1.19"].iast == []
    assert got["2.1"].who is None and got["2.1"].deva == ["उवाच पार्थ पश्यैतान् ।"] and got["x"].deva == [] and got["1.c"].deva == ["ॐ तत्सदिति ॥"]
    fixed = {r.id: r.deva for r in S.parse_source_verse(df, overrides).collect()}
    assert fixed["1.1"][1] == "मामकाः पाण्डवाश्चैव ककुर्वत सञ्जय ॥" and fixed["1.19"] == got["1.19"].deva
    assert sorted((r.id, r.nr) for r in S.unused_overrides(S.parse_source_verse(df), overrides).collect()) == [("1.1", 2), ("1.19", 1)]
    who = spark.createDataFrame([("श्रीभगवानुवाच",), ("श्री भगवान् उवाच",), ("संजय उवाच",), ("अर्जुन उवाच ।",), ("कर्मण्येवाधिकारस्ते",)], "t string").select(S.speaker_of(F.col("t")).alias("w")).collect()
    assert [r.w for r in who] == ["krishna", "krishna", "sanjaya", "arjuna", None]


def test_normalized_text(spark):
    df = spark.createDataFrame([("  a  b \r\n\n c\u0301 ",), (None,), ("",)], "t string").select(S.normalized_text(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == ["a b\n\u0107", None, ""]
