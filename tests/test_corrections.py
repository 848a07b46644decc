"""Keys by sound, akṣaras and breaks of lines, self-corrections and moved boundaries."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SMALL
from versewell.functions.sounds import akshara_counts, phonetic_key
from versewell.operators import corrections as C
from versewell.operators import texts


def test_phonetic_key(spark):
    # fixed values: words and how they sound
    want = {
        "नमः": "namah", "श्री": "sri", "भगवान्": "bhagavan", "अव्यक्तं": "avyaktam", "ॐ": "om", "ಶಿವಾಯ": "sivaya", "Śrī": "sri", "Bhagavān": "bhagavan", "avyaktaṁ": "avyaktam", "namaḥ": "namah",
        "फ़ल": "phala", "खैर": "khaira", "ऐक्य": "aikya", "कौ": "kau", "कोऽपि": "kopi", "কো": "ko", "কো": "ko", "கொ": "ko", "ક્ષેત્ર": "ksetra", "ਗੁਰੂ": "guru", "": "", "É9x": "e9x", "क१": "ka",
    }
    df = spark.createDataFrame([(w,) for w in [*want, None]], "w string")
    assert {r.w: r.k for r in df.select("w", phonetic_key(F.col("w")).alias("k")).collect()} == want | {None: None}


def test_aksharas(spark):
    words = {"सर्वधर्मान्परित्यज्य": 8, "मामेकं": 3, "jagat": 2, "k": 1, "ॐ": 1, "क्": 1, "aindra": 2, "ಕರ್ಮಣ್ಯೇವಾಧಿಕಾರಸ್ತೇ": 8, "12": 0, "नमः": 2}
    df = spark.createDataFrame([(list(words),), ([],)], "w array<string>")
    assert [r.n for r in df.select(akshara_counts(F.col("w")).alias("n")).collect()] == [list(words.values()), []]


def plain_breaks(counts, per, lines):
    out, first = [], 0
    for target in [per * k for k in ((1, 2, 3) if lines == 4 else (2,))]:
        near = [(abs(sum(counts[: i + 1]) - target), i) for i in range(first, len(counts) - 1)]
        if target >= sum(counts) or not near or min(near)[0] > per:
            break
        out.append(min(near)[1])
        first = out[-1] + 1
    return out


def test_pada_breaks(spark):
    verse = "सर्वधर्मान्परित्यज्य मामेकं शरणं व्रज अहं त्वा सर्वपापेभ्यो मोक्षयिष्यामि मा शुचः".split()
    heard = "येत्वक्षरम निर्देश्यम अव्यक्तं पर्युपासते सर्वत्रगम चिंत्यम्चा गूटस्थम चलं थुवं".split()
    df = spark.createDataFrame([(0, verse), (1, heard)], "k int, w array<string>").select("k", akshara_counts(F.col("w")).alias("n"))
    got = {r.k: (r.two, r.four) for r in df.select("k", texts.pada_breaks(F.col("n"), 8, 2).alias("two"), texts.pada_breaks(F.col("n"), 8, 4).alias("four")).collect()}
    assert got[0] == ([3], [0, 3, 6]) and got[1][0] == [3]
    rng = random.Random(4)
    rows = [[rng.randint(0, 9) for _ in range(rng.randint(0, 14))] for _ in range(300)] + [[], [40], [1, 40, 1]]
    df = spark.createDataFrame([(k, r, 8 if k % 2 else 11) for k, r in enumerate(rows)], "k int, n array<int>, per int")
    for lines in (2, 4):
        got = {r.k: r.b for r in df.select("k", texts.pada_breaks(F.col("n"), F.col("per"), lines).alias("b")).collect()}
        assert got == {k: plain_breaks(r, 8 if k % 2 else 11, lines) for k, r in enumerate(rows)}
    assert df.select(texts.pada_breaks(F.col("n"), F.lit(None).cast("int")).alias("b")).where("size(b) > 0").count() == 0


# fixed values: a verse, and hearings of it in which something is said again
VERSE = "ये त्वक्षरमनिर्देश्यमव्यक्तं पर्युपासते सर्वत्रगमचिन्त्यञ्च कूटस्थमचलन्ध्रुवम्"
FIRST, HALF = "येत्वक्षरम निर्देश्यम अव्यक्तं", "सर्वत्रगम चिंत्यम्चा"
HEARD = [
    (VERSE, []),
    ("ये त्वक्षरमनिर्देश्यमव्यक्तं पर्युपासते पर्युपासते सर्वत्रगमचिन्त्यञ्च कूटस्थमचलन्ध्रुवम्", [("repeat", "पर्युपासते", None)]),
    ("ये त्वक्षरमनिर्देश्यमव्यक्तं पर्युपासते सर्वत्रगमचिन्त्यञ्च कूटस्थम सर्वत्रगमचिन्त्यञ्च कूटस्थमचलन्ध्रुवम्", [("restart", "सर्वत्रगमचिन्त्यञ्च", 3)]),
    ("ये त्वक्षरमनिर्देश्यमव्यक्तं पर्युपासते ये त्वक्षरमनिर्देश्यमव्यक्तं पर्युपासते सर्वत्रगमचिन्त्यञ्च कूटस्थमचलन्ध्रुवम्", [("restart", "ये", 1)]),
    ("ये त्वक्षरमनिर्देश्यमव्यक्तं हरि पर्युपासते सर्वत्रगमचिन्त्यञ्च कूटस्थमचलन्ध्रुवम्", []),
    ("ಯೇ ತ್ವಕ್ಷರಮನಿರ್ದೇಶ್ಯಮವ್ಯಕ್ತಂ ಪರ್ಯುಪಾಸತೇ ಪರ್ಯುಪಾಸತೇ ಸರ್ವತ್ರಗಮಚಿಂತ್ಯಞ್ಚ ಕೂಟಸ್ಥಮಚಲಂಧ್ರುವಮ್", [("repeat", "ಪರ್ಯುಪಾಸತೇ", None)]),
    (f"{FIRST} पर्युपासते {HALF} {HALF} कूटस्थम चलं थुवं", [("restart", "सर्वत्रगमचिन्त्यञ्च", 3)]),
    (f"{FIRST} पर्युपासते सर्वत्रगम {HALF} कूटस्थम चलं थुवं", [("repeat", "सर्वत्रगम", None)]),
    (f"{FIRST} {FIRST} पर्युपासते {HALF} कूटस्थम चलं थुवं", [("restart", "ये", 1)]),
    (f"{FIRST} पर्युपासते {HALF} कूटस्थम चलं थुवं", []),
    ("येत्वक्षरम निर्देश्यम अव्यक्तं पर्युपासते ससर्वत्रगमचिंत्यम्चा गूटस्थमचलं द्रुवं", []),
]


def takes(spark, rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, heard string, ref string, padas array<int>")
    return df.withColumn("heard", texts.tokens(F.col("heard"))).withColumn("ref", texts.tokens(F.col("ref")))


def test_self_corrections(spark):
    df = takes(spark, [(heard, VERSE, [1, 1, 2, 3, 4]) for heard, _ in HEARD])
    got = {r.k: [(c.kind, c.word, c.pada) for c in r.corrections] for r in C.find_self_corrections(df, "heard", "ref", "padas").collect()}
    assert got == {k: want for k, (_, want) in enumerate(HEARD)}
    other = "भवाप्ययौ हि भूतानां श्रुतौ विस्तरशो मया त्वत्तः कमलपत्राक्ष माहात्म्यमपि चाव्ययम्"
    rows = [("भवप्ययोहिभुतनं सुतवित्तरसोमाशरसोमया त्वत्तः कमलपत्राक्ष माहात्म्यमपि चाव्ययम्", other, None), (None, None, None), ("", "x", []), ("one two three one two three", None, None)]
    got = [r.corrections for r in C.find_self_corrections(takes(spark, rows), "heard", "ref", "padas").orderBy("k").collect()]
    assert got[:3] == [[], [], []] and [(c.kind, c.word, c.at) for c in got[3]] == [("repeat", "one two three", 3)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_repeats(s):
    out = {}
    for i in range(len(s)):
        for size in range(min(60, (len(s) - i) // 2), 4, -1):
            for gap in range(3):
                a, b = s[i : i + size], s[i + size + gap : i + 2 * size + gap]
                if i not in out and len(b) == size and a[:3] == b[:3] and distance(a, b) <= max(1, int(size * 0.15 + 0.5)):
                    out[i] = (size, gap)
    return out


def test_repeats_equal_the_plain_search():
    rng = random.Random(9)
    for letters in ("ab", "abc", "abcdefgh"):
        for _ in range(4):
            s = [rng.choice(letters) for _ in range(60)]
            for _ in range(2):  # something said again, with a change
                at, size = rng.randrange(0, 30), rng.randrange(6, 25)
                again = s[at : at + size]
                again[rng.randrange(3, len(again))] = "x"
                s[at + size : at + size] = ["y"] * rng.randrange(0, 3) + again
            s = "".join(s)
            starts, lengths, gaps = C.repeats(C.codes(s))
            assert dict(zip(starts.tolist(), zip(lengths.tolist(), gaps.tolist()))) == plain_repeats(s), s


def test_place_in_a_text():
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 50)))
        run = "".join(rng.choice("abcd") for _ in range(rng.randrange(5, 20))) if rng.random() < 0.4 or len(text) < 25 else text[10:24].replace("a", "b", 1)
        every = [(distance(run, text[p : p + len(run)]), p) for p in range(len(text)) if p + min(len(run), 4) <= len(text)]
        most = max(1, int(len(run) * 0.3 + 0.5))
        want = min(every)[1] if every and min(every)[0] <= most else -1
        assert C.place_in(C.codes(run), C.codes(text)) == want, (run, text)


def test_repeats_take_linear_time():
    rng = np.random.default_rng(1)
    for letters in (20, 2):  # speech, and little else than seeds
        s = rng.integers(0, letters, 100_000)
        took = []
        for n in (25_000, 100_000):
            began = time.process_time()
            C.repeats(s[:n])
            took.append(time.process_time() - began)
        assert took[1] < 8 * took[0] and took[1] < 120


# fixed values: the end of one text heard at the beginning of the next stretch, and the other way
REF1 = "अर्जुन उवाच मदनुग्रहाय परमं गुह्यमध्यात्मसंज्ञितम् यत्त्वयोक्तं वचस्तेन मोहोऽयं विगतो मम"
REF2 = "भवाप्ययौ हि भूतानां श्रुतौ विस्तरशो मया त्वत्तः कमलपत्राक्ष माहात्म्यमपि चाव्ययम्"


def segment(take, item, start, stop, words, moments, ref):
    return take, item, float(start), float(stop), words.split(), moments, ref.replace("ऽ", "").split()


SEGMENT = "take int, item int, start double, stop double, words array<string>, moments array<double>, ref array<string>"


def test_refined_boundaries(spark):
    one, two = "यत्त्वयोक्तं वचस्तेन", "त्वत्तः कमलपत्राक्ष माहात्म्यमपि चाव्ययम्"
    early = segment(1, 2, 12, 25, f"मोहोयं विगतोमं भवप्ययोहिभुतनं श्रुतविस्तरसोमया {two}", [13.0, 15.0, 17.0, 18.5, 19.5, 21.0, 23.0, 24.5], REF2)
    late = segment(2, 1, 7, 16, f"{one} मोहोयं विगतोमं भवप्ययोहिभुतनं श्रुतविस्तरसोमया", [7.5, 8.5, 9.5, 11.0, 13.0, 15.0], REF1)
    rows = [segment(1, 1, 0.5, 12, one, [8.0, 10.0], REF1), early, late, segment(2, 2, 16, 22, two, [17.0, 18.5, 20.0, 21.5], REF2),
            segment(3, 1, 0, 12, one, [8.0, 10.0], REF1), segment(3, 2, 12, 19, "भवप्ययोहिभुतनं श्रुतविस्तरसोमया", [14.0, 17.0], REF2),  # nothing to move
            segment(4, 1, 0, 8, one, [3.0, 5.0], REF1), segment(4, 2, 12, 25, " ".join(early[4]), early[5], REF2),  # no neighbours
            segment(5, 1, 0, 12, one, [8.0, 10.0], REF1), segment(5, 2, 12, 17.5, " ".join(early[4]), early[5], REF2)]  # beyond the middle
    df = spark.createDataFrame(rows, SEGMENT)
    got = {(r.take, r.item): (r.start, r.stop, r.refined) for r in C.refine_boundaries(df, ["take"]).collect()}
    assert got[1, 1] == (0.5, 16.85, True) and got[1, 2] == (16.85, 25.0, True)
    assert got[2, 1] == (7.0, 12.85, True) and got[2, 2] == (12.85, 22.0, True)
    assert [got[k] for k in ((3, 1), (3, 2), (4, 2), (5, 2))] == [(0.0, 12.0, False), (12.0, 19.0, False), (12.0, 25.0, False), (12.0, 17.5, False)]


def test_boundaries_feed_each_other(spark):
    """The window that a boundary moves is the one that the next boundary is held against."""
    tail, head = "mohoyam vigatomam", "bhavapyayohi"
    ref = [f"{head} sutavistara {tail}", f"{head} sutavistara kamala", f"{head} another text {tail}"]
    rows = [segment(1, 1, 0, 10, f"{head} sutavistara", [2.0, 6.0], ref[0]), segment(1, 2, 10, 20, f"{tail} {head} rest", [11.0, 12.0, 13.0, 18.0], ref[0]),
            segment(1, 3, 20, 30, f"{tail} {head} rest", [21.0, 22.0, 24.0, 28.0], ref[2]), segment(1, 4, 30, 40, "nothing of it", [31.0, 32.0, 33.0], ref[2])]
    df = spark.createDataFrame(rows, SEGMENT)
    got = [(r.start, r.stop, r.refined) for r in C.refine_boundaries(df, ["take"]).orderBy("item").collect()]
    assert got == [(0.0, 12.85, True), (12.85, 23.85, True), (23.85, 30.0, True), (30.0, 40.0, False)]
    empty = spark.createDataFrame([(1, 1, 0.0, 1.0, None, None, None), (2, 1, None, None, [], [], [])], SEGMENT)
    assert C.refine_boundaries(empty, ["take"]).count() == 2


def test_scripts(spark):
    # fixed values: texts and their scripts
    want = {"अर्जुन उवाच": ("Deva", False), "ಅರ್ಜುನ ಉವಾಚ (Arjuna)": ("Knda", False), "Arjuna uvāca evam": ("Latn", True), "": ("Zyyy", False), "12 !": ("Zyyy", False), "क a": ("Deva", False), "a क": ("Latn", False), "అ": ("Telu", False), "ab कि": ("Latn", True), "Ωab": ("Latn", True), None: ("Zyyy", False)}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    script, latin = texts.detect_script(F.col("t"))
    assert {r.t: (r.s, r.m) for r in df.select("t", script.alias("s"), latin.alias("m")).collect()} == want


def test_padas(spark):
    rows = [(1, "a line\nb line\nc line ।\nd line ॥"), (2, "one | \r\n\r\n  two ||\r|\n three"), (3, ""), (4, None), (5, "क ।ख॥ ग"), (6, "\n\n ।")]
    got = {}
    for r in texts.split_padas(spark.createDataFrame(rows, "k int, text string"), ["k"]).orderBy("k", "pada").collect():
        got.setdefault(r.k, []).append((r.pada, r.start, r.stop, r.boundary, r.pada_text, r.licensed))
    assert got[1] == [(1, 0, 7, "pada", "a line", "pada"), (2, 7, 14, "pada", "b line", "pada"), (3, 14, 22, "ardha", "c line", "ardha"), (4, 23, 31, "sloka", "d line", None)]
    assert [(p, t) for p, _, _, _, t, _ in got[2]] == [(1, "one"), (2, "two"), (4, "three")]
    assert got[5] == [(1, 0, 3, "ardha", "क", "ardha"), (2, 3, 5, "sloka", "ख", "sloka"), (3, 5, 7, "pada", "ग", None)] and set(got) == {1, 2, 5}


def test_padas_of_many_words_are_found_in_one_pass(spark):
    """Akṣaras of all words are counted once, not again for each word."""
    words = [random.Random(k).choice(["सर्वत्रगम", "rama", "x", "ये"]) for k in range(1500)]
    df = spark.createDataFrame([(0, words), (1, []), (2, None)], "k int, w array<string>")
    began = time.time()
    got = {r.k: r.p for r in df.select("k", C.padas_of(F.col("w"), 8).alias("p")).collect()}
    assert time.time() - began < 15 and got[1] == [] and got[2] is None
    counts, want = {"सर्वत्रगम": 5, "rama": 2, "x": 1, "ये": 1}, []
    for k in range(len(words)):
        want.append(min(4, sum(counts[w] for w in words[:k]) // 8 + 1))
    assert got[0] == want


def test_repeats_across_pieces_and_of_many_letters():
    rng = random.Random(21)
    said = [chr(0x4E00 + rng.randrange(3000)) for _ in range(C.PLACES - 20)]
    again = [chr(0x100 + k) for k in range(40)]
    s = C.codes("".join(said + again + ["x"] + again[:10] + ["y"] + again[11:] + said[:5] * 2))
    starts, lengths, gaps = C.repeats(s)
    found = dict(zip(starts.tolist(), zip(lengths.tolist(), gaps.tolist())))
    assert found[len(said)][0] in (40, 41) and found[len(s) - 10] == (5, 0)  # 41: with the sound between
    began = time.process_time()
    C.repeats(np.random.default_rng(2).integers(0, 20, 30_000))
    assert time.process_time() - began < 3


def test_turns_are_dealt_out_by_their_number(spark):
    tasks = C.turn_words(spark, SMALL).select(F.spark_partition_id()).distinct().count()
    assert tasks == spark.sparkContext.defaultParallelism
