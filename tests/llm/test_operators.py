"""The ten operators on small tables: null, empty, tied, repeated and oddly named input, against brute force."""

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tests.conftest import SMALL, same_as_sql
from versewell.llm import ann, bpe, chat, decontam, language, lm_score, near_dup, registry, secret_scan, sharding, url_filter

LONG = "wort " * 4000
TEXTS = ["One two three four five six seven", "one TWO three four five six seven", "", None, "   ", LONG, LONG, "x", "das ist ein Haus und das ist gut", "été à l'école \U0001f600", "one"]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), i * 2, "k", "w") for i, t in enumerate(TEXTS)]
    rows.append((10, TEXTS[10], None, None, 3, 1, "k", "w"))  # a repeated row, with nulls
    rows.append((None, "a row without an id", "en", "s1", 9, 1, None, None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, key string, word string")


def empty(df):
    return df.where("1 = 0")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    same_as_sql(registry.queries()[name](spark, SMALL), duck, registry.oracle_sql()[name])


# 1 -----------------------------------------------------------------------------------------------------------
def test_lm_score(spark, docs, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD", 5)  # most words take the way through the shuffle
    learn = docs.where("doc_id % 3 <> 1")
    counts = lm_score.count_words(learn)
    got = lm_score.score(docs, counts, lm_score.train(learn, counts)).collect()
    c = Counter(w for r in learn.collect() for w in lm_score.tokens(r.text))
    n, v = sum(c.values()), len(c)
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        words = lm_score.tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(c[w] > 0 for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    assert lm_score.score(empty(docs), counts, lm_score.train(learn, counts)).count() == 0
    none = lm_score.count_words(empty(docs))
    assert {r.n_known for r in lm_score.score(docs, none, lm_score.train(empty(docs), none)).collect()} == {0}


def plain_lm(m, words):
    """The model's log10 probability of words, in plain loops."""
    def mix(x):
        x &= 0xFFFFFFFF
        return ((x ^ x >> 15) * 2654435761) & 0xFFFFFFFF

    def outcome(w):
        k = m.words.index(w) if w in m.words else None
        return k if k is not None and k < lm_score.TOP else lm_score.TOP + zlib.crc32(w) % lm_score.TAIL

    def softmax(row):
        top = [math.exp(x) for x in row]
        return [x / sum(top) for x in top]

    total, mass = 0.0, m.mass.reshape(lm_score.CLASSES, lm_score.MEMBERS) + 0.5
    c = dict(zip(m.words, m.counts.tolist()))
    for k, w in enumerate(words):
        one = zlib.crc32(words[k - 1]) if k else 1
        two = zlib.crc32(words[k - 2]) if k > 1 else 1
        y = outcome(w)
        cls, member = divmod(y, lm_score.MEMBERS)
        of_class, of_member = np.log(mass.sum(1) / mass.sum()), np.log(mass[cls] / mass[cls].sum())
        for f, h in enumerate((mix(one), mix(one * 31 + two), mix(two ^ 0x5BD1E995))):
            of_class = of_class + m.class_w[f * lm_score.BUCKETS + h // (2**32 // lm_score.BUCKETS)]
            salted = ((h ^ (cls * lm_score.FEATURES + f) * 0x9E3779B1 & 0xFFFFFFFF) * 0x85EBCA6B) & 0xFFFFFFFF
            of_member = of_member + m.member_w[salted // (2**32 // lm_score.MEMBER_ROWS)]
        total += math.log10(softmax(of_class)[cls]) + math.log10(softmax(of_member)[member])
        if y >= lm_score.TOP:
            total += math.log10(c.get(w, 0) + 1) - math.log10(m.mass[y] + m.kinds[y] + 1)
    return total


def test_lm_score_by_plain_loops(spark, docs):
    many = " ".join(f"w{k}" for k in range(2000))  # more words than have an outcome of their own
    new = spark.createDataFrame([(90, "one two w3 w1999 unseen three w1700"), (91, "w1 w2 w3 w4 w5")], "doc_id long, text string")
    learn = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(50 + k, many) for k in range(9)], "doc_id long, text string"))
    counts = lm_score.count_words(learn)
    m = lm_score.train(learn, counts)
    assert np.abs(m.class_w).max() > 0.1 and np.abs(m.member_w).max() > 0.1
    both = docs.select("doc_id", "text").unionByName(new)
    texts = {r.doc_id: r.text for r in both.collect()}
    for r in lm_score.score(both, counts, m).collect():
        if texts[r.doc_id] != LONG:
            assert math.isclose(r.score, plain_lm(m, lm_score.tokens(texts[r.doc_id])), rel_tol=1e-4), r


def test_lm_gradient(spark, docs):
    counts, rng = lm_score.count_words(docs), np.random.default_rng(1)
    m = lm_score.train(docs, counts)
    part = [(0, 0, lm_score.tokens("one two three four zebra one two")), (1, 2, [b"one", b"two", *lm_score.tokens("three four")])]
    g = np.zeros((lm_score.CLASSES, len(m.class_w) + len(m.member_w)))
    n = len(m.class_w)
    lm_score.add_gradient(lm_score.Reader(m), part, g[:, :n], g[:, n:])

    def value():
        reader = lm_score.Reader(m)
        _, _, counted, _, y, contexts = reader.read(part)
        p, q = reader.probabilities(y, *reader.rows(contexts, y // lm_score.MEMBERS))
        at = np.arange(len(y))
        return (np.log(p[at, y // lm_score.MEMBERS].astype("f8")) + np.log(q[at, y % lm_score.MEMBERS].astype("f8")))[counted].sum()

    for w, part_of_g in ((m.class_w, g[:, :n].T), (m.member_w, g[:, n:].T)):
        rows = np.flatnonzero(part_of_g.any(1))
        for _ in range(15):
            at = (rng.choice(rows), rng.integers(w.shape[1]))
            old = w[at]
            w[at] = old + 0.05
            up = value()
            w[at] = old - 0.05
            down = value()
            w[at] = old
            assert abs((up - down) / 0.1 - part_of_g[at]) < 5e-3


def test_lm_reads_long_texts_in_stretches(monkeypatch):
    import pyarrow as pa

    texts = ["a bb ccc " * 300, "", None, "x" * 500 + " y", "one two"]
    whole = [lm_score.tokens(t) for t in texts]
    monkeypatch.setattr(lm_score, "SLICE_BYTES", 40)
    parts = [p for held in lm_score._stretches(pa.array(texts)) for p in held]
    for k, words in enumerate(whole):
        mine = [(skip, w) for place, skip, w in parts if place == k]
        assert [x for skip, w in mine for x in w[skip:]] == words
        done = []
        for skip, w in mine:
            assert w[:skip] == (done[-2:] if skip else [])
            done += w[skip:]
    assert len(whole[3][0]) == 32  # a long word goes by its hash


@pytest.mark.parametrize("kind", ["string", "large_string"])
def test_lm_pieces_hold_all_words(monkeypatch, kind):
    import pyarrow as pa

    texts = ["One tWo", None, "", " \t\n", "  a\x0bb\x0c\rc \x1c\x1fd\x85e\xa0f ", "ÉÀ éb\0c", "x" * 33 + " " + "y" * 32, "Z zz " * 30, "", "w " * 200, "Z zz " * 30, "last"]
    for read in (1, 100, 1 << 22):
        monkeypatch.setattr(lm_score, "READ_BYTES", read)
        for slice_bytes in (40, 1 << 19):  # some texts are read in stretches, or none
            monkeypatch.setattr(lm_score, "SLICE_BYTES", slice_bytes)
            for skipped in (0, 3, len(texts)):
                got, before = {}, -1
                for p in lm_score._pieces(pa.array(["before"] * skipped + texts, getattr(pa, kind)()).slice(skipped)):
                    words, counted, at = p.words.to_pylist(), p.counted(), 0
                    for place, length, skip in zip(p.places.tolist(), p.lengths.tolist(), p.skips.tolist()):
                        assert counted[at : at + length].tolist() == [k >= skip for k in range(length)] and place >= before
                        got[place] = got.get(place, []) + words[at + skip : at + length]
                        at, before = at + length, place
                    assert at == len(words)
                assert [got[k] for k in range(len(texts))] == [lm_score.tokens(t) for t in texts]
    assert list(lm_score._pieces(pa.array([], getattr(pa, kind)()))) == []


def test_lm_gradient_takes_less_time_than_by_bincount():
    import time

    import pyarrow as pa

    rng = np.random.default_rng(3)
    vocabulary = np.array([f"w{k}" for k in range(30000)])
    texts = pa.array([" ".join(vocabulary[np.minimum(rng.zipf(1.3, 300), 30000) - 1]) for _ in range(800)])
    counts = Counter(w for t in texts.to_pylist() for w in lm_score.tokens(t)).most_common()
    rows = lm_score.FEATURES * lm_score.BUCKETS
    weights = rng.normal(0, 0.3, (rows + lm_score.MEMBER_ROWS, lm_score.CLASSES)).astype("f4")
    ones = np.ones(lm_score.TOP + lm_score.TAIL)
    m = lm_score.Model(sum(c for _, c in counts), len(counts), [w for w, _ in counts], np.array([c for _, c in counts]), ones, ones, weights[:rows], weights[rows:])
    reader = lm_score.Reader(m)

    def by_bincount(g):
        for part in lm_score._stretches(texts):
            _, _, _, _, y, contexts = reader.read(part)
            own, of_class = reader.rows(contexts, y // lm_score.MEMBERS)
            p, q = (-x for x in reader.probabilities(y, own, of_class))
            p[np.arange(len(y)), y // lm_score.MEMBERS] += 1
            q[np.arange(len(y)), y % lm_score.MEMBERS] += 1
            for to, at, values in ((g[:, :rows], own.ravel(), p), (g[:, rows:], of_class.ravel(), q)):
                for k, column in enumerate(np.ascontiguousarray(values.T, "f8")):
                    to[k] += np.bincount(at, np.tile(column, lm_score.FEATURES), to.shape[1])

    def by_pieces(g):
        for piece in lm_score._pieces(texts):
            lm_score.add_gradient(reader, piece, g[:, :rows], g[:, rows:])

    times, sums = {by_bincount: [], by_pieces: []}, {}
    for _ in range(4):
        for way in times:
            sums[way] = np.zeros((lm_score.CLASSES, rows + lm_score.MEMBER_ROWS), "f4")
            start = time.process_time()
            way(sums[way])
            times[way].append(time.process_time() - start)
    assert np.allclose(sums[by_bincount], sums[by_pieces], rtol=1e-3, atol=0.01)
    assert min(times[by_pieces]) < 0.9 * min(times[by_bincount])


def test_lm_shares_and_checksums_take_less_time_than_plain_ones():
    import time

    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows = lm_score.FEATURES * lm_score.BUCKETS
    weights = rng.normal(0, 0.3, (rows + lm_score.MEMBER_ROWS, lm_score.CLASSES)).astype("f4")
    ones = np.ones(lm_score.TOP + lm_score.TAIL)
    reader = lm_score.Reader(lm_score.Model(9, 1, [b"head"], np.array([9]), ones, ones, weights[:rows], weights[rows:]))
    words = [b"", b"\xff", b"x" * 31 + b"\0", lm_score.END, b"head", *(f"rare{k}\xe9".encode() for k in rng.integers(0, 1 << 40, 100_000))]
    piece = lm_score.Piece(np.arange(1), np.array([len(words)]), np.array([0]), pa.array([b"before", *words], pa.binary()).slice(1))
    crc, bias = np.array([zlib.crc32(w) for w in words], "u4"), [np.log(x) for x in (np.full(32, 1 / 32, "f4"), np.full((32, 32), 1 / 32, "f4"))]
    _, _, _, place, y, contexts = reader.read(piece)
    assert np.flatnonzero(place >= 0).tolist() == [4]
    assert (np.delete(y, 4) == lm_score.TOP + np.delete(crc, 4) % lm_score.TAIL).all()
    own, of_class = reader.rows(contexts, y // lm_score.MEMBERS)

    def read_plain():
        pa.compute.index_in(piece.words, value_set=reader.head)
        return np.fromiter(map(zlib.crc32, piece.words.to_pylist()), "u4", len(words))

    def shares_plain(k):
        p, q = bias[0], bias[1].take(y[k] // lm_score.MEMBERS, 0)
        for f in range(lm_score.FEATURES):
            p, q = p + weights.take(own[f, k], 0), q + weights[rows:].take(of_class[f, k], 0)
        for x in (p, q):
            np.exp(x, out=x)
            x /= x.sum(1, keepdims=True)
        return p, q

    blocks = [slice(k, k + lm_score.BLOCK) for k in range(0, len(words), lm_score.BLOCK)]
    ways = {
        "read plainly": read_plain, "read": lambda: reader.read(piece),
        "plain shares": lambda: [shares_plain(k) for k in blocks], "shares": lambda: [reader.probabilities(y[k], own[:, k], of_class[:, k]) for k in blocks],
    }
    times = {}
    for _ in range(5):
        for name, way in ways.items():
            start = time.process_time()
            way()
            times[name] = min(time.process_time() - start, times.get(name, math.inf))
    for got, plain in zip(reader.probabilities(y[:999], own[:, :999], of_class[:, :999]), shares_plain(slice(999))):
        assert np.allclose(got, plain, rtol=1e-4)
    assert times["read"] < 0.8 * times["read plainly"] and times["shares"] < 0.6 * times["plain shares"], times


def test_lm_frequent_words_are_bounded(spark):
    counts = spark.range(5000).select(F.encode(F.concat(F.lit("w"), "id"), "utf-8").alias("word"), F.when(F.col("id") < 10, 900).otherwise(7).alias("c"))
    some = lm_score.frequent(counts, 1000)
    assert 600 < some.count() <= 1000 and some.where("c = 900").count() == 10 and lm_score.frequent(counts, 9000).count() == 5000


def test_lm_learns(spark):
    got = registry.queries()["op1_lm_score"](spark, SMALL).groupBy("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).collect()
    assert all(r.s > r.b for r in got)  # better than the unigram base, on held-out texts too


def test_lm_prefers_what_it_saw(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    follow = {w: words[k - 1] for k, w in enumerate(words)}
    rows = []
    for k in range(400):
        w, said = rng.choice(words), []
        for _ in range(60):
            said.append(w)
            w = follow[w] if rng.random() < 0.8 else rng.choice(words)
        rows.append((k, " ".join(said)))
    learn = spark.createDataFrame(rows, "doc_id long, text string")
    counts = lm_score.count_words(learn)
    chain = ["w3"]
    while len(chain) < 30:
        chain.append(follow[chain[-1]])
    odd = rng.sample(chain, len(chain))  # the same words in another order
    new = spark.createDataFrame([(1, " ".join(chain)), (2, " ".join(odd))], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.score(new, counts, lm_score.train(learn, counts)).collect()}
    assert math.isclose(got[1].base_score, got[2].base_score, rel_tol=1e-9) and got[1].score > got[2].score + 5


# 2 -----------------------------------------------------------------------------------------------------------
def test_url_rules(spark):
    urls = {
        "https://A.net/x": ("a.net", "/x", "net/", "block"), "http://www.example.net/en/1?q": ("www.example.net", "/en/1", "example.net/en/", "allow"), "http://a.net": ("a.net", "", None, "allow"),
        "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"), "http://cheap-pills.example.com/": ("cheap-pills.example.com", "/", None, "block"),
        "http://planet/": ("planet", "/", None, "allow"), "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "x://Ö.ORG/fr/é#y": ("Ö.org", "/fr/é", "org/fr/", "allow"),
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    host, path = url_filter.host_and_path(F.col("url"))
    df = df.select("url", host.alias("host"), path.alias("path"))
    out = url_filter.mark_listed(df, "host", url_filter.listed_hosts(df), "listed")
    rule, verdict = url_filter.rule_of(F.col("host"), F.col("path"))
    got = out.select("url", "host", "path", rule.alias("r"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("v"))
    assert {r.url: tuple(r)[1:] for r in got.collect()} == urls


@pytest.mark.parametrize("bits", [1 << 25, 4096])  # one cascade, and shards
def test_cascade_is_exact(spark, bits):
    df = spark.range(3000).select(F.concat(F.lit("h"), F.col("id") % 1500).alias("key"), "id", F.lit("x").alias("on"))
    is_listed = F.crc32(F.col("key").cast("binary")) % 3 == 0
    listed = df.where(is_listed).select("key").unionByName(spark.createDataFrame([(None,), ("elsewhere",), ("y" * 1_000_000,)], "key string"))
    out = url_filter.mark_listed(df, "key", listed, "on", bits).select("key", "on", F.col("id"))
    assert out.count() == 3000 and out.where(F.col("on") != is_listed).count() == 0
    assert url_filter.mark_listed(df, "key", empty(listed), "on").where("on").count() == 0
    assert url_filter.mark_listed(empty(df), "key", listed, "on").count() == 0
    odd = spark.createDataFrame([(None,), ("",), ("y" * 1_000_000,), ("y" * 999_999,), ("z",), ("z",)], "key string")
    got = url_filter.mark_listed(odd, "key", spark.createDataFrame([("",), ("y" * 1_000_000,)], "key string"), "on").collect()
    assert sorted((len(r.key or ""), r.on) for r in got) == [(0, True), (0, True), (1, False), (1, False), (999_999, False), (1_000_000, True)]


# 3 -----------------------------------------------------------------------------------------------------------
def test_infix_distance():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(lo, 14))] for lo in (1, 0))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert decontam.infix_distance(a, b)[0] == min(row)


def test_decontamination(spark, duck, monkeypatch):
    items = duck.sql("SELECT item_id, text FROM benchmark").fetchall()
    rng, rows, want = random.Random(5), [], set()
    filler = [w for (t,) in duck.sql("SELECT text FROM documents WHERE lang = 'de' LIMIT 30").fetchall() for w in t.split()]
    for k, (item, text) in enumerate(items):
        words = text.upper().split() if k % 2 else text.split()
        for _ in range(len(words) // 8):
            words[rng.randrange(len(words))] = "zzz"
        rows.append((k, " ".join([*filler[k : k + 60], *words, *filler[k : k + 9]])))
        want.add((k, item))
    rows += [(900, ""), (901, None), (902, " ".join(filler[:500])), (None, items[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, item_words string, edits int")
    bench = spark.createDataFrame([*items, (7000, None), (7001, ""), (7002, "two words"), items[0]], "item_id long, text string")
    got = decontam.contaminated(docs, bench)
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert len(want - found) <= 0.02 * len(want) and (None, items[0][0]) in found and not {d for d, _ in found} & {900, 901, 902}
    kept = {r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()}
    assert {900, 901, 902} <= kept and len(kept - {900, 901, 902}) <= 0.02 * len(want)
    assert decontam.contaminated(empty(docs), bench).count() == 0 and decontam.contaminated(docs, empty(bench)).count() == 0
    assert decontam.drop_contaminated(docs, empty(bench)).columns == docs.columns
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 4000)  # several blocks give the same
    assert sorted(map(tuple, decontam.contaminated(docs, bench).collect()), key=str) == sorted(map(tuple, got.collect()), key=str)
    assert {r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()} == kept


def test_decontamination_recall(duck):
    items = [(i, decontam.words_of(t)) for i, t in duck.sql("SELECT item_id, text FROM benchmark").fetchall()]
    items = [(i, w) for i, w in items if len(w) >= 20]
    index, rng, hit, n = decontam.Index(items), random.Random(1), 0, 0
    for i, w in items * 4:
        x = list(w)
        for _ in range(len(w) // 5):
            p = rng.randrange(len(x))
            x[p : p + 1] = rng.choice([[b"qq"], [], [x[p], b"rr"]])
        hit += any(k == i for _, k, _, _ in index.hits([" ".join(y.decode() for y in x)], 0.8))
        n += 1
    assert hit >= 0.97 * n


def test_decontamination_of_short_items():
    rng, words = random.Random(7), [f"w{i}" for i in range(300)]
    for n in (*range(1, 46), 60, 80):
        items = [(i, [rng.choice(words).encode() for _ in range(n)]) for i in range(40)]
        index, missed = decontam.Index(items), 0
        for k, (i, w) in enumerate(items):
            x = list(w)
            for e in range(n // 5):  # in the first words, in the last ones or anywhere
                p = (min(e, len(x) - 1), max(len(x) - 1 - e, 0), rng.randrange(len(x)))[k % 3]
                x[p : p + 1] = rng.choice([[b"qq"], [], [x[p], b"rr"]])
            text = " ".join([*rng.choices(words, k=k % 4), *(y.decode() for y in x), *rng.choices(words, k=k % 3)])
            missed += not any(found == i for _, found, _, _ in index.hits(["", "w1 w2", text, "w3"], 0.8))
        assert missed <= (0 if n < decontam.LONG else 1), n


def test_decontamination_of_short_items_is_exact(duck):
    texts = [t for (t,) in duck.sql("SELECT text FROM documents ORDER BY doc_id LIMIT 40").fetchall()]
    docs, rng = [decontam.words_of(t) for t in texts], random.Random(8)
    whole = [d for d in docs if len(d) > 40]
    cuts = [(n, rng.choice(whole)) for n in (1, 2, 3, 4, 5, 6, 9, 10, 14, 15, 19, 24, 30) for _ in range(3)]
    items = [(i, d[10 : 10 + n]) for i, (n, d) in enumerate(cuts)]
    want = [(k, i, len(w), e) for k, d in enumerate(docs) for i, w in items if (e := decontam.infix_distance(w, d)[0]) <= len(w) // 5]
    assert decontam.Index(items).hits(texts, 0.8) == want and len(want) > len(items)


# 4 -----------------------------------------------------------------------------------------------------------
def test_language_gradients():
    net, rng = language.Model(["a", "b", "c"]), np.random.default_rng(0)
    seq, lang, weight = rng.integers(1, 255, (7, 4)), np.array([0, 1, 1, 2]), np.array([1, 0.5, 2, 1])
    seq[5:, 1] = 0  # padding
    net.w = {k: v.astype("f8") for k, v in net.w.items()}

    def loss():
        f, b = net._layers()
        p = net._distributions(f.run(seq), b.run(np.ascontiguousarray(seq[::-1]))[::-1])
        each = -np.log(p[:, lang, np.arange(4)]) * (seq > 0) * weight
        return each.sum() / ((seq > 0) * weight).sum()

    grad = net.step(seq, lang, weight)
    for k in grad:
        assert grad[k].shape == net.w[k].shape
        for _ in range(12):
            at = tuple(rng.integers(n) for n in net.w[k].shape)
            at = (seq[rng.integers(5), rng.integers(4)], at[1]) if k.startswith("in") else at  # a byte that occurs
            old = net.w[k][at]
            net.w[k][at] = old + 1e-5
            up = loss()
            net.w[k][at] = old - 1e-5
            down = loss()
            net.w[k][at] = old
            assert abs((up - down) / 2e-5 - grad[k][at]) < 1e-7, (k, at)


def plain_language(net, text):
    """The network in plain loops, over the whole text at once."""
    n, sig = language.HIDDEN, lambda x: 1 / (1 + math.exp(-x))

    def states(d, data):
        w, u, h, out = net.w["in" + d].tolist(), net.w["u" + d].tolist(), [0.0] * n, []
        for byte in data:
            dot = [sum(h[i] * u[i][j] for i in range(n)) for j in range(3 * n)]
            x = w[byte]
            z, r = ([sig(x[a + j] + dot[a + j]) for j in range(n)] for a in (0, n))
            c = [math.tanh(x[2 * n + j] + r[j] * dot[2 * n + j]) for j in range(n)]
            h = [a + g * (b - a) for a, g, b in zip(h, z, c)]
            out.append(h)
        return out

    found = []
    for f, b in zip(states("f", text), states("b", text[::-1])[::-1]):
        raw = [math.exp(sum(f[i] * net.w["outf"][i, k] + b[i] * net.w["outb"][i, k] for i in range(n)) + net.w["bias"][k]) for k in range(len(net.langs))]
        found.append([x / sum(raw) for x in raw])
    return np.array(found)


def test_language_forward(duck):
    net = language.Model(["a", "b", "c"])
    texts = [t.encode()[:400] for (t,) in duck.sql("SELECT text FROM documents ORDER BY doc_id LIMIT 4").fetchall()]
    for text, p in zip(texts, net.pooled(texts)):
        assert np.allclose(net.positions(text), plain_language(net, text), atol=1e-4) and np.allclose(p, plain_language(net, text).mean(0), atol=1e-4)
    long = texts[0] * 4  # several stretches: their states are warmed up
    assert len(long) > 2 * language.WINDOW and np.abs(net.positions(long) - plain_language(net, long)).max() < 0.02


def test_language(spark, docs):
    out = registry.queries()["op4_language"](spark, SMALL)
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    j = out.join(truth, "doc_id").where("held_out").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"))
    assert j.agg(F.avg("ok")).first()[0] > 0.9
    model = language.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    assert got[2] == got[3] == got[4] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values()) and got[0][0] == "en"
    assert language.fit(empty(docs)) is None and {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(empty(docs), model).count() == 0
    assert language.identify(docs, model).columns == [*docs.columns, "lang_pred", "score"]


def test_language_labels_every_position(spark):
    net = language.Model(["a", "b"])
    assert net.positions(b"x" * 150).shape == (150, 2)
    big = b"hello " * 200_000
    assert np.allclose(net.pooled([b"", big, b"x"])[1], net.positions(big).mean(0, dtype="f8"), atol=1e-4) and not net.pooled([b"", b"x"])[0].any()


def test_language_samples_whole_texts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 64)
    monkeypatch.setattr(language, "MOST_LANGS", 3)
    monkeypatch.setattr(language, "STEPS", 2)
    seen = {}
    monkeypatch.setattr(language.Model, "train", lambda self, pieces, lang: seen.update(langs=self.langs, pieces=pieces) or self)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(900)), f"l{i % 5}") for i in range(25)] + [(90 + i, "a b", f"junk{i}") for i in range(50)]
    language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    ends = {int(w.rsplit("x", 1)[1]) for p in seen["pieces"] for w in p.decode().split()[1:-1]}
    assert seen["langs"] == ["l0", "l1", "l2"] and 20 < len(seen["pieces"]) < 150 and max(ends) > 800


# 5 -----------------------------------------------------------------------------------------------------------
def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "<\\/s>", "[\\INST]", "<", "</s", "[ROLE]x[/ROLE] ", "\\\\</s>\\", "", None, "a\nb", "[/INST] <s>", LONG]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "assistant", "first"), (3, 0, "tool[/ROLE] ", "odd"), (3, 1, None, "none"), (4, None, "user", "b"), (4, None, "user", "a"), (None, 0, "user", "x"), (5, 0, "user", "twice"), (5, 0, "user", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1))
    got = {r.conv_id: r for r in chat.format_chats(df).withColumn("read", chat.read_back(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in got[1].read] == [(r, t or "") for _, _, r, t in rows[: len(nasty)]]
    assert [(t.role, t.text) for t in got[3].read] == [("tool[/ROLE] ", "odd"), ("", "none")]
    assert [t.text for t in got[4].read] == ["a", "b"] and len(got[5].read) == 2
    assert got[1].valid and not got[2].valid and got[2].bad_turn == 0 and not got[3].valid and not got[5].valid
    assert "".join(s.text for s in got[1].segments) == got[1].formatted
    assert [s.text for s in got[2].segments if s.loss] == ["first"]
    assert chat.format_chats(empty(df)).count() == 0


# 6 -----------------------------------------------------------------------------------------------------------
def brute_components(rows, words):
    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) or frozenset([tuple(w)] if w else [])

    sets = {i: grams(t) for i, t in rows}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates(spark, duck, docs, monkeypatch):
    rng = random.Random(9)
    base = [w for (t,) in duck.sql("SELECT text FROM documents ORDER BY doc_id LIMIT 5").fetchall() for w in t.split()]
    rows = []
    for k in range(220):  # a large group around the threshold, exact copies among it, and loners
        w = base[:120] if k % 3 else base[k : k + 60]
        for _ in range(rng.randint(0, 16) if k % 3 else 0):
            w = list(w)
            w[rng.randrange(len(w))] = f"z{rng.randrange(40)}"
        rows.append((k, " ".join(w)))
    rows += [(300 + i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(*r, "x", 0, 1) for r in [*rows, rows[3]]], "doc_id long, text string, key string, n int, comp int")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, 5).collect()} == brute_components(rows, 5)
    monkeypatch.setattr(near_dup, "LEAST_HOT", 3)  # the ways of hot keys and classes, and several blocks
    monkeypatch.setattr(near_dup, "HOT", 0)
    monkeypatch.setattr(near_dup, "BLOCK", 5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, 2).collect()} == brute_components(rows, 2)
    twice = df.unionByName(df.where("doc_id IN (3, 4)").withColumn("text", F.lit(rows[9][1])))  # an id of several texts
    got = near_dup.near_duplicates(twice, 2).collect()
    assert len(got) == twice.count() and len({(r.doc_id, r.component_id) for r in got if r.doc_id in (3, 4)}) == 2
    null_id = near_dup.near_duplicates(docs, 2).where("doc_id IS NULL").collect()
    assert [r.component_id for r in null_id] == [None]
    assert near_dup.near_duplicates(empty(docs)).count() == 0


def test_near_duplicates_query(spark, duck):
    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in registry.queries()["op6_near_dup"](spark, SMALL).collect()}
    assert got == brute_components(rows, 2)


# 7 -----------------------------------------------------------------------------------------------------------
def test_sharding(spark, docs):
    many = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.lit(1).alias("rank"))
    got = sharding.interleave(many).collect()
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    hot = Counter(r.shard for r in got if r.source == "hot")
    assert max(hot.values()) - min(hot.values()) <= 2  # the mixture holds in every shard
    few = sharding.interleave(docs)
    assert few.count() == docs.count() and few.columns == [*docs.columns, "shard", "slot"] and {r.slot for r in few.collect()} == {0}
    assert sharding.interleave(empty(docs)).count() == 0


def test_sharding_in_many_buckets_and_slices(spark, monkeypatch):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.pmod(F.xxhash64("id"), F.lit(90)))).alias("source"))
    want = {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(rows).collect()}
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 23)  # sources smaller and larger than the number of slices
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(rows).collect()} == want


# 8 -----------------------------------------------------------------------------------------------------------
def test_nearest(spark, duck):
    rows = duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    bad = [(9001, None), (9002, [0.0] * 64), (9003, [None, *[1.0] * 63]), (9004, [float("nan")] * 64), (9005, [float("inf"), *[1.0] * 63]), (9006, [1.0] * 3), (None, [1.0] * 64)]
    same = [(10000 + k, [9.0] * 64) for k in range(60)]  # one common vector: ties go to smaller ids
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in [*rows, *bad, *same, rows[0]]], "vec_id long, embedding array<float>, id int, code int")
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [*rows, *same]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good], "f8")
    hit = n = 0
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q, found in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and found == sorted(found, key=lambda f: (-f[2], f[1]))
        assert all(math.isclose(f[2], s[ids == f[1]][0], rel_tol=1e-9) for f in found)
        hit += len({f[1] for f in found} & set(ids[best].tolist()))
        n += 20
    assert hit >= 0.95 * n
    few = ann.search(df.where("vec_id < 5"), F.col("vec_id") == 0)
    assert few.count() == 4 and ann.search(empty(df), F.col("vec_id") == 0).count() == 0


def test_nearest_beside_many_copies(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=32)
    far, close = rng.normal(size=(1500, 32)), centre + 0.2 * rng.normal(size=(150, 32))
    x = np.concatenate([far, close, np.repeat(centre[None], 3000, 0)]).astype("f4")
    ids = rng.permutation(len(x))
    df = spark.createDataFrame(list(zip(ids.tolist(), x.tolist())), "vec_id long, embedding array<float>")
    asked = {*ids[1500:1650:5].tolist(), *ids[1650:1660].tolist(), *ids[:30].tolist()}
    got: dict = {}
    for r in ann.search(df, F.col("vec_id").isin(*asked)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x, hit = x.astype("f8"), 0
    assert set(got) == asked
    for q, found in got.items():
        s = sum(x[:, j] * x[ids == q][0][j] for j in range(32))
        s[ids == q] = -np.inf
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(f[2] == s[ids == f[1]][0] for f in found)
        hit += len({f[1] for f in found} & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hit >= 0.99 * 20 * len(asked)


# 9 -----------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, docs, duck, tiktoken_encoding):
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    b = bpe.ByteBpe.get(vocabulary, public_tokenizers.PATTERN)
    rng, texts = random.Random(2), [t or "" for t in TEXTS]
    for alphabet in ("ab ", "=- ", " \n\t", "eéèê'", "schi ", "的了中文 ", "аеион ", "\U0001f600\u200d ", "\U00016ea7\U0003fb27a1 "):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts += [t for (t,) in duck.sql("SELECT text FROM documents").fetchall()]
    for text, ids in zip(texts, b.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tiktoken_encoding.encode_ordinary(text)
        assert b.decode(ids).decode() == text
        starts, ends = b.offsets(ids)
        assert (starts < ends).all() and (not text or (starts[0] == 0 and ends[-1] == len(text)))
    out = bpe.encode(docs, vocabulary, public_tokenizers.PATTERN)
    back = bpe.decode(out.select("text", "bpe.ids"), vocabulary, public_tokenizers.PATTERN)
    assert out.columns == [*docs.columns, "bpe"] and all(r.decoded == (r.text or "") for r in back.collect())
    assert bpe.decode(spark.createDataFrame([([172],), (None,)], "ids array<int>"), vocabulary, public_tokenizers.PATTERN).collect()[0].decoded == "\ufffd"
    for r in bpe.digests(docs, vocabulary, public_tokenizers.PATTERN, ids=True).collect():
        ids = tiktoken_encoding.encode_ordinary(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        at, places, char_of = 0, [[], []], [k for k, c in enumerate(r.text or "") for _ in c.encode()]
        for i in ids:
            end = at + len(tiktoken_encoding.decode_single_token_bytes(i))
            places[0].append(char_of[at])
            places[1].append(char_of[end - 1] + 1)
            at = end
        assert r.offsets_sha256 == hashlib.sha256(np.array(sum(places, []), "<u4").tobytes()).hexdigest()
    big = "schön 的 wort " * 150_000  # two megabytes
    [ids] = b.encode([big])
    assert np.frombuffer(ids, "<u4").tolist() == tiktoken_encoding.encode_ordinary(big) and b.decode(ids).decode() == big
    assert bpe.digests(empty(docs), vocabulary, public_tokenizers.PATTERN).count() == 0


# 10 ----------------------------------------------------------------------------------------------------------
def brute_spans(text):
    kinds = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))
    found = [(k, m.start(), m.end()) for k, e, g, n in kinds for m in e.finditer(text) if m.end(g) - m.start(g) >= n]
    return sorted(found, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def test_secrets(spark, docs, duck):
    rng, body = random.Random(6), "Zk" * 15
    good, bad = f"ghp_{body}{secret_scan.checksum(body)}", f"ghp_{body}000000"
    parts = ["password", "PassWd", "secret", "token", "api_key", "apikey", ":", "=", " ", '"', "'", "abcdef", "x1", "é", "ſecret", "İ", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "\n", good, bad, "="]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += [t for (t,) in duck.sql("SELECT text FROM documents").fetchall()]
    for t in texts:
        assert [s for s in secret_scan.scan(t) if s[0] in secret_scan.BASE] == brute_spans(t)
    assert [s[0] for s in secret_scan.scan(f"é {good} {bad}")] == ["git"] and secret_scan.scan(f"é {good}")[0][1:] == (2, 42)
    hexes = "é 0123456789abcdef0123456789abcdef\n" * 120_000  # four megabytes in a moment
    assert secret_scan.scan(hexes)[-1] == ("hex", 35 * 119_999 + 2, 35 * 120_000 - 1)
    assert secret_scan.masked(f"é token={good} end") == "é [assign+git] end" and secret_scan.masked("clean") == "clean"
    out = secret_scan.find_secrets(docs)
    assert out.columns == [*docs.columns, "secrets"] and out.where("size(secrets) > 0").count() == 0
    assert secret_scan.mask_secrets(docs).collect() == docs.collect() and secret_scan.mask_secrets(empty(docs)).count() == 0
    for r in registry.queries()["op10_secrets"](spark, SMALL).collect():
        text = duck.sql(f"SELECT text FROM documents WHERE doc_id = {r.doc_id}").fetchall()[0][0]
        base = brute_spans(text)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in secret_scan.BASE)


def test_outputs_replace_columns_of_their_name(spark, docs):
    clash = docs.select("*", *[F.lit("old").alias(c) for c in ("Score", "lang_pred", "n_tokens", "ids", "shard", "slot", "n_known", "bpe", "secrets", "listed")])
    counts = lm_score.count_words(clash)
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    for out in (
        lm_score.score(clash, counts, lm_score.train(clash, counts)), language.identify(clash, language.Model(["a"])), language.identify(clash, None), sharding.interleave(clash),
        bpe.digests(clash, vocabulary, public_tokenizers.PATTERN, ids=True), bpe.encode(clash, vocabulary, public_tokenizers.PATTERN), secret_scan.find_secrets(clash), url_filter.mark_listed(clash, "text", empty(clash.select(F.col("text").alias("key"))), "listed"),
    ):
        assert out.count() == docs.count() and len({c.lower() for c in out.columns}) == len(out.columns)


def test_held_out_is_the_crc(spark):
    from versewell.llm.common import held_out

    got = {r.id for r in spark.range(200).where(held_out(F.col("id"), 7, 2)).collect()}
    assert got == {i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2}
    assert json.dumps(sorted(got))
