"""Prefix trie, token alignment and Jaccard join against brute force, with odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tests.conftest import SMALL
from versewell.llm import align_tokens, jaccard_join, near_dup, prefix_trie

LONG = "wort " * 40_000


# 11 ----------------------------------------------------------------------------------------------------------
def n_words(text):
    return len(text.encode().split())


def brute_trie(convs):
    """Nodes of {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[x] for x in children[path]) or 1
        own = (len(members[path]) - 1) * n_words(path[-1][1]) if path else 0
        saved[path] = own + sum(saved[x] for x in children[path])
    out = []
    for path, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(path))
        up = min(members[path[:-1]]) if path else None
        out.append((min(m), len(path), up, len(m), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def brute_shared(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return out


def as_rows(convs):
    return [(c, k, role, text) for c, turns in convs.items() for k, (role, text) in enumerate(turns)]


def got_trie(df, **more):
    return sorted([tuple(r) for r in prefix_trie.prefix_trie(df, **more).collect()], key=str)


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("shards", [1, 7])
def test_trie(spark, shards):
    rng = random.Random(shards)
    convs = {c: [(rng.choice("ua"), rng.choice(["one two", "x", "", "a\tb c"])) for _ in range(rng.randrange(1, 6))] for c in range(0, 130, rng.choice([1, 2]))}
    convs |= {1000 + k: [("u", "hot one"), ("a", "and two")] for k in range(60)}  # a group of copies, over several shards
    convs[5000] = [("u", f"turn {k}") for k in range(700)]
    convs[5001] = convs[5000][:650] + [("u", "other end")]
    convs[9_007_199_254_740_993] = [("u", LONG)] * 3
    df = spark.createDataFrame(as_rows(convs), TURNS).repartition(5)
    plain = prefix_trie.sequences(df)
    assert got_trie(plain, shards=shards) == brute_trie(convs)
    assert got_trie(prefix_trie.share_beginnings(plain), shards=shards) == brute_trie(brute_shared(convs))


def test_trie_of_odd_rows(spark):
    rows = [(1, None, "user", "first"), (1, 2, None, "b"), (1, 1, "user", None), (None, 0, "user", "gone"), (2, 0, "user", "first"), (2, 1, "user", ""), (2, 2, "", "b"), (2, 2, "", "b"), (39, 5, "u", "only")]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS seq", "'k' AS `key`", "2 AS depth")
    convs = {1: [("user", "first"), ("user", ""), ("", "b")], 2: [("user", "first"), ("user", ""), ("", "b"), ("", "b")], 39: [("u", "only")]}
    assert got_trie(prefix_trie.sequences(df)) == brute_trie(convs)
    assert zlib.crc32(b"39") % 4 > 0  # it loses its only turn, and conversation 20 is absent: a turnless member of the root
    shared = brute_shared(convs)
    assert shared[39] == [] and got_trie(prefix_trie.share_beginnings(prefix_trie.sequences(df))) == brute_trie(shared)
    assert got_trie(prefix_trie.sequences(df.where("1 = 0"))) == []


def test_trie_is_balanced():
    tree, words = prefix_trie.Tree(), sorted(random.Random(1).sample(range(10**6), 1023))
    for k in prefix_trie.medians(len(words)):
        tree.insert([words[k]])
    def height(at):
        return 0 if at < 0 else 1 + max(height(tree.less[at]), height(tree.more[at]))
    assert sorted(prefix_trie.medians(1000)) == list(range(1000)) and height(tree.below[0]) == 10


# 12 ----------------------------------------------------------------------------------------------------------
FILES = [align_tokens.read_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
ODD = ["a▁b", "  two  spaces ", "tab\tnew\n\n line  \n x", "</s> <|endoftext|> hi", "日本語 の テキスト 😀😀 \U0001fae8", "x" * 500, "é a b", "  ", "\n", " ", "a  ", "don't  we'll", None, "", "foo\n \nbar",
       "foo \n x", "a   b", "foo    x", "x \x1c y", "a \x85 　b", "\r\n\x00 \x1f z", "١٢٣ ३४५ १२", LONG, "same text here", "same text here", "Ġ \n  \t q ", "<0x0A> <unk> ▁", "<0x41> b"]


@pytest.fixture(scope="module")
def pair():
    return align_tokens.Pair.get(*FILES)


def brute_alignment(pair, text):
    """Groups and links of one text, by walking over its bytes."""
    if not text:
        return [], []
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    if not b"".join(pair.a_bytes[i] for i in a) == b"".join(pair.b_bytes[i] for i in b) == (" " + text).encode():
        return [], []
    groups, links, left, right, i, j, at_a, at_b = [], [], [], [], 0, 0, 0, 0
    while i < len(a):
        links.append((a[i], b[j]))
        end_a, end_b = at_a + len(pair.a_bytes[a[i]]), at_b + len(pair.b_bytes[b[j]])
        if end_a <= end_b:
            left.append(a[i])
            i, at_a = i + 1, end_a
        if end_b <= end_a:
            right.append(b[j])
            j, at_b = j + 1, end_b
        if end_a == end_b:
            groups.append((left, right))
            left, right = [], []
    return groups, links


def test_chunks_encode_as_the_whole(pair, duck):
    assert pair.cuts
    texts = ODD + [t for t, in duck.sql("SELECT text FROM documents LIMIT 150").fetchall()]
    rng = random.Random(3)
    texts += ["".join(rng.choice([" ", " ", "\n", "\t", "a", "the", "é", "1", ".", " ", "▁", "'s"]) for _ in range(30)) for _ in range(400)]
    for t in texts:
        a, n_a, b, n_b = pair.encode([t])
        groups, _ = brute_alignment(pair, t)
        assert a.tolist() == [i for x, _ in groups for i in x] and b.tolist() == [i for _, x in groups for i in x], t
        assert (n_a[0], n_b[0]) == (len(a), len(b))


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64, 4096])
def test_merge_in_pieces(piece):
    rng = np.random.default_rng(piece)
    for _ in range(30):
        total = int(rng.integers(1, 300))
        a, b = (np.unique(np.append(rng.integers(1, total + 1, rng.integers(1, 100)), total)) for _ in "ab")
        path = align_tokens.merge_path(a, b, piece)
        steps = np.arange(0, len(a) + len(b) + piece, piece).clip(max=len(a) + len(b))
        both = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
        assert path.tolist() == [sum(side == 0 for _, side in both[:k]) for k in steps]
        in_a, in_b, common = align_tokens.merge(a, b, piece)
        ends = np.union1d(a, b)
        assert in_a.tolist() == np.searchsorted(a, ends).tolist() and in_b.tolist() == np.searchsorted(b, ends).tolist()
        assert common.tolist() == [x in a and x in b for x in ends]


@pytest.mark.parametrize("block", [3, 1_000_000])
def test_alignment(spark, duck, pair, block):
    texts = ODD + ([t for t, in duck.sql("SELECT text FROM documents LIMIT 80").fetchall()] if block > 3 else [])
    if block == 3:
        texts = ["the same words", "the same words", "ab", None, "a▁b"]
    rows = [(k, t, k * 2, "n") for k, t in enumerate(texts)] + [(None, "no id", 0, "n"), (0, texts[0], 1, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_links long, `key` string")
    every = [(i, *brute_alignment(pair, t)) for i, t, *_ in rows]
    counts = Counter(x for _, _, links in every for x in links)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    want = []
    for i, groups, links in every:
        printed = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        want.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links),
                     sum(counts[x] for x in links), hashlib.sha256(printed.encode()).hexdigest() if printed else ""))
    got = align_tokens.align(df, *FILES, block=block)
    assert got.columns == ["doc_id", "key", *align_tokens.OUT]
    assert sorted([tuple(r) for r in got.drop("key").collect()], key=str) == sorted(want, key=str)


def test_alignment_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in align_tokens.align(df, *FILES).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    assert align_tokens.align(df.where("1 = 0"), *FILES).count() == 0
    assert align_tokens.op12_align_tokens(spark, SMALL).where("n_a = 0").count() == spark.read.parquet(f"{SMALL}/documents.parquet").where("coalesce(text, '') = '' OR text LIKE '%▁%'").count()


# 13 ----------------------------------------------------------------------------------------------------------
def grams(text, words=3):
    w = [x.lower() for x in (text or "").encode().split()]
    return {tuple(w[k : k + words]) for k in range(max(len(w) - words + 1, min(len(w), 1)))}


def brute_components(rows, percent=90):
    """(id, number of shingles, smallest reachable id) of (id, text) rows; the texts of one id are linked."""
    sets = [(i, grams(t)) for i, t in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for k, (i, x) in enumerate(sets):
        for m in range(k):
            j, y = sets[m]
            if i is None or j is None or not x or not y:
                continue
            if i == j or 100 * len(x & y) >= percent * len(x | y):
                up[max(top(k), top(m))] = min(top(k), top(m))
    least = {}
    for k, (i, x) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, len(x), i if i is None or not x else least[top(k)]) for k, (i, x) in enumerate(sets)), key=str)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def family(rng, n):
    """Texts of n words in a row of steps, so that links go through others, and some just below the threshold."""
    words = [f"w{rng.randrange(10**5)}" for _ in range(n)]
    out = []
    for edits in (0, 0, 1, 1, 2, n // 60, n // 50, n // 40, n // 30):
        out.append(edited(rng, words, edits))
        if rng.random() < 0.5:
            words = out[-1].split()
    return [*out, " ".join(words[: n - n // 12]), " ".join([*words, *words[: n // 20]])]


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_join(spark, monkeypatch, seed):
    rng = random.Random(seed)
    texts = [t for n in (2, 3, 8, 11, 12, 25, 60, 61, 100, 180, 400, 1500) for t in family(rng, n)]
    texts += ["", None, "   ", "one", "One", "one two", "A b C", "a B c", LONG, LONG + "x", "\x1c a b", "hot copy of a text that many hold"] + ["hot copy of a text that many hold"] * 40
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(None, texts[0]), (None, None), (3, texts[3]), (5, texts[9])]  # repeated ids
    if seed:
        monkeypatch.setattr(jaccard_join, "BLOCK", 3)
        monkeypatch.setattr(near_dup, "LEAST_HOT", 4)
        monkeypatch.setattr(near_dup, "HOT", 0)
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, id long, `key` string")
    got = sorted([tuple(r) for r in jaccard_join.jaccard_components(df).collect()], key=str)
    assert got == brute_components(rows)
    assert jaccard_join.jaccard_components(df.where("1 = 0")).count() == 0


def test_texts_of_one_id_are_linked(spark):
    a, b = "one two three four five", "six seven eight nine ten"
    for rows in ([(1, a), (1, b), (2, a), (3, b)], [(5, b), (5, a), (2, a), (7, b), (9, a), (9, b)], [(1, a), (1, b)], [(0, a), (1, a), (1, b), (4, "x y z")]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted([tuple(r) for r in jaccard_join.jaccard_components(df).collect()], key=str) == brute_components(rows), rows


def test_no_link_is_missed_by_tiles_and_bitmaps():
    """Random pairs of sets at the threshold share a tile's key, and their bitmaps allow them."""
    rng = np.random.default_rng(7)
    near = 0
    for _ in range(400):
        n, percent = int(rng.integers(1, 2500)), int(rng.choice([80, 90, 95]))
        apart = jaccard_join.most_apart(2 * n, percent)
        pool = rng.integers(0, 1 << 63, n + apart + 2, dtype="u8") * np.uint64(2)
        gone, more = int(rng.integers(0, apart + 2)), int(rng.integers(0, apart + 2))
        x, y = np.unique(pool[:n]), np.unique(np.concatenate([pool[min(gone, n - 1) : n], pool[n : n + more]]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= percent * (len(x) + len(y) - both):
            near += 1
            assert set(jaccard_join.keys_of(x, percent)) & set(jaccard_join.keys_of(y, percent))
            bits = [jaccard_join.bitmap(s) for s in (x, y)]
            two = jaccard_join.folded(bits, min(map(len, bits)))
            assert jaccard_join.may_link(np.int64(len(x)), np.int64(len(y)), np.bitwise_count(two[0] ^ two[1]).sum(), percent)
    assert near > 100


def test_bitmaps_drop_what_cannot_link():
    rng = np.random.default_rng(8)
    for n in (60, 500, 5000):
        pool = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype="u8"))
        x, y = pool[:n], pool[n // 3 : n + n // 3]  # half of the union is common
        two = jaccard_join.folded([jaccard_join.bitmap(x), jaccard_join.bitmap(y)], len(jaccard_join.bitmap(x)))
        assert not jaccard_join.may_link(np.int64(n), np.int64(n), np.bitwise_count(two[0] ^ two[1]).sum(), 90)


def test_bands():
    sizes = [jaccard_join.band_of(n) for n in range(1, 3000)]
    assert sizes == sorted(sizes) and all(jaccard_join.band_top(jaccard_join.band_of(n)) >= n for n in range(1, 3000))
