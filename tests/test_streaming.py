"""The nucleus follower, and folds that must not depend on how rows arrive."""

import datetime
import random

import numpy as np

from versewell.operators import reports
from versewell.streaming import awards, live, ordered, restarts


def test_nuclei_of_a_swinging_level():
    state, n = (0.0, 0.0, False, 0), 0
    for level in [-30, -10, -30, -12, -13, -12, -30, -10, -11]:
        state, counted = live.nucleus(state, level)
        n += counted
    assert n == state[3] == 2  # the wobble of 1 dB is none, the last one has not fallen yet


def rows_of_take(rng, n=400):
    at, out = 1_700_000_000.0, []
    for k in range(n):
        at += rng.choice([0.02] * 30 + [2.0])
        out.append((1 + k % 3, at, k, round(rng.random(), 3)))
    return out


def test_ordered_fold_does_not_depend_on_arrival(spark, tmp_path):
    """Several batches in shuffled order equal one fold in time order; the state goes away after its takes."""
    rng = random.Random(3)
    rows = rows_of_take(rng)

    def step(key, state, row):
        total, n = state
        total, n = total * 0.9 + row.values[0], n + 1
        return (total, n), [(key, n, row.at, total)] if n % 5 == 0 else []

    want = []
    for key in (1, 2, 3):
        state = (0.0, 0)
        for k, at, n, v in rows:
            if k == key:
                state, said = step(key, state, ordered.Row(at, n, [v]))
                want += said
    shuffled = rows[:]
    rng.shuffle(shuffled)
    kind = "key long, at timestamp, event_id long, value double"
    for part in range(8):
        some = [(k, datetime.datetime.fromtimestamp(at, datetime.UTC), n, v) for k, at, n, v in shuffled[part::8]]
        spark.createDataFrame(some, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for idle in (None, 60.0):
        seen, tick = ordered.with_ticks(stream, str(tmp_path / f"ticks{idle}"))
        out = ordered.fold(seen, "key", ["value"], "key long, n long, at double, total double", (0.0, 0), step, "1 hour", idle)
        got = live.drain(out, ["key", "n"], "append", then=lambda: tick(datetime.datetime(2024, 6, 1, tzinfo=datetime.UTC)))
        assert sorted((r.key, r.n, round(r.at, 3), round(r.total, 9)) for r in got.collect()) == sorted((k, n, round(at, 3), round(t, 9)) for k, n, at, t in want)


def test_restart_decisions():
    rng = np.random.default_rng(1)
    starts = [(k, rng.normal(size=(20, 12)) * 4) for k in (1, 2, 3, 4)]
    heard = lambda k: starts[k - 1][1] + rng.normal(size=(20, 12)) * 0.2
    say = lambda k, was, since=2, limit=3.0, known=starts: restarts.decide(heard(k), known, limit, [8] * 4, was, since)
    assert say(3, 24) == ("restart", 3, 18) and say(3, 16) is None and say(3, 21) is None and say(3, 22) == ("restart", 3, 18)
    assert say(1, 20) == ("falseStart", 1, 2) and say(1, 7) is None and say(1, 8) == ("falseStart", 1, 2)
    assert say(2, 30, limit=0.01) is None and say(2, 30, limit=None) is None and say(2, 30, known=[]) is None
    assert say(2, 30, known=[*starts, (4, starts[1][1])]) is None  # two starts sound alike
    assert restarts.decide(heard(2), starts, 3.0, [8] * 4, 30, 0, speaker=6) == ("restart", 2, 14)
    assert restarts.decide(starts[0][1], [(0, starts[0][1]), *starts[1:]], 3.0, [8] * 4, 30, 1, speaker=6) == ("falseStart", 0, 1)


def test_restarts_in_a_live_take(spark, tmp_path):
    """Pādas 1, 2, 3, then 2 again after a pause, 3, 4; frames come shuffled in five batches."""
    rng = np.random.default_rng(2)
    starts = {k: rng.normal(size=(8, 12)) * 4 for k in (1, 2, 3, 4)}
    rows, at, n = [], 1_700_000_000.0, 0
    for pada in (1, 2, 3, 2, 3, 4):
        at += 3.0
        for k in range(16):  # a pāda of eight akṣaras, one every other frame
            frame = (starts[pada][k] if k < 8 else np.zeros(12)) + rng.normal(size=12) * 0.1
            rows.append((7, datetime.datetime.fromtimestamp(at, datetime.UTC), n, frame.tolist(), k % 2))
            at, n = at + 0.02, n + 1
    kind = "take long, at timestamp, event_id long, frame array<double>, aksharas int"
    order = rng.permutation(len(rows))
    for part in range(5):
        spark.createDataFrame([rows[k] for k in order[part::5]], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    known = spark.sparkContext.broadcast(live.Fixed(([(k, s - np.mean([x for v in starts.values() for x in v], 0) * 0.5) for k, s in starts.items()], 6.0, [8] * 4, 0)))
    seen, tick = ordered.with_ticks(stream, str(tmp_path / "ticks"))
    out = restarts.restarts(seen, known, 1.0, 8, 3, delay="1 hour")
    got = live.drain(out, ["take", "at"], "append", then=lambda: tick(datetime.datetime(2024, 6, 1, tzinfo=datetime.UTC)))
    assert [(r.kind, r.pada, r.was, r.position) for r in got.collect()] == [("restart", 2, 24, 12)]


def test_awards_of_batches(spark, tmp_path):
    rng = random.Random(4)
    day = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(k)
    rows = [(learner, quiz, day(k), datetime.datetime(2024, 1, 1, rng.randrange(24), tzinfo=datetime.UTC) + datetime.timedelta(k), 1000 * learner + 100 * quiz + k * 2 + twice)
            for learner in range(12) for quiz in range(2) for k in sorted(rng.sample(range(40), rng.randrange(0, 13))) for twice in range(rng.randrange(1, 3))]
    rng.shuffle(rows)
    batches = [rows[k::5] for k in range(5)]
    top = str(tmp_path / "badges")
    run = awards.award(top, 4)
    frame = lambda b: spark.createDataFrame(b, awards.COUNTED)
    want = []
    before = {}
    for k, b in enumerate(batches):
        run(frame(b), k)
        so_far = [r for x in batches[: k + 1] for r in x]
        now = {}
        for learner, quiz in {r[:2] for r in so_far}:
            n = len({r[2] for r in so_far if r[:2] == (learner, quiz)})
            if level := sum(n >= x for x in (3, 5, 10)):
                now[learner, quiz] = level
        want += [(k, *key, level, "raised" if key in before else "earned", before.get(key)) for key, level in now.items() if level > before.get(key, 0)]
        before = now
    said = lambda: sorted(((r.batch, r.learner, r.quiz, r.level, r.change, r.from_level) for r in awards.awards(top, spark).collect()), key=str)
    assert said() == sorted(want, key=str) and {(r.learner, r.quiz): r.level for r in awards.badges(top, spark).collect()} == before
    run(frame(batches[-1]), 4)  # a batch that is run again changes nothing
    run(frame(batches[3]), 3)
    assert said() == sorted(want, key=str) and {(r.learner, r.quiz): r.level for r in awards.badges(top, spark).collect()} == before
    run(frame(batches[0]), 5)  # attempts that were counted already award nothing
    assert said() == sorted(want, key=str)
    run(frame([]), 6)
    assert {(r.learner, r.quiz): r.level for r in awards.badges(top, spark).collect()} == before


def test_rule_of_badges(spark):
    kind = "assessment long, matched boolean, missing boolean, slips array<struct<kind string, unsure boolean>>"
    items = spark.createDataFrame([(1, True, False, []), (1, True, False, []), (2, True, False, [("stall", True)]), (3, True, True, []), (4, False, False, []), (5, None, False, []), (6, True, False, None)], kind)
    assert [r.assessment for r in reports.clean_attempts(items).collect()] == [1]
    h = spark.createDataFrame([(k, "quiz" if k < 4 else "teach", 90 if k != 3 else 89) for k in range(1, 6)], "assessment long, kind string, overall int")
    assert sorted(r.assessment for r in reports.qualified(h).collect()) == [1, 2]
    assert [r.assessment for r in reports.qualified(h, clean=reports.clean_attempts(items)).collect()] == [1]
