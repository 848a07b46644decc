"""Restarts heard in a live take: sound after a pause that is a start which the count has already passed.

Frames of a take are folded in time order. After a pause the next frames are gathered until a template's length; their
nearest start decides. The take's own mean is taken off, as recordings have theirs taken off. A start that comes next is
the recitation going on; one well behind is a restart of that pāda, and the first one a false start; a doubtful match
is none. Positions are akṣaras.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame

from versewell.functions import warping as T
from versewell.streaming.ordered import Row, fold

BEGUN, INTO, LEAST_INTO = 0.25, 0.75, 3
OUT = "take long, at double, kind string, pada int, was int, position int"


def decide(rows: np.ndarray, templates: list[tuple[int, np.ndarray]], threshold: float | None, padas: list[int], was: int, since: int, speaker: int = 0) -> tuple[str, int, int] | None:
    """(kind, pāda, position now) of the sound after a pause at position ``was``, ``since`` akṣaras ago; None: go on.

    ``templates``: (pāda, frames); ``padas``: akṣaras of each; ``speaker``: those of a line before them (pāda 0).
    """
    near = sorted((T.start_distance(rows, t), k) for k, (_, t) in enumerate(templates))
    if not near or threshold is None or near[0][0] > threshold:
        return None
    if len(near) > 1 and near[0][0] > 0 and near[1][0] / near[0][0] < T.MARGIN_OVER:
        return None
    pada = templates[near[0][1]][0]
    if pada == (0 if speaker else 1):
        total = speaker + sum(padas)
        return ("falseStart", pada, since) if was >= BEGUN * total else None
    begins = speaker + sum(padas[: pada - 1])
    if was < begins + max(LEAST_INTO, INTO * padas[pada - 1]):
        return None
    return "restart", pada, begins + since


def restarts(frames: DataFrame, known: Broadcast, pause: float, length: int = T.TEMPLATE, least: int = T.LEAST_TEMPLATE, **more) -> DataFrame:
    """OUT for a stream of frames (take, at, number, frame array<double>, aksharas int).

    ``known.value``: function of the take's key to (templates, threshold, padas, speaker), bounded by the library of
    texts that is recited from. ``pause``: seconds without frames after which sound is looked at.
    """

    def step(take: int, state: dict, row: Row) -> tuple[dict, list]:
        frame, aksharas = np.array(row.values[0]), row.values[1]
        said: list = []

        def judge() -> None:
            held, state["held"] = state["held"], None
            if held and len(held["rows"]) >= least:
                templates, threshold, padas, speaker = known.value(take)
                mean = np.array(state["sum"]) / state["n"]
                since = state["count"] - held["was"]
                found = decide(np.array(held["rows"]) - mean, templates, threshold, padas, held["was"], since, speaker)
                if found:
                    state["count"] = found[2]
                    said.append((take, held["at"], found[0], found[1], held["was"], found[2]))

        if state["last"] is not None and row.at - state["last"] >= pause:
            judge()  # what there was of the sound before
            if state["count"]:
                state["held"] = {"at": row.at, "was": state["count"], "rows": []}
        state |= {"last": row.at, "n": state["n"] + 1, "sum": (np.array(state["sum"] or np.zeros(len(frame))) + frame).tolist(), "count": state["count"] + aksharas}
        if state["held"]:
            state["held"]["rows"].append(frame.tolist())
            if len(state["held"]["rows"]) == length:
                judge()
        return state, said

    start = {"last": None, "n": 0, "sum": None, "count": 0, "held": None}
    return fold(frames, "take", ["frame", "aksharas"], OUT, start, step, **more)
