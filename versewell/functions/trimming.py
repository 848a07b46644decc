"""Where a recording sounds, and the recording without the silence around it; at any rate."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from versewell.functions.features import activity_level, latch, mended, percentile, runs

# Milliseconds kept around the sound and faded at a cut, of gaps, sounds and clicks, and of the room.
KEEP_BEFORE, KEEP_AFTER, FADE, LEAST_CUT = 120, 220, 8, 50
GAP, LEAST_RUN, CLICK, CLICK_GAP = 120, 60, 150, 300
SETTLING, BREATH, LEAST_ROOM, OVER_ROOM_DB, LOUD_DB, UNDER_PEAK_DB, QUIET_DB = 150, 300, 400, 8, 20, 12, -60


def sounding_part(x: np.ndarray, rate: int) -> tuple[int, int] | None:
    """First and last sample of the sound; None where there is none.

    The threshold is that of the activity of frames, raised over the room: what stands before the first and after the
    last loud frame, less the microphone's settling and a breath. Short sounds far from the rest are clicks.
    """
    hop, window = max(1, int(rate * 0.01 + 0.5)), max(1, int(rate * 0.02 + 0.5))
    if not len(x):
        return None
    padded = np.pad(x, (0, max(0, window - len(x))))
    power = sliding_window_view(padded, window)[::hop]
    db = np.concatenate([20 * np.log10(np.sqrt((power[k : k + 4096] ** 2).mean(1)) + 1e-9) for k in range(0, len(power), 4096)])
    frames = lambda ms: max(1, ms // 10)
    threshold, _, peak = activity_level(db, x, frames=30, over_floor=8, under_peak=40, hop=hop, rate=rate)
    loud = np.flatnonzero(db >= peak - LOUD_DB)
    if len(loud):
        edges = slice(frames(SETTLING), max(0, loud[0] - frames(BREATH))), slice(loud[-1] + frames(BREATH) + 1, max(0, len(db) - frames(SETTLING)))
        room = np.concatenate([db[e] for e in edges])
        if len(room) >= frames(LEAST_ROOM):
            threshold = max(threshold, min(percentile(room, 0.5) + OVER_ROOM_DB, peak - UNDER_PEAK_DB))
    found = runs(mended(latch(db >= threshold, db < threshold - 3), frames(GAP), frames(LEAST_RUN))).tolist()
    short = lambda r: r[1] - r[0] < frames(CLICK)
    while len(found) > 1 and short(found[0]) and found[1][0] - found[0][1] + 1 > frames(CLICK_GAP):
        found.pop(0)
    while len(found) > 1 and short(found[-1]) and found[-1][0] - found[-2][1] + 1 > frames(CLICK_GAP):
        found.pop()
    if not found or peak < QUIET_DB:
        return None
    return found[0][0] * hop, min(len(x), (found[-1][1] - 1) * hop + window)


def trimmed(x: np.ndarray, rate: int) -> tuple[np.ndarray, int, int, bool]:
    """(samples, first, end, changed): cut around the sound and faded at each cut; as it was where little would go."""
    part = sounding_part(x, rate)
    if part is None:
        return x, 0, len(x), False
    start, stop = max(0, int(part[0] - KEEP_BEFORE / 1000 * rate + 0.5)), min(len(x), int(part[1] + KEEP_AFTER / 1000 * rate + 0.5))
    if start < LEAST_CUT / 1000 * rate and len(x) - stop < LEAST_CUT / 1000 * rate:
        return x, 0, len(x), False
    y = x[start:stop].copy()
    fade = min(int(FADE / 1000 * rate + 0.5), len(y) // 2)
    ramp = np.arange(fade) / max(fade, 1)
    if start:
        y[:fade] *= ramp
    if stop < len(x):
        y[len(y) - fade :] *= ramp[::-1]
    return y, start, stop, True
