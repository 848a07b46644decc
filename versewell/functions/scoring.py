"""Scores, grades and tolerances of recited items, as column expressions over an item's columns.

An item has seven scores (0 to 100 or null: not judged), for old records content, pronunciation and dynamics
in place of the first ones, ``slips`` array<struct<kind, unsure>> and the flags ``matched`` and ``missing``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories in order with their weights, those of old records, and default tolerances.
WEIGHTS = {"phoneme": 30, "vowel": 25, "syllable": 15, "emphasis": 10, "pitch": 10, "phrasing": 5, "timing": 5}
LEGACY_WEIGHTS = {"content": 80, "pronunciation": 70, "timing": 40, "pitch": 40, "dynamics": 40}
TOLERANCE = {"phoneme": 15, "vowel": 20, "syllable": 10, "emphasis": 60, "pitch": 60, "phrasing": 50, "timing": 60, "content": 10, "pronunciation": 10}
GRADES = (("excellent", 90), ("good", 80), ("fair", 65), ("practice", 0))
SLIP_KINDS = ("restart", "stall", "dropped", "skipped", "falseStart", "repeat", "partial")
SELF_CORRECTIONS = ("restart", "falseStart", "repeat")
QUIZ_CATEGORIES = ("phoneme", "vowel", "syllable")

# what a choice of categories means for records of the other kind
OLD_OF = {"phoneme": ("content", "pronunciation"), "vowel": ("content", "pronunciation"), "syllable": ("content", "pronunciation"), "emphasis": ("dynamics",), "timing": ("timing",), "pitch": ("pitch",), "phrasing": ()}


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def is_legacy() -> Column:
    none = reduce(Column.__and__, [F.col(c).isNull() for c in ("phoneme", "vowel", "syllable")])
    some = reduce(Column.__or__, [F.col(c).isNotNull() for c in ("content", "pronunciation", "dynamics")])
    return none & some


def legacy_categories(categories: tuple[str, ...]) -> tuple[str, ...]:
    """Old categories that stand for a choice of new ones; all if none does."""
    chosen = {old for c in categories for old in OLD_OF[c]}
    return tuple(c for c in LEGACY_WEIGHTS if c in chosen) or tuple(LEGACY_WEIGHTS)


def weighted_mean(weights: dict[str, int]) -> Column:
    """Rounded weighted mean over the judged (non-null) columns; null if none was judged."""
    total = reduce(Column.__add__, [F.coalesce(F.col(c), F.lit(0)) * w for c, w in weights.items()])
    weight = reduce(Column.__add__, [F.when(F.col(c).isNotNull(), w).otherwise(0) for c, w in weights.items()])
    return half_up(F.try_divide(total.cast("double"), weight)).cast("long")


def item_overall(categories: tuple[str, ...] = tuple(WEIGHTS), weights: dict[str, int] = WEIGHTS) -> Column:
    """Overall of an item; any sure self-correction costs 15 per cent, once."""
    old = weighted_mean({c: LEGACY_WEIGHTS[c] for c in legacy_categories(categories)})
    overall = F.when(is_legacy(), old).otherwise(weighted_mean({c: weights[c] for c in categories}))
    corrected = F.exists("slips", lambda s: s["kind"].isin(*SELF_CORRECTIONS) & ~s["unsure"])
    return half_up(overall * F.when(corrected, 1 - 0.15).otherwise(1.0)).cast("long")  # said once: the expression is large


def grade_of(score: Column) -> Column:
    out = F.lit(GRADES[-1][0])
    for name, least in reversed(GRADES[:-1]):
        out = F.when(score >= least, name).otherwise(out)
    return F.when(score.isNotNull(), out)


def grade_with_slips(score: Column, any_slip: Column) -> Column:
    return F.when(score.isNull(), F.lit(None)).when(any_slip, "practice").otherwise(grade_of(score))


def verdict(categories: tuple[str, ...] = QUIZ_CATEGORIES, tolerance: dict[str, int] = TOLERANCE) -> Column:
    """Whether every judged category is within tolerance; null if the item is missing or nothing was judged."""

    def over(cats) -> Column:
        cats = [c for c in cats if c in tolerance]
        judged = reduce(Column.__or__, [F.col(c).isNotNull() for c in cats])
        fine = reduce(Column.__and__, [F.coalesce(100 - F.col(c) <= tolerance[c], F.lit(True)) for c in cats])
        return F.when(judged, fine)

    return F.when(~F.col("missing"), F.when(is_legacy(), over(legacy_categories(categories))).otherwise(over(categories)))


def normalized(value: Column, default: int) -> Column:
    """A weight or tolerance made sane: whole, 0 to 100, the default where it is not a number."""
    ok = value.isNotNull() & ~F.isnan(value.cast("double")) & (F.abs(value.cast("double")) < float("inf"))
    return F.when(ok, F.greatest(F.lit(0), F.least(F.lit(100), half_up(value.cast("double"))))).otherwise(F.lit(default)).cast("long")
