"""Score maps, buckets and small formulas as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Era limits, page weights and outcome scores.
ERAS = {"ancient": 500, "medieval": 1500, "early_modern": 1788, "revolutionary_napoleonic": 1815, "long_nineteenth_century": 1913, "world_wars": 1945, "cold_war": 1991}
PAGE_WEIGHTS = {"battle_article": 1.0, "operation_article": 0.8, "campaign_article": 0.55, "war_conflict_article": 0.35}
OVERLAP_PENALTY = 0.5
OUTCOME_SCORES = {
    "conservative": {"decisive_victory": 1.0, "victory": 0.75, "tactical_victory": 0.6, "pyrrhic_victory": 0.3, "indecisive": 0.0, "draw": 0.0, "stalemate": 0.0, "disputed": 0.0, "defeat": -0.75, "major_defeat": -1.0},
    "balanced": {"decisive_victory": 1.0, "victory": 0.8, "tactical_victory": 0.65, "pyrrhic_victory": 0.25, "indecisive": 0.0, "draw": 0.0, "stalemate": -0.05, "disputed": -0.1, "defeat": -0.8, "major_defeat": -1.0},
    "aggressive": {"decisive_victory": 1.2, "victory": 1.0, "tactical_victory": 0.8, "pyrrhic_victory": 0.1, "indecisive": -0.1, "draw": -0.1, "stalemate": -0.2, "disputed": -0.25, "defeat": -1.0, "major_defeat": -1.25},
}
SHRINK = 5.0
BROAD_CAP = 0.40


def mapped(key: Column, values: Mapping[str, float], default: float = 0.0) -> Column:
    """A literal map lookup."""
    out = F.lit(default)
    for k, v in reversed(list(values.items())):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def ladder(value: Column, steps: list[tuple[float, str]], below: str) -> Column:
    """The label of the first limit that the value reaches, limits from high to low; null reaches none."""
    out = F.lit(below)
    for limit, label in reversed(steps):
        out = F.when(value >= limit, F.lit(label)).otherwise(out)
    return out


def era_bucket(year: Column) -> Column:
    out = F.lit("contemporary")
    for name, limit in reversed(ERAS.items()):
        out = F.when(year <= limit, F.lit(name)).otherwise(out)
    return F.when(year.isNull(), F.lit("unknown")).otherwise(out)


def score_tier(score: Column) -> Column:
    return ladder(score, [(90, "elite"), (80, "very_strong"), (70, "strong"), (60, "solid")], "qualified")


def shrunk(mean: Column, n: Column) -> Column:
    """A mean pulled towards zero by SHRINK pseudo-observations."""
    return F.coalesce(mean, F.lit(0.0)) * n / (n + F.lit(SHRINK))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def cap_factor(broad_share: Column, cap: float = BROAD_CAP) -> Column:
    """What a broad share above the cap leaves of a score: the rest of the evidence and as much broad evidence as the cap allows beside it."""
    share = F.least(F.greatest(broad_share, F.lit(0.0)), F.lit(1.0))
    rest = F.lit(1.0) - share
    held = rest + F.least(share, F.lit(cap / (1 - cap)) * rest)
    return F.when(share <= cap, F.lit(1.0)).otherwise(F.least(F.greatest(held, F.lit(0.0)), F.lit(1.0)))


def steady(x: Column) -> Column:
    """Rounded so that values equal but for the order of their sums also tie."""
    return F.round(x, 9)
