"""Score normalisation expressions (column-level, JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimal places kept for computed doubles so that sums taken in different
# orders (Spark partitions vs. DuckDB) compare equal.
ROUND_DIGITS = 10


def rnd(c: Column | str, digits: int = ROUND_DIGITS) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def normalized_regret(score: Column | str, min_score: Column | str, max_score: Column | str) -> Column:
    """``|max - s| / |min - max|``: 0 for the dataset's best score, 1 for its worst.

    A dataset whose scores are all equal has no spread; every row is then the
    best one and gets regret 0 (the reference divides by zero there).
    """
    s, lo, hi = (F.col(x) if isinstance(x, str) else x for x in (score, min_score, max_score))
    return F.when(hi == lo, F.lit(0.0)).otherwise(F.abs(hi - s) / F.abs(lo - hi))


def ranking_score(regret: Column | str, higher_is_better: bool = True) -> Column:
    """``1 - regret`` when a higher metric is better, else the regret itself."""
    r = F.col(regret) if isinstance(regret, str) else regret
    return (F.lit(1.0) - r) if higher_is_better else r


def regret_or_one(regret: Column | str) -> Column:
    """Missing or NaN results count as the worst regret, 1."""
    r = F.col(regret) if isinstance(regret, str) else regret
    return F.when(r.isNull() | F.isnan(r), F.lit(1.0)).otherwise(r)


def finite_or_zero(x: Column | str) -> Column:
    """NaN, +inf and -inf become 0; null stays null."""
    c = F.col(x) if isinstance(x, str) else x
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(c)


# Scores at or above this bound are treated as invalid.
VALID_SCORE_BOUND = 1e6


def valid_score(score: Column | str) -> Column:
    """Predicate for a usable score: not null, finite, below 1e6."""
    s = F.col(score) if isinstance(score, str) else score
    return s.isNotNull() & ~F.isnan(s) & (s < F.lit(VALID_SCORE_BOUND)) & (s > F.lit(float("-inf")))
