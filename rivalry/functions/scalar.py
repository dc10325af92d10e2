"""Column expressions for match-up data.

Every function returns a ``Column`` built from Spark built-ins, so it stays
inside whole-stage code generation.  Spark 4 runs in ANSI mode: ``x / 0``
raises, ``pow(0, -1)`` is +inf.  Reciprocals therefore use ``pow(x, -1.0)``
(as the original arithmetic does) and ratios use ``try_divide`` (NULL on a
zero denominator).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def seed_number(seed: str | Column) -> Column:
    """Seed text is a region letter, two digits, optional suffix ("W01",
    "X16a"): the rank is characters 2-3."""
    return F.substring(_c(seed), 2, 2).cast("int")


def target_part(target: str | Column, i: int) -> Column:
    """Part ``i`` (0-based) of a ``season_team1_team2`` id: 0 is the season
    (int), 1 and 2 the team ids (bigint)."""
    part = F.split(_c(target), "_").getItem(i)
    return part.cast("int") if i == 0 else part.cast("bigint")


def target_id(season: str | Column, t1: str | Column, t2: str | Column) -> Column:
    """Build ``season_team1_team2``."""
    return F.concat_ws("_", _c(season).cast("string"), _c(t1).cast("string"), _c(t2).cast("string"))


def seed_diff(lseed: str | Column, wseed: str | Column) -> Column:
    """0 when both seeds are equal, else 1; a missing winner seed counts as
    different."""
    return F.when(_c(lseed).eqNullSafe(_c(wseed)), F.lit(0)).otherwise(F.lit(1))


def inverse_ratio_geomean(r1: str | Column, r2: str | Column) -> Column:
    """Geometric mean of ``r1`` and ``1/r2``: ``(r1 * r2^-1)^0.5``."""
    return F.pow(_c(r1) * F.pow(_c(r2), F.lit(-1.0)), F.lit(0.5))


def harmonic_pair(p1: str | Column, p2: str | Column) -> Column:
    """Harmonic mean of ``p1`` and ``1 - p2``."""
    return F.pow(F.lit(0.5) * F.pow(_c(p1), F.lit(-1.0))
                 + F.lit(0.5) * F.pow(F.lit(1.0) - _c(p2), F.lit(-1.0)), F.lit(-1.0))


def fallback_product(prob1: str | Column, prob2: str | Column) -> Column:
    """``prob1 * (1 - prob2)``; both are per-team harmonic means of the
    team-1 prediction, taken on the team-1 and on the team-2 side."""
    return _c(prob1) * (F.lit(1.0) - _c(prob2))


def pair_key(season: str | Column, t1: str | Column, t2: str | Column) -> Column:
    """Orientation-free contest key ``season_low_high``: both mirrored rows of
    one contest get the same key, so they never straddle a split or fold."""
    return target_id(season, F.least(_c(t1), _c(t2)), F.greatest(_c(t1), _c(t2)))


def split_bucket(key: str | Column, buckets: int) -> Column:
    """Deterministic bucket 0..buckets-1 from the first 32 bits of md5(key).

    Same value in any engine that has md5, and independent of partitioning,
    unlike ``randomSplit``."""
    return (F.conv(F.substring(F.md5(_c(key).cast("string")), 1, 8), 16, 10)
            .cast("bigint") % F.lit(buckets)).cast("int")
