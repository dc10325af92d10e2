"""Contest enrichment and mirroring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as fx


def parse_seeds(seeds: DataFrame) -> DataFrame:
    """Add ``seed_int`` (characters 2-3 of ``Seed``)."""
    return seeds.withColumn("seed_int", fx.seed_number("Seed"))


def seed_join(contests: DataFrame, seeds: DataFrame) -> DataFrame:
    """Attach the winner's seed (left join: an unseeded winner keeps its
    contest with ``WSeed`` NULL) and the loser's seed (inner join: a contest
    whose loser has no seed is dropped), then ``DiffSeed``.

    ``seeds`` grows with teams x seasons, so no broadcast is forced: AQE turns
    the join into a broadcast at runtime when the materialised side is under
    ``spark.sql.autoBroadcastJoinThreshold``, else keeps the sort-merge join
    and splits skewed partitions (a team in a third of all contests).
    """
    s = parse_seeds(seeds).select("Season", "TeamID", "seed_int")
    ws = s.select("Season", F.col("TeamID").alias("WTeamID"), F.col("seed_int").alias("WSeed"))
    ls = s.select("Season", F.col("TeamID").alias("LTeamID"), F.col("seed_int").alias("LSeed"))
    out = (contests.join(ws, ["Season", "WTeamID"], "left")
           .join(ls, ["Season", "LTeamID"], "inner"))
    return out.withColumn("DiffSeed", fx.seed_diff("LSeed", "WSeed"))


def mirror_contests(enriched: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Two labelled rows per contest: the winner's view (``Result`` 1.0) and
    the loser's view (``Result`` 0.0), then score ratio, total and share.

    One scan and a generator (``inline`` of a two-element array) instead of a
    union of two scans.  ``keep`` names extra columns to carry unchanged.
    """
    def view(t1, t2, s1, s2, result):
        return F.struct(F.col("Season").alias("Season"), F.col(t1).alias("TeamID1"), F.col(t2).alias("TeamID2"),
                        F.col(s1).alias("Team1_Score"), F.col(s2).alias("Team2_Score"),
                        F.col("NumOT").alias("NumOT"), F.col("DiffSeed").alias("DiffSeed"),
                        F.lit(result).alias("Result"), *[F.col(k).alias(k) for k in keep])

    rows = enriched.select(F.inline(F.array(
        view("WTeamID", "LTeamID", "WScore", "LScore", 1.0),
        view("LTeamID", "WTeamID", "LScore", "WScore", 0.0))))
    return score_features(rows)


def score_features(rows: DataFrame) -> DataFrame:
    """``Score_Ratio`` (NULL for a zero denominator), ``Score_Total``,
    ``Score_Pct``."""
    total = F.col("Team1_Score") + F.col("Team2_Score")
    return (rows.withColumn("Score_Ratio", F.try_divide(F.col("Team1_Score"), F.col("Team2_Score")))
            .withColumn("Score_Total", total)
            .withColumn("Score_Pct", F.try_divide(F.col("Team1_Score"), total)))


def mirror_pairs(season_contests: DataFrame) -> DataFrame:
    """Score-free mirror: (team1, team2, pred) with pred 1 for the winner's
    view and 0 for the loser's."""
    return season_contests.select(F.inline(F.array(
        F.struct(F.col("WTeamID").alias("team1"), F.col("LTeamID").alias("team2"), F.lit(1).alias("pred")),
        F.struct(F.col("LTeamID").alias("team1"), F.col("WTeamID").alias("team2"), F.lit(0).alias("pred")))))


def season_filter(df: DataFrame, seasons: Sequence[int], col: str = "Season") -> DataFrame:
    return df.where(F.col(col).isin(list(seasons)))
