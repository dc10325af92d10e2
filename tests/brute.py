"""Brute-force references for small inputs."""

from rivalry.operators.pairs import side_stats


def season_pair_stats(medians):
    """The original per-season product of team-1 and team-2 statistics: every
    (team1, team2) pair of a season."""
    return side_stats(medians, 1).join(side_stats(medians, 2), ["Season"], "inner")
