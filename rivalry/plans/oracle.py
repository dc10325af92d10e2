"""Oracle SQL (DuckDB dialect) for the registered queries.

Each string runs on the raw parquet tables (views ``lineitem``, ``orders``,
...) and repeats the fixture derivation and the operator in plain SQL, so a
second engine checks every relational query.  Floating results are rounded
to 6 places, like the Spark side.
"""

from __future__ import annotations

from ..defaults import EPS_TEST, EPS_TRAIN
from ..sources.fixtures import TARGET_SEASONS

_SEASONS = ", ".join(str(s) for s in TARGET_SEASONS)

_PODIUM = """
podium AS (
  SELECT l_orderkey, team, score, qty, place FROM (
    SELECT l_orderkey, l_suppkey AS team, max(l_extendedprice) AS score, max(l_quantity) AS qty,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY max(l_extendedprice) DESC, l_suppkey) AS place
    FROM lineitem GROUP BY l_orderkey, l_suppkey) x)"""

_CONTESTS = """
contests AS (
  SELECT CAST(year(o.o_orderdate) AS INTEGER) AS Season, a.team AS WTeamID, a.score AS WScore,
         b.team AS LTeamID, b.score AS LScore, 'N' AS WLoc,
         CAST(CAST(a.qty + b.qty AS INTEGER) % 3 AS INTEGER) AS NumOT
  FROM podium a
  JOIN podium b ON a.l_orderkey = b.l_orderkey AND a.place = 1 AND b.place = 2 AND a.score > b.score
  JOIN orders o ON a.l_orderkey = o.o_orderkey)"""

_SEEDS = """
rev AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS Season, l_suppkey AS TeamID,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS r
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
rk AS (
  SELECT *, row_number() OVER (PARTITION BY Season ORDER BY r DESC, TeamID) AS rk,
         count(*) OVER (PARTITION BY Season) AS n FROM rev),
seeds AS (
  SELECT Season, TeamID,
         concat(CASE (rk - 1) % 4 WHEN 0 THEN 'W' WHEN 1 THEN 'X' WHEN 2 THEN 'Y' ELSE 'Z' END,
                lpad(CAST(CAST(floor((rk - 1) / 4) AS INTEGER) % 16 + 1 AS VARCHAR), 2, '0'),
                CASE WHEN rk * 100 > n * 60 THEN 'a' ELSE '' END) AS Seed
  FROM rk WHERE rk * 100 <= n * 68)"""

_TARGETS = f"""
targets AS (
  SELECT DISTINCT concat(CAST(Season AS VARCHAR), '_', CAST(TeamID1 AS VARCHAR), '_', CAST(TeamID2 AS VARCHAR)) AS ID,
         CAST(0.5 AS DOUBLE) AS Pred
  FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS Season,
               least(a.team, b.team) AS TeamID1, greatest(a.team, b.team) AS TeamID2
        FROM podium a JOIN podium b ON a.l_orderkey = b.l_orderkey AND a.place + 1 = b.place
        JOIN orders ON a.l_orderkey = o_orderkey
        WHERE year(o_orderdate) IN ({_SEASONS})) p)"""

_PIPE = f"""
seeds_p AS (SELECT Season, TeamID, Seed, CAST(substr(Seed, 2, 2) AS INTEGER) AS seed_int FROM seeds),
enriched AS (
  SELECT c.Season, c.LTeamID, c.WTeamID, c.WScore, c.LScore, c.WLoc, c.NumOT,
         w.seed_int AS WSeed, l.seed_int AS LSeed,
         CASE WHEN l.seed_int IS NOT DISTINCT FROM w.seed_int THEN 0 ELSE 1 END AS DiffSeed
  FROM contests c
  LEFT JOIN seeds_p w ON c.Season = w.Season AND c.WTeamID = w.TeamID
  JOIN seeds_p l ON c.Season = l.Season AND c.LTeamID = l.TeamID),
mirrored AS (
  SELECT Season, WTeamID AS TeamID1, LTeamID AS TeamID2, WScore AS Team1_Score, LScore AS Team2_Score,
         NumOT, DiffSeed, CAST(1.0 AS DOUBLE) AS Result FROM enriched
  UNION ALL
  SELECT Season, LTeamID, WTeamID, LScore, WScore, NumOT, DiffSeed, CAST(0.0 AS DOUBLE) FROM enriched),
train AS (
  SELECT *, Team1_Score / nullif(Team2_Score, 0) AS Score_Ratio, Team1_Score + Team2_Score AS Score_Total,
         Team1_Score / nullif(Team1_Score + Team2_Score, 0) AS Score_Pct FROM mirrored),
tgt AS (
  SELECT ID, Pred, CAST(split_part(ID, '_', 1) AS INTEGER) AS Season,
         CAST(split_part(ID, '_', 2) AS BIGINT) AS TeamID1, CAST(split_part(ID, '_', 3) AS BIGINT) AS TeamID2
  FROM targets),
observed AS (
  SELECT t.* FROM train t
  JOIN tgt ON t.Season = tgt.Season AND t.TeamID1 = tgt.TeamID1 AND t.TeamID2 = tgt.TeamID2
  WHERE t.Season IN ({_SEASONS})),
missing AS (
  SELECT TeamID1, TeamID2, Season FROM tgt
  WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.Season IN ({_SEASONS}) AND t.Season = tgt.Season
                    AND t.TeamID1 = tgt.TeamID1 AND t.TeamID2 = tgt.TeamID2)),
m1 AS (
  SELECT Season, TeamID1, median(CAST(NumOT AS DOUBLE)) AS NumOT1, median(Score_Ratio) AS Score_Ratio1,
         median(Score_Pct) AS Score_Pct1 FROM observed GROUP BY Season, TeamID1),
m2 AS (
  SELECT Season, TeamID2, median(CAST(NumOT AS DOUBLE)) AS NumOT2, median(Score_Ratio) AS Score_Ratio2,
         median(Score_Pct) AS Score_Pct2 FROM observed GROUP BY Season, TeamID2),
test AS (
  SELECT m.Season, m.TeamID1, m.TeamID2,
         round_even(NumOT1 + NumOT2, 0) AS NumOT,
         pow(Score_Ratio1 * pow(Score_Ratio2, -1.0), 0.5) AS Score_Ratio,
         pow(0.5 * pow(Score_Pct1, -1.0) + 0.5 * pow(1.0 - Score_Pct2, -1.0), -1.0) AS Score_Pct
  FROM missing m
  JOIN m1 ON m.Season = m1.Season AND m.TeamID1 = m1.TeamID1
  JOIN m2 ON m.Season = m2.Season AND m.TeamID2 = m2.TeamID2),
preds AS (
  SELECT Season, TeamID1, TeamID2, Score_Pct AS Pred1 FROM test
  UNION ALL SELECT Season, TeamID1, TeamID2, Score_Pct FROM observed),
sub AS (
  SELECT tgt.ID, tgt.Pred, tgt.Season, tgt.TeamID1, tgt.TeamID2, p.Pred1 FROM tgt
  LEFT JOIN preds p ON tgt.Season = p.Season AND tgt.TeamID1 = p.TeamID1 AND tgt.TeamID2 = p.TeamID2),
p1 AS (SELECT TeamID1, coalesce(pow(avg(pow(Pred1, -1.0)), -1.0), 0.5) AS prob1 FROM sub GROUP BY TeamID1),
p2 AS (SELECT TeamID2, coalesce(pow(avg(pow(Pred1, -1.0)), -1.0), 0.5) AS prob2 FROM sub GROUP BY TeamID2),
final AS (
  SELECT sub.TeamID2, sub.TeamID1, sub.ID, sub.Season, sub.Pred1, p1.prob1, p2.prob2,
         coalesce(sub.Pred1, p1.prob1 * (1.0 - p2.prob2)) AS Pred
  FROM sub LEFT JOIN p1 ON sub.TeamID1 = p1.TeamID1 LEFT JOIN p2 ON sub.TeamID2 = p2.TeamID2),
funion AS (
  SELECT Season, TeamID1, TeamID2, CAST(NumOT AS DOUBLE) AS NumOT, Score_Ratio, Score_Pct,
         CAST(Result AS DOUBLE) AS Result, true AS is_train FROM observed
  UNION ALL
  SELECT Season, TeamID1, TeamID2, CAST(NumOT AS DOUBLE), Score_Ratio, Score_Pct, CAST(NULL AS DOUBLE), false FROM test)"""

# medians as of a season: all rows of earlier seasons, by either side
_PRIOR = f"""
asked AS (SELECT unnest([{_SEASONS}]) AS S),
b1 AS (
  SELECT CAST(S AS INTEGER) AS Season, TeamID1, median(CAST(NumOT AS DOUBLE)) AS NumOT1, median(Score_Ratio) AS Score_Ratio1,
         median(Score_Pct) AS Score_Pct1 FROM asked JOIN train ON train.Season < S GROUP BY 1, 2),
b2 AS (
  SELECT CAST(S AS INTEGER) AS Season, TeamID2, median(CAST(NumOT AS DOUBLE)) AS NumOT2, median(Score_Ratio) AS Score_Ratio2,
         median(Score_Pct) AS Score_Pct2 FROM asked JOIN train ON train.Season < S GROUP BY 1, 2),
pairs_of AS (
  SELECT Season, TeamID1, TeamID2, CAST(Result AS DOUBLE) AS Result, true AS is_train FROM observed
  UNION ALL SELECT Season, TeamID1, TeamID2, NULL, false FROM missing)"""

_ALL = "WITH " + ",".join([_PODIUM, _CONTESTS, _SEEDS, _TARGETS, _PIPE]) + "\n"


def _r(c: str, alias: str | None = None) -> str:
    return f"round({c}, 6) AS {alias or c}"


def _onehot_cols(numot_cats, season_cats) -> list[str]:
    cols = [f"CAST(CASE WHEN NumOT = {v} THEN 1 ELSE 0 END AS DOUBLE) AS NumOT_{v}" for v in numot_cats]
    cols += [f"CAST(CASE WHEN Season = {v} THEN 1 ELSE 0 END AS DOUBLE) AS Season_{v}" for v in season_cats]
    return cols


def oracle_sql(numot_cats=(0, 1, 2, 3, 4)) -> dict[str, str]:
    seasons = list(TARGET_SEASONS)
    oh = ",\n       ".join(_onehot_cols(numot_cats, seasons))
    feat = [f"NumOT_{v}" for v in numot_cats] + [f"Season_{v}" for v in seasons] + ["Score_Ratio", "Score_Pct"]
    enc = f",\nenc AS (SELECT *,\n       {oh}\n  FROM funion)"
    stats_rows = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(min({c}) AS DOUBLE) AS x_min, CAST(max({c}) AS DOUBLE) AS x_max "
        f"FROM enc WHERE is_train" for c in feat)
    mm = ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in feat)
    scaled = ", ".join(
        f"round(({c} - (SELECT mn_{c} FROM mm)) / ((SELECT mx_{c} FROM mm) - (SELECT mn_{c} FROM mm) "
        f"+ CASE WHEN is_train THEN {EPS_TRAIN!r} ELSE {EPS_TEST!r} END), 6) AS {c}"
        for c in feat)
    other = ("Season, TeamID1, TeamID2, round(NumOT, 6) AS NumOT, is_train, round(Result, 6) AS Result")

    q = {
        "scan_contests": _ALL + f"SELECT Season, WTeamID, {_r('WScore')}, LTeamID, {_r('LScore')}, WLoc, NumOT FROM contests",
        "scan_seeds": _ALL + "SELECT Season, TeamID, Seed FROM seeds",
        "scan_targets": _ALL + "SELECT ID, Pred FROM targets",
        "submission": _ALL + f"SELECT ID, {_r('Pred')} FROM final",
        "parse_seed": _ALL + "SELECT Season, TeamID, Seed, seed_int FROM seeds_p",
        "parse_target_id": _ALL + "SELECT ID, Pred, Season, TeamID1, TeamID2 FROM tgt",
        "seed_join": _ALL + (f"SELECT Season, LTeamID, WTeamID, {_r('WScore')}, {_r('LScore')}, WLoc, NumOT, "
                             "WSeed, LSeed, DiffSeed FROM enriched"),
        "seed_diff": _ALL + "SELECT Season, WTeamID, LTeamID, WSeed, LSeed, DiffSeed FROM enriched",
        "mirror_contests": _ALL + (f"SELECT Season, TeamID1, TeamID2, {_r('Team1_Score')}, {_r('Team2_Score')}, "
                                   f"NumOT, DiffSeed, Result, {_r('Score_Ratio')}, {_r('Score_Total')}, "
                                   f"{_r('Score_Pct')} FROM train"),
        "score_features": _ALL + (f"SELECT Season, TeamID1, TeamID2, {_r('Score_Ratio')}, {_r('Score_Total')}, "
                                  f"{_r('Score_Pct')} FROM train"),
        "season_filter": _ALL + (f"SELECT Season, TeamID1, TeamID2, Result, {_r('Score_Pct')} FROM train "
                                 f"WHERE Season IN ({_SEASONS})"),
        "mirror_pairs": _ALL + ("SELECT WTeamID AS team1, LTeamID AS team2, 1 AS pred FROM contests "
                                "UNION ALL SELECT LTeamID, WTeamID, 0 FROM contests"),
        "preview_topn": _ALL + ("SELECT * FROM (SELECT WTeamID AS team1, LTeamID AS team2, 1 AS pred FROM contests "
                                "UNION ALL SELECT LTeamID, WTeamID, 0 FROM contests) m "
                                "ORDER BY team1, team2, pred LIMIT 5"),
        "observed_pairs": _ALL + (f"SELECT Season, TeamID1, TeamID2, NumOT, Result, {_r('Score_Ratio')}, "
                                  f"{_r('Score_Pct')} FROM observed"),
        "missing_pairs": _ALL + "SELECT TeamID1, TeamID2, Season FROM missing",
        "pair_features": _ALL + (f"SELECT Season, TeamID1, TeamID2, {_r('NumOT')}, {_r('Score_Ratio')}, "
                                 f"{_r('Score_Pct')} FROM test"),
        "attach_predictions": _ALL + (f"SELECT Season, TeamID1, TeamID2, ID, {_r('Pred')}, {_r('Pred1')} FROM sub"),
        "fallback_prediction": _ALL + (f"SELECT TeamID2, TeamID1, Season, ID, {_r('Pred1')}, {_r('prob1')}, "
                                       f"{_r('prob2')}, {_r('Pred')} FROM final"),
        "team_index": _ALL + ("SELECT team AS TeamID, CAST(dense_rank() OVER (ORDER BY team) - 1 AS INTEGER) AS team_idx "
                              "FROM (SELECT DISTINCT WTeamID AS team FROM contests UNION "
                              "SELECT DISTINCT LTeamID FROM contests) t"),
        "team_medians": _ALL + (f"SELECT 1 AS side, Season, TeamID1 AS TeamID, {_r('NumOT1', 'NumOT')}, "
                                f"{_r('Score_Ratio1', 'Score_Ratio')}, {_r('Score_Pct1', 'Score_Pct')} FROM m1 "
                                f"UNION ALL SELECT 2, Season, TeamID2, {_r('NumOT2')}, {_r('Score_Ratio2')}, "
                                f"{_r('Score_Pct2')} FROM m2"),
        "harmonic_team_prob": _ALL + (f"SELECT 1 AS side, TeamID1 AS TeamID, {_r('prob1', 'prob')} FROM p1 "
                                      f"UNION ALL SELECT 2, TeamID2, {_r('prob2')} FROM p2"),
        "minmax_stats": _ALL + enc + f"\nSELECT feature, round(x_min, 6) AS x_min, round(x_max, 6) AS x_max FROM ({stats_rows}) s",
        "distinct_seasons": _ALL + "SELECT DISTINCT Season FROM tgt",
        "team_cardinality": _ALL + "SELECT CAST(count(DISTINCT WTeamID) AS BIGINT) AS n_teams FROM "
                                   "(SELECT WTeamID FROM contests UNION ALL SELECT LTeamID FROM contests) t",
        "null_profile": _ALL + ("SELECT (SELECT count(*) FROM sub) AS rows, position, \"column\", non_null, dtype FROM ("
                                "SELECT 0 AS position, 'ID' AS \"column\", (SELECT count(ID) FROM sub) AS non_null, 'string' AS dtype "
                                "UNION ALL SELECT 1, 'Pred', (SELECT count(Pred) FROM sub), 'double' "
                                "UNION ALL SELECT 2, 'Season', (SELECT count(Season) FROM sub), 'int' "
                                "UNION ALL SELECT 3, 'TeamID1', (SELECT count(TeamID1) FROM sub), 'bigint' "
                                "UNION ALL SELECT 4, 'TeamID2', (SELECT count(TeamID2) FROM sub), 'bigint' "
                                "UNION ALL SELECT 5, 'Pred1', (SELECT count(Pred1) FROM sub), 'double') p"),
        "feature_union": _ALL + (f"SELECT Season, TeamID1, TeamID2, {_r('NumOT')}, {_r('Score_Ratio')}, "
                                 f"{_r('Score_Pct')}, {_r('Result')}, is_train FROM funion"),
        "one_hot_season": _ALL + enc + (f"\nSELECT {other}, {_r('Score_Ratio')}, {_r('Score_Pct')}, "
                                        + ", ".join(_r(c) for c in feat[:-2]) + " FROM enc"),
        "minmax_scale": _ALL + enc + f",\nmm AS (SELECT {mm} FROM enc WHERE is_train)\nSELECT {other}, {scaled} FROM enc",
        "holdout_split": _ALL + ("SELECT Season, TeamID1, TeamID2, Result, "
                                 "CAST(('0x' || substr(md5(concat(CAST(Season AS VARCHAR), '_', "
                                 "CAST(least(TeamID1, TeamID2) AS VARCHAR), '_', CAST(greatest(TeamID1, TeamID2) AS VARCHAR))), 1, 8))"
                                 "::UBIGINT % 100 AS INTEGER) < 30 AS is_holdout FROM train"),
        # by rank sums (Mann-Whitney, ties at their mean rank), not by running counts
        "roc_auc": _ALL + ("""
, sc AS (
  SELECT t.Season, t.Result, CAST(17 - coalesce(s.seed_int, 17) AS DOUBLE) AS strength
  FROM train t LEFT JOIN seeds_p s ON t.Season = s.Season AND t.TeamID1 = s.TeamID),
r AS (SELECT Season, Result, rank() OVER (PARTITION BY Season ORDER BY strength)
             + (count(*) OVER (PARTITION BY Season, strength) - 1) / 2.0 AS mean_rank FROM sc),
u AS (SELECT Season, sum(Result) AS p, sum(1 - Result) AS n, sum(Result * mean_rank) AS ranks FROM r GROUP BY Season)
SELECT Season, round(CASE WHEN p > 0 AND n > 0 THEN (ranks - p * (p + 1) / 2) / (p * n) END, 6) AS auc FROM u"""),
        "feature_vector": _ALL + enc + (f",\nmm AS (SELECT {mm} FROM enc WHERE is_train),\n"
                                        f"sc AS (SELECT Season, TeamID1, TeamID2, is_train, Result, {scaled} FROM enc),\n"
                                        f"seen AS (SELECT list(DISTINCT NumOT) AS cats FROM funion)\n"
                                        "SELECT Season, TeamID1, TeamID2, is_train, round(Result, 6) AS label, "
                                        "list_concat(list_concat("
                                        + ", ".join(["list_filter([" + ", ".join(
                                            f"CASE WHEN list_contains(cats, {v}) THEN NumOT_{v} END" for v in numot_cats)
                                            + "], lambda x: x IS NOT NULL)",
                                            "[" + ", ".join(f"Season_{v}" for v in seasons) + "]"])
                                        + "), [Score_Ratio, Score_Pct]) AS features FROM sc, seen"),
        "leaf_slots": _ALL + "SELECT CAST(40 AS INTEGER) AS n_set, count(*) AS rows, true AS leaves_shared FROM funion",
        "factor_complete": _ALL + (", played AS (SELECT WTeamID AS t FROM contests UNION SELECT LTeamID FROM contests)\n"
                                   "SELECT ID, TeamID1 IN (SELECT t FROM played) AND TeamID2 IN (SELECT t FROM played) AS known "
                                   "FROM tgt"),
        "loss_falls": "SELECT true AS falls, true AS starts_most, true AS by_epoch",
    }
    prior = _ALL + ", " + _PRIOR
    side = "SELECT {0} AS side, Season, TeamID{0} AS TeamID, " + ", ".join(
        f"round({c}{{0}}, 6) AS {c}" for c in ("NumOT", "Score_Ratio", "Score_Pct")) + " FROM b{0}"
    q["prior_medians"] = prior + f"\n{side.format(1)} UNION ALL {side.format(2)}"
    q["prior_features"] = prior + """
SELECT Season, TeamID1, TeamID2, round(round_even(NumOT1 + NumOT2, 0), 6) AS NumOT,
       round(pow(Score_Ratio1 * pow(Score_Ratio2, -1.0), 0.5), 6) AS Score_Ratio,
       round(pow(0.5 * pow(Score_Pct1, -1.0) + 0.5 * pow(1.0 - Score_Pct2, -1.0), -1.0), 6) AS Score_Pct, Result, is_train
FROM pairs_of JOIN b1 USING (Season, TeamID1) JOIN b2 USING (Season, TeamID2)"""
    each = "SELECT {0} AS side, Season, TeamID{0} AS TeamID, count(*) AS rows, true AS near_NumOT, true AS near_Score_Ratio FROM train GROUP BY ALL"
    q["sketch_medians"] = _ALL + f"{each.format(1)} UNION ALL {each.format(2)}"
    q["stratified_folds"] = _ALL + """
, k AS (SELECT Season, TeamID1, TeamID2, Result,
               concat(Season, '_', least(TeamID1, TeamID2), '_', greatest(TeamID1, TeamID2)) AS contest FROM train),
g AS (SELECT contest, count(*) AS n, sum(Result) AS p FROM k GROUP BY contest),
f AS (SELECT contest, CAST((row_number() OVER (PARTITION BY n, p ORDER BY md5(contest), contest) - 1) % 10 AS INTEGER) AS fold FROM g)
SELECT Season, TeamID1, TeamID2, Result, fold FROM k JOIN f USING (contest)"""
    width = _ALL + (f"SELECT CAST(unnest(range((SELECT count(DISTINCT NumOT) FROM funion) + {len(seasons)} + 3)) AS INTEGER) "
                    "AS feature, true AS optimal")
    q["lr_optimal"] = q["lr_cv_optimal"] = width
    whole = _ALL + ("SELECT ID, count(*) AS multiplicity, count(Pred1) AS scored, true AS in_range FROM sub GROUP BY ID")
    for family in ("lr", "gbt", "svc", "gbt_grid", "gbt_grid2", "gbt_subsample"):
        q[f"{family}_complete"] = whole
    return q
