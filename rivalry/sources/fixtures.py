"""Relations of the match-up shape derived from the parquet test tables.

Reading: a *team* is a supplier, a *season* is the order year, a *contest* is
one order, fought by its two suppliers with the highest line price (the
supplier's best line in the order is its score).  Everything is derived by
Spark from ``lineitem`` and ``orders`` so the work grows with the tables.

* ``contests``  - Season, WTeamID, WScore, LTeamID, LScore, WLoc, NumOT
* ``seeds``     - Season, TeamID, Seed: top 68 % of teams by season revenue
* ``targets``   - ID, Pred: the requested pairings.  A request pairs a
  supplier of an order of a target season with the next-placed one of that
  order (place p with p + 1, for every p), so the list grows linearly with
  the (order, supplier) rows and leaves none out; the contest pairs are among
  them, the lower places mostly never met.
* ``season_contests`` - WTeamID, LTeamID of every contest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import row_number
from ..session import stored
from . import schemas
from .files import conform

# Fixed values of the derivation.
TARGET_SEASONS = (1998, 1999, 2000, 2001)
SEED_SHARE_PCT = 68          # teams with rank * 100 <= n * 68 get a seed
PLAY_IN_PCT = 60             # seeds below the top 60 % carry the suffix "a"
REGIONS = ("W", "X", "Y", "Z")
SEEDS_PER_REGION = 16

ORDER_BUCKETS = 1 << 16      # of the orders, to find those with many lines
LARGE_BUCKET = 100_000       # lines of a bucket whose orders are not gathered, and so many times
LARGE_TIMES = 8              # the mean of all buckets
LINES_PER_TASK = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def season_of(ts_col: str) -> F.Column:
    return F.year(F.col(ts_col)).cast("int")


def season_range_filter(ts_col: str, seasons: Sequence[int]) -> F.Column:
    """``year(ts) in seasons`` plus a date range the parquet scan can use."""
    lo = F.lit(f"{min(seasons):04d}-01-01 00:00:00").cast("timestamp_ntz")
    hi = F.lit(f"{max(seasons) + 1:04d}-01-01 00:00:00").cast("timestamp_ntz")
    return (F.col(ts_col) >= lo) & (F.col(ts_col) < hi) & season_of(ts_col).isin(list(seasons))


def order_podium(lineitem: DataFrame, k: int) -> DataFrame:
    """The ``k`` best suppliers of every order: (l_orderkey, team, score, qty,
    place), place 1 = highest score, ties by lower team id."""
    return _top_k(lineitem.groupBy("l_orderkey", "l_suppkey").agg(*_best()), k)


def _bucket() -> F.Column:
    return F.pmod(F.xxhash64("l_orderkey"), F.lit(ORDER_BUCKETS))


def _best() -> list[F.Column]:
    return [F.max("l_extendedprice").alias("score"), F.max("l_quantity").alias("qty")]


def _placed() -> list[F.Column]:
    return [F.desc("score"), F.asc("l_suppkey")]


def _top_k(order_team: DataFrame, k: int, carry: Sequence[str] = ()) -> DataFrame:
    """The top-k filter on ``row_number`` is planned as a partial
    WindowGroupLimit before the shuffle, so even an order holding a third of
    all lines sends at most ``k`` rows per map task."""
    w = Window.partitionBy("l_orderkey").orderBy(*_placed())
    return (order_team.select("l_orderkey", "l_suppkey", "score", "qty", *carry)
            .withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
            .withColumnRenamed("l_suppkey", "team"))


def _contest_rows(order_team: DataFrame) -> DataFrame:
    """A contest is place 1 against place 2 of an order, unless they are tied."""
    at = lambda p, c: F.max(F.when(F.col("place") == p, F.col(c)))
    top = (_top_k(order_team, 2, carry=["Season"]).groupBy("l_orderkey")
           .agg(F.max("Season").alias("Season"), at(1, "team").alias("WTeamID"), at(1, "score").alias("WScore"),
                at(2, "team").alias("LTeamID"), at(2, "score").alias("LScore"),
                (at(1, "qty") + at(2, "qty")).alias("qty")))
    return conform(top.where(F.col("WScore") > F.col("LScore")).select(
        "Season", "WTeamID", "WScore", "LTeamID", "LScore", F.lit("N").alias("WLoc"),
        (F.col("qty").cast("int") % 3).cast("int").alias("NumOT")), schemas.CONTESTS)


def _seed_rows(rev: DataFrame) -> DataFrame:
    """Seeds from season revenue per team (Season, TeamID, r)."""
    # rank inside a season without sending the season to one task
    ranked = row_number(rev, ["Season"], [F.desc("r"), F.asc("TeamID")], out="rk", total="n")
    rk, n = F.col("rk"), F.col("n")
    region = F.element_at(F.array(*[F.lit(r) for r in REGIONS]), ((rk - 1) % len(REGIONS) + 1).cast("int"))
    number = F.lpad(((F.floor((rk - 1) / len(REGIONS)) % SEEDS_PER_REGION) + 1).cast("int").cast("string"), 2, "0")
    suffix = F.when(rk * 100 > n * PLAY_IN_PCT, F.lit("a")).otherwise(F.lit(""))
    s = ranked.where(rk * 100 <= n * SEED_SHARE_PCT).select(
        "Season", "TeamID", F.concat(region, number, suffix).alias("Seed"))
    return conform(s, schemas.SEEDS)


def _contests_of_places(places: DataFrame) -> DataFrame:
    """:func:`_contest_rows` from rows with the next better one (:func:`_places`)."""
    won, lost = (lambda c: F.col(f"better.{c}")), F.col
    return conform(places.where((F.col("place") == 2) & (won("score") > lost("score"))).select(
        F.greatest(won("Season"), lost("Season")).alias("Season"), won("l_suppkey").alias("WTeamID"), won("score").alias("WScore"),
        lost("l_suppkey").alias("LTeamID"), lost("score").alias("LScore"), F.lit("N").alias("WLoc"),
        ((won("qty") + lost("qty")).cast("int") % 3).cast("int").alias("NumOT")), schemas.CONTESTS)


def _places(order_team: DataFrame, seasons: Sequence[int]) -> DataFrame:
    """(order, supplier) rows with their place, the row one place better
    (``better``) and the next better row of the target seasons (``asked``), from
    one sort of each order's rows; only for orders a task may gather."""
    w = Window.partitionBy("l_orderkey").orderBy(*_placed())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.col("Season").isin(list(seasons))
    row = F.struct("l_suppkey", "score", "qty", "Season")
    d = order_team.withColumns({"place": F.row_number().over(w), "better": F.lag(row).over(w),
                                "asked": F.last(F.when(wanted, F.struct("l_suppkey", "Season")), ignorenulls=True).over(before)})
    second, asks = F.col("place") == 2, wanted & F.col("asked").isNotNull()
    return d.select("l_suppkey", "cents", "Season", "place", *[F.when(second, F.col(c)).alias(c) for c in ("score", "qty", "better")],
                    F.when(asks, F.col("asked")).alias("asked"))


def _pairs_of_places(places: DataFrame) -> DataFrame:
    return places.where(F.col("asked").isNotNull()).select(
        F.col("asked.Season").alias("Season"), F.least("asked.l_suppkey", "l_suppkey").alias("TeamID1"),
        F.greatest("asked.l_suppkey", "l_suppkey").alias("TeamID2"))


def _pairs_by_rank(order_team: DataFrame) -> DataFrame:
    """Pairs of neighbours without sending an order to one task."""
    # (order, place) is unique
    placed = row_number(order_team.select("l_orderkey", "l_suppkey", "score", "Season"), ["l_orderkey"],
                        _placed(), out="place").select("l_orderkey", "place", "Season", "l_suppkey")
    after = placed.select("l_orderkey", (F.col("place") - 1).alias("place"), F.col("l_suppkey").alias("next"))
    return placed.join(after, ["l_orderkey", "place"], "inner").select(
        "Season", F.least("l_suppkey", "next").alias("TeamID1"), F.greatest("l_suppkey", "next").alias("TeamID2"))


def _pairs_by_order(order_team: DataFrame) -> DataFrame:
    """The same for orders a task may gather."""
    w = Window.partitionBy("l_orderkey").orderBy(*_placed())
    d = order_team.select("l_orderkey", "l_suppkey", "score", "Season").withColumn(
        "before", F.lag(F.struct("l_suppkey", "Season")).over(w))
    return d.where(F.col("before").isNotNull()).select(
        F.col("before.Season").alias("Season"), F.least("before.l_suppkey", "l_suppkey").alias("TeamID1"),
        F.greatest("before.l_suppkey", "l_suppkey").alias("TeamID2"))


def _target_rows(found: DataFrame) -> DataFrame:
    """Requests from pairs of neighbours."""
    t = found.distinct()
    return conform(t.select(F.concat_ws("_", *[F.col(c).cast("string") for c in t.columns]).alias("ID"),
                            F.lit(0.5).alias("Pred")), schemas.TARGETS)


class Fixtures:
    """The relations, from ``lineitem`` grouped by (order, supplier) - best
    line price, best quantity, revenue in cents - with the order's season.

    ``shared`` says that several relations are wanted: the grouped table, with
    the places inside the orders, is then fixed once and read by all.  A single
    relation is built straight from the scans; the requests alone join only the
    target seasons' orders (the season range reaches the scan) before they
    aggregate.  Lines are counted in ``ORDER_BUCKETS`` by their order's hash; an
    order in a large bucket (it may own a third of all lines) is never gathered
    by one task: its top is limited before the shuffle, its places come from the
    two-level row number.
    """

    def __init__(self, lineitem: DataFrame, orders: DataFrame,
                 seasons: Sequence[int] = TARGET_SEASONS, stage=None, shared: bool = True):
        self.lineitem = lineitem
        self.orders = orders
        self.seasons = list(seasons)
        self.shared = shared
        self._stage = stage or stored
        self._cache: dict[str, DataFrame] = {}

    def _get(self, name, build):
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    @property
    def _counted(self) -> tuple[int, list[int]]:
        """Lines, and buckets of orders with so many that no task may gather them."""
        def build():
            found = self.lineitem.where(F.col("l_orderkey").isNotNull()).groupBy(_bucket().alias("b")).count().collect()
            total = sum(r["count"] for r in found)
            least = max(LARGE_BUCKET, LARGE_TIMES * total // ORDER_BUCKETS)
            return total, [r["b"] for r in found if r["count"] > least]
        return self._get("counted", build)

    @property
    def large(self) -> list[int]:
        return self._counted[1]

    def _lines(self, large: bool) -> DataFrame:
        """The lines of the orders in large buckets, or of all others."""
        lines = self.lineitem.where(F.col("l_orderkey").isNotNull())
        if not self.large:
            return lines.where(F.lit(not large))
        return lines.where(_bucket().isin(self.large) if large else ~_bucket().isin(self.large))

    def _order_team(self, lines: DataFrame) -> DataFrame:
        """(l_orderkey, l_suppkey, score, qty, cents, Season): ``lines`` by
        (order, supplier), then the join with orders on the order key."""
        agg = lines.groupBy("l_orderkey", "l_suppkey").agg(
            *_best(), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))
        o = self.orders.select("o_orderkey", season_of("o_orderdate").alias("Season"))
        return agg.join(o, agg.l_orderkey == o.o_orderkey, "inner").drop("o_orderkey")

    @property
    def order_team(self) -> DataFrame:
        """The rows of all orders, from a partial-aggregated shuffle."""
        return self._get("order_team", lambda: self._order_team(self.lineitem))

    @property
    def large_order_team(self) -> DataFrame:
        """The rows of the orders in large buckets."""
        return self._get("large_order_team", lambda: self._stage(self._order_team(self._lines(True))))

    @property
    def places(self) -> DataFrame:
        """The rows of all other orders with their places: lineitem is
        shuffled once, by order; grouping, join and places follow in that stage."""
        def build():
            lines = self._lines(False).select("l_orderkey", "l_suppkey", "l_extendedprice", "l_quantity")
            dealt = lines.repartition(1 + self._counted[0] // LINES_PER_TASK, "l_orderkey")
            return self._stage(_places(self._order_team(dealt), self.seasons))
        return self._get("places", build)

    def _season_order_team(self, lines: DataFrame) -> DataFrame:
        o = (self.orders.where(season_range_filter("o_orderdate", self.seasons))
             .select("o_orderkey", season_of("o_orderdate").alias("Season")))
        return (lines.join(o, lines.l_orderkey == o.o_orderkey, "inner")
                .groupBy("l_orderkey", "l_suppkey", "Season").agg(F.max("l_extendedprice").alias("score")))

    @property
    def season_order_team(self) -> DataFrame:
        """(l_orderkey, l_suppkey, score, Season) of the target seasons."""
        return self._season_order_team(self.lineitem)

    @property
    def contests(self) -> DataFrame:
        def build():
            if not self.shared:
                return _contest_rows(self.order_team)
            few = _contests_of_places(self.places)
            return few.unionByName(_contest_rows(self.large_order_team)) if self.large else few
        return self._get("contests", build)

    @property
    def targets(self) -> DataFrame:
        def build():
            if self.shared:
                few = _pairs_of_places(self.places)
                many = lambda: self.large_order_team.where(F.col("Season").isin(self.seasons))
            else:
                few = _pairs_by_order(self._season_order_team(self._lines(False)))
                many = lambda: self._season_order_team(self._lines(True))
            return _target_rows(few.unionByName(_pairs_by_rank(many())) if self.large else few)
        return self._get("targets", build)

    @property
    def seeds(self) -> DataFrame:
        def build():
            cols = [F.col("Season"), F.col("l_suppkey").alias("TeamID"), F.col("cents")]
            rows = (self.places if self.shared else self.order_team).select(*cols)
            if self.shared and self.large:
                rows = rows.unionByName(self.large_order_team.select(*cols))
            seeds = _seed_rows(rows.groupBy("Season", "TeamID").agg(F.sum("cents").alias("r")))
            return self._stage(seeds) if self.shared else seeds
        return self._get("seeds", build)


def one(lineitem: DataFrame, orders: DataFrame, seasons: Sequence[int] = TARGET_SEASONS) -> Fixtures:
    """The builders for a caller that wants a single relation."""
    return Fixtures(lineitem, orders, seasons, shared=False)


def contests_from(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    return one(lineitem, orders).contests


def seeds_from(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    return one(lineitem, orders).seeds


def targets_from(lineitem: DataFrame, orders: DataFrame, seasons: Sequence[int] = TARGET_SEASONS) -> DataFrame:
    return one(lineitem, orders, seasons).targets


def season_contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contests_from(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))
    return conform(c.select("WTeamID", "LTeamID"), schemas.SEASON_CONTESTS)
