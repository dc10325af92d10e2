"""Plan shape checks: the things that decide behaviour at scale."""

from rivalry.plans import catalog
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_podium_limits_rows_before_the_shuffle(spark):
    from rivalry.sources.fixtures import order_podium, table
    p = _plan(order_podium(table(spark, SF_SMALL, "lineitem"), 3))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_completion_has_no_cartesian_or_nested_loop(spark):
    df = catalog.q_fallback_prediction(spark, SF_SMALL)
    df.collect()
    p = _plan(df)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_scans_read_only_needed_columns_and_push_the_season_range(spark):
    from rivalry.sources.fixtures import one, table
    df = one(table(spark, SF_SMALL, "lineitem"), table(spark, SF_SMALL, "orders")).season_order_team
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "l_partkey" not in text and "l_discount" not in text and "o_totalprice" not in text
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01" in text and "LessThan(o_orderdate,2002-01-01" in text


def test_fixtures_scan_lineitem_and_orders_once(spark):
    from rivalry.sources.fixtures import Fixtures, table
    fx = Fixtures(table(spark, SF_SMALL, "lineitem"), table(spark, SF_SMALL, "orders"))
    for rel in (fx.contests, fx.targets, fx.seeds):
        text = spark._jvm.PythonSQLUtils.explainString(rel._jdf.queryExecution(), "formatted")
        assert "Scan parquet" not in text            # all read the checkpointed per-order tables


def test_hot_team_is_split_in_the_fallback_joins(spark):
    from pyspark.sql import functions as F
    from rivalry.operators.complete import fallback_prediction
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.shuffle.partitions": "32",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        n = 200_000
        team = lambda other: F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(other).cast("long")
        sub = spark.range(0, n, 1, 8).select(
            F.concat(F.lit("2000_"), "id").alias("ID"), team(F.xxhash64("id") % 50_000).alias("TeamID1"),
            team(F.xxhash64("id", F.lit(1)) % 50_000).alias("TeamID2"),
            F.when(F.col("id") % 2 == 0, F.rand(1)).alias("Pred1"))
        done = fallback_prediction(sub)
        done.write.format("noop").mode("overwrite").save()
        rows = done.select("Pred").agg(F.count("Pred")).collect()
        assert rows[0][0] == n
        done.collect()
        assert done._jdf.queryExecution().executedPlan().toString().count("skew=true") >= 2
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
