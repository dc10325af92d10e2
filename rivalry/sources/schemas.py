"""Explicit schemas of the inputs (no inference at read time)."""

from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType)

SEEDS = StructType([
    StructField("Season", IntegerType(), False),
    StructField("TeamID", LongType(), False),
    StructField("Seed", StringType(), True),
])

CONTESTS = StructType([
    StructField("Season", IntegerType(), False),
    StructField("WTeamID", LongType(), False),
    StructField("WScore", DoubleType(), True),
    StructField("LTeamID", LongType(), False),
    StructField("LScore", DoubleType(), True),
    StructField("WLoc", StringType(), True),
    StructField("NumOT", IntegerType(), True),
])

SEASON_CONTESTS = StructType([
    StructField("WTeamID", LongType(), False),
    StructField("LTeamID", LongType(), False),
])

TARGETS = StructType([
    StructField("ID", StringType(), False),
    StructField("Pred", DoubleType(), True),
])

SUBMISSION = TARGETS
