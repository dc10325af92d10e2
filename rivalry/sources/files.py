"""File scans with a declared schema, and the submission sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import schemas


#: Headers are checked in every file, malformed rows fail the job.  Column
#: pruning would skip the check of columns that are not read.
CSV_OPTIONS = {"header": "true", "mode": "FAILFAST", "enforceSchema": "false", "columnPruning": "false"}


def read_table(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv") -> DataFrame:
    """Scan ``path`` and return exactly the columns of ``schema``, found by
    name and cast to the declared types; CSV files carry a header row.

    Files may hold more columns than the job reads (a full results file):
    columns are matched by header name, never by position, and types are
    never inferred - CSV fields are read as text and cast (ANSI casts fail
    on a malformed value instead of producing NULL).  All files of a CSV
    folder must have the same header; another order or name fails the job
    instead of swapping columns.
    """
    if fmt == "csv":
        df = spark.read.options(**CSV_OPTIONS).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    return conform(df, schema)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Project and cast ``df`` to ``schema`` (column order included).

    Fields declared non-nullable (the ids used as join keys) fail the job on
    a NULL instead of letting it silently drop out of a join; the check is an
    expression in the projection, so it costs no extra pass."""
    cols = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType)
        if not f.nullable:
            c = F.when(c.isNull(), F.raise_error(F.lit(f"NULL in key column {f.name}"))).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def read_seeds(spark, path, fmt="csv"):
    return read_table(spark, path, schemas.SEEDS, fmt)


def read_contests(spark, path, fmt="csv"):
    return read_table(spark, path, schemas.CONTESTS, fmt)


def read_season_contests(spark, path, fmt="csv"):
    return read_table(spark, path, schemas.SEASON_CONTESTS, fmt)


def read_targets(spark, path, fmt="csv"):
    return read_table(spark, path, schemas.TARGETS, fmt)


def write_submission(df: DataFrame, path: str, pred_col: str = "Pred", mode: str = "overwrite") -> None:
    """Write ``ID, <pred_col>`` as CSV with a header, one file per task (a
    directory of parts, as any distributed writer produces)."""
    df.select("ID", pred_col).write.mode(mode).option("header", True).csv(path)
