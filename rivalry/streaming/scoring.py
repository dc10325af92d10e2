"""Score request files as they arrive.

The original has no streams; this is its completion step (attach the model
value, else the per-team harmonic fallback) applied to a folder of request
files read with ``readStream``.  The model values and the two per-team
probability tables come from a batch run and are joined stream-to-static, so
the query keeps no state and needs no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..defaults import FALLBACK_PROB
from ..functions import scalar as fx
from ..operators.complete import team_probabilities
from ..operators.pairs import KEYS, parse_targets
from ..session import materialize
from ..sources import schemas
from ..sources.files import CSV_OPTIONS, conform


class CompletionTables:
    """Static inputs of the streaming completion, taken from a batch ``sub``
    (requests with ``Pred1``): scored pairs and per-team probabilities.

    The static side of a stream-static join is evaluated again for every
    micro-batch, so the three tables are written once to the checkpoint
    folder here; each batch then reads them instead of re-aggregating."""

    def __init__(self, sub: DataFrame, pred_col: str = "Pred1"):
        self.scored = materialize(sub.where(F.col(pred_col).isNotNull())
                                  .select(*KEYS, F.col(pred_col).alias("Pred1")))
        p1, p2 = team_probabilities(sub, pred_col)
        self.prob1, self.prob2 = materialize(p1), materialize(p2)


def complete_stream(requests: DataFrame, tables: CompletionTables, default: float = FALLBACK_PROB) -> DataFrame:
    """(ID, Pred) for a (streaming or static) frame of requests (ID, Pred).

    A team without a batch probability gets ``default``, the value the
    original gives a team whose predictions are all missing.
    """
    parsed = parse_targets(requests).drop("Pred")
    j = (parsed.join(tables.scored, KEYS, "left")
         .join(tables.prob1, "TeamID1", "left")
         .join(tables.prob2, "TeamID2", "left"))
    fallback = fx.fallback_product(F.coalesce("prob1", F.lit(default)), F.coalesce("prob2", F.lit(default)))
    return j.select("ID", F.coalesce(F.col("Pred1"), fallback).alias("Pred"))


def read_request_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 100) -> DataFrame:
    """CSV request files (ID, Pred, with header) arriving in ``folder``.  As
    in the batch reader another header or a malformed row fails the query."""
    df = (spark.readStream.schema("ID string, Pred string").options(**CSV_OPTIONS)
          .option("maxFilesPerTrigger", max_files_per_trigger).csv(folder))
    return conform(df, schemas.TARGETS)


def start_scoring(requests: DataFrame, tables: CompletionTables, out_folder: str,
                  checkpoint_location: str, fmt: str = "parquet") -> StreamingQuery:
    """Append scored requests to ``out_folder``; progress is kept in
    ``checkpoint_location`` (shared storage), so a restarted query resumes
    exactly where it stopped."""
    return (complete_stream(requests, tables).writeStream.format(fmt).outputMode("append")
            .option("checkpointLocation", checkpoint_location).start(out_folder))
