"""The latent-factor job: season contests -> factor model -> scores for the
requested pairings (ID, pred).

The model (:mod:`rivalry.operators.embedding`) is
``sigmoid(w * (<u_t1, v_t2> + b1[t1] + b2[t2]) + c)``, factors, biases and outer
numbers learned together by log loss in mini-batches with Adam, L2 on the
factors.  Early stopping watches the training loss: there is no other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..defaults import FACTOR_BATCH, FACTOR_EPOCHS, FACTOR_L2, FACTOR_PATIENCE, FACTOR_STEP, FACTORS
from ..functions import scalar as fx
from ..operators import embedding
from ..operators.contests import mirror_pairs
from ..operators.prepare import team_index
from ..session import materialize


class FactorJob:
    """Mirror the contests, index the teams, fit the factor model, score.

    A team of the requests that never played gets a NULL prediction (the
    original stops with a lookup error)."""

    def __init__(self, season_contests: DataFrame, n_factors: int = FACTORS, l2: float = FACTOR_L2, epochs: int = FACTOR_EPOCHS,
                 step: float = FACTOR_STEP, batch: int = FACTOR_BATCH, patience: int | None = FACTOR_PATIENCE, tol: float = 0.0,
                 blocks: int | None = None, seed: int = 42):
        self.pairs = mirror_pairs(season_contests)
        self.settings = embedding.Settings(n_factors, l2, step, batch, seed)
        self.epochs, self.patience, self.tol, self.blocks = epochs, patience, tol, blocks
        self._fitted = None

    def _indexed(self, df: DataFrame, teams: DataFrame, t1: str, t2: str) -> DataFrame:
        """``df`` with both teams' indices, NULL for a team unknown."""
        one = teams.select(F.col("TeamID").alias(t1), F.col("team_idx").cast("long").alias("i1"))
        two = teams.select(F.col("TeamID").alias(t2), F.col("team_idx").cast("long").alias("i2"))
        return df.join(one, t1, "left").join(two, t2, "left")

    def fit(self) -> tuple[DataFrame, embedding.Embedding]:
        if self._fitted is None:
            teams = materialize(team_index(self.pairs))
            rows = self._indexed(self.pairs, teams, "team1", "team2").select(
                F.col("i1").alias("a"), F.col("i2").alias("b"), F.col("pred").alias("y"))
            self._fitted = teams, embedding.fit(materialize(rows), teams.count(), self.settings, self.epochs, self.patience,
                                                self.tol, self.blocks)
        return self._fitted

    def predict(self, targets: DataFrame) -> DataFrame:
        """(ID, pred) for every request."""
        teams, model = self.fit()
        t = targets.select("ID", fx.target_part("ID", 1).alias("t1"), fx.target_part("ID", 2).alias("t2"))
        return model.score(self._indexed(t, teams, "t1", "t2"), "i1", "i2").select("ID", "pred")

    def loss_history(self) -> DataFrame:
        """(epoch, loss): the mean loss over each epoch's batches, gathered
        while it trained."""
        hist = self.fit()[1].history                             # one number per epoch
        return self.pairs.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(hist)], "epoch int, loss double")
