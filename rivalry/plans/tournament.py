"""The tournament job: contests + seeds + requested pairings -> a complete
prediction table.

One body, parameterised by the input frames, the target seasons, the scaling
constants and the model.  Each stage is a lazy DataFrame; Spark plans the
whole chain up to the model fit, and again from scoring to the sink.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import complete, contests as ct, pairs, prepare
from ..defaults import EPS_TEST, EPS_TRAIN
from ..session import stored


TRAIN_FEATURES = ("contest", "prior_season")


class Tournament:
    """Inputs may be DataFrames or zero-argument callables returning one; a
    callable is only evaluated when a stage needs that input.  ``seasons``
    are the seasons of the requested pairings (the training rows are taken
    from those seasons).  ``train_features``: ``contest``, the statistics of
    the very contests, as the original has it (they know the result), or
    ``prior_season``, what was known before the season."""

    def __init__(self, contests: DataFrame | Callable[[], DataFrame],
                 seeds: DataFrame | Callable[[], DataFrame],
                 targets: DataFrame | Callable[[], DataFrame],
                 seasons: Sequence[int], eps_train: float = EPS_TRAIN,
                 eps_test: float = EPS_TEST, chunks: int | None = None, checkpoint_stages: bool = True,
                 train_features: str = "contest"):
        self._inputs = {"contests": contests, "seeds": seeds, "targets": targets}
        self.seasons = list(seasons)
        self.eps_train = eps_train
        self.eps_test = eps_test
        self.chunks = chunks
        self.checkpoint_stages = checkpoint_stages
        if train_features not in TRAIN_FEATURES:
            raise ValueError(f"train_features must be one of {TRAIN_FEATURES}")
        self.train_features = train_features

    def with_features(self, train_features: str) -> Tournament:
        """The same job with other training features, sharing what is alike."""
        other = Tournament(None, None, None, self.seasons, self.eps_train, self.eps_test, self.chunks, self.checkpoint_stages,
                           train_features)
        other._inputs = self._inputs
        for name in ("enriched", "train", "season_rows", "season_train", "parsed_targets", "observed", "missing"):
            other.__dict__[name] = getattr(self, name)
        return other

    def stage(self, df: DataFrame) -> DataFrame:
        """Write a stage read by several later steps once to the checkpoint
        folder, so the fan-out re-reads it instead of recomputing its joins
        (and a lost executor does not send the job back to the raw tables)."""
        return stored(df) if self.checkpoint_stages else df

    def _input(self, name: str) -> DataFrame:
        v = self._inputs[name]
        if callable(v):
            v = self._inputs[name] = v()
        return v

    @property
    def contests(self) -> DataFrame:
        return self._input("contests")

    @property
    def seeds(self) -> DataFrame:
        return self._input("seeds")

    @property
    def targets(self) -> DataFrame:
        return self._input("targets")

    @cached_property
    def enriched(self) -> DataFrame:
        return ct.seed_join(self.contests, self.seeds)

    @cached_property
    def train(self) -> DataFrame:
        """Mirrored contests of every season."""
        return ct.mirror_contests(self.enriched)

    @cached_property
    def season_rows(self) -> DataFrame:
        """Mirrored contests of the target seasons only: the season filter is
        applied to the contests before the seed join and the mirror."""
        return ct.mirror_contests(ct.seed_join(ct.season_filter(self.contests, self.seasons), self.seeds))

    @cached_property
    def season_train(self) -> DataFrame:
        """The same, fixed once for the observed and the missing split."""
        return self.stage(self.season_rows)

    @cached_property
    def parsed_targets(self) -> DataFrame:
        """Requests split into keys; read by both splits and the completion."""
        return self.stage(pairs.parse_targets(self.targets))

    @cached_property
    def observed(self) -> DataFrame:
        """Read by the medians and by the union."""
        return self.stage(pairs.observed_pairs(self.season_train, self.parsed_targets, self.seasons))

    @cached_property
    def missing(self) -> DataFrame:
        return pairs.missing_pairs(self.season_train, self.parsed_targets, self.seasons)

    @cached_property
    def medians(self) -> DataFrame:
        """Per (side, season, team): of the season's observed rows, or of all
        earlier seasons."""
        if self.train_features == "prior_season":
            return self.stage(pairs.prior_medians(self.train, self.seasons, chunks=self.chunks))
        return pairs.team_medians(self.observed, chunks=self.chunks, fixed=self.checkpoint_stages)

    @cached_property
    def learned(self) -> DataFrame:
        """Training rows with their features: the contests' own statistics,
        or the pair features of earlier seasons (rows whose teams have none
        are left to the fallback)."""
        if self.train_features == "prior_season":
            return pairs.pair_features(self.observed, self.medians, keep=["Result"])
        return self.observed

    @cached_property
    def test(self) -> DataFrame:
        return pairs.pair_features(self.missing, self.medians)

    @cached_property
    def union(self) -> DataFrame:
        """Training and test rows together, written once to the checkpoint
        folder: the boundary between the relational part and the model part,
        read by the category scan, the scaler fit, the model fit and the
        scoring pass without recomputing the joins above it."""
        return self.stage(prepare.feature_union(self.learned, self.test))

    def encoded(self, season_cats, numot_cats) -> tuple[DataFrame, list[str]]:
        """Named indicator columns, for categories known to the caller."""
        return prepare.encode_features(self.union, season_cats, numot_cats)

    @cached_property
    def featured(self) -> DataFrame:
        """The feature union with ``label`` and the scaled ``features`` vector
        (NULL for a row to be scored that lacks a feature)."""
        return prepare.scaled_features(self.union, eps_train=self.eps_train, eps_test=self.eps_test) \
            .withColumnRenamed("Result", "label")

    def complete(self, scored: DataFrame, pred_col: str = "Pred1") -> DataFrame:
        """``scored`` holds every row of the feature union with ``pred_col``;
        returns targets with the model value or the harmonic fallback.  Only
        keys and value are read, several times: they are fixed, so that the
        features are built and scored once."""
        scored = self.stage(scored.select(*pairs.KEYS, "is_train", pred_col))
        test_pred = scored.where(~F.col("is_train"))
        train_pred = scored.where(F.col("is_train"))
        sub = self.stage(complete.attach_predictions(self.parsed_targets, test_pred, train_pred, pred_col))
        return complete.fallback_prediction(sub, pred_col, out="Pred")

    def run(self, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Full job: ``score(featured)`` must return the union rows with a
        ``Pred1`` column (class-1 probability)."""
        return complete.submission(self.complete(score(self.featured)))
