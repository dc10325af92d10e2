"""rivalry: Spark-native match-up analytics.

From tables of past contests between two sides the library builds mirrored
training rows, per-team season statistics and pairwise features, finds which
requested pairings were never observed, fits distributed probability models
with repeatable cross-validation and completes a prediction table with a
harmonic-mean fallback.  Every relational step is a DataFrame -> DataFrame
function on built-in Spark expressions.

Main entry points (imported on first use)::

    from rivalry import Tournament, tournament_predictions, FactorJob, Fixtures, build_session
"""

__version__ = "0.1.0"

_EXPORTS = {
    "Tournament": "rivalry.plans.tournament",
    "tournament_predictions": "rivalry.plans.jobs",
    "leaf_stack_report": "rivalry.plans.jobs",
    "FactorJob": "rivalry.plans.factors",
    "Fixtures": "rivalry.sources.fixtures",
    "build_session": "rivalry.session",
    "materialize": "rivalry.session",
}


def __getattr__(name):
    if name in _EXPORTS:
        import importlib
        return getattr(importlib.import_module(_EXPORTS[name]), name)
    raise AttributeError(name)
