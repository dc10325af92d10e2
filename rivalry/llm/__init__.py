"""Operators of a training-data pipeline over documents, pages and vectors.

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it.  The
Python code that runs in tasks is shipped by value (:func:`by_value`), so the
executors need the third-party packages but not this library.
"""

from __future__ import annotations

import importlib

from pyspark import cloudpickle

_TASK_MODULES = ("common", "simhash", "quality_cnn", "tokens", "packing", "token_store", "warc", "ann", "pieces",
                 "ranked", "fim")


def by_value() -> None:
    """Pickle the modules with task code by value."""
    for name in _TASK_MODULES:
        cloudpickle.register_pickle_by_value(importlib.import_module(f"{__name__}.{name}"))
