"""Scalar expressions, all built-in Spark functions (no Python UDFs)."""

from .scalar import (  # noqa: F401
    fallback_product,
    harmonic_pair,
    inverse_ratio_geomean,
    pair_key,
    seed_diff,
    seed_number,
    split_bucket,
    target_id,
    target_part,
)
