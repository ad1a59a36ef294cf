"""Scalar expressions for users: value display, clamps, fingerprints, ranges."""

from factloom.model import severity_name, severity_rank, shown
from factloom.operators.facts import clamp
from factloom.operators.logs import fuzzy_fingerprint, normalised, strict_fingerprint
from factloom.operators.versions import shape, with_in_range

__all__ = [
    "clamp", "fuzzy_fingerprint", "normalised", "severity_name", "severity_rank", "shape", "shown", "strict_fingerprint", "with_in_range",
]
