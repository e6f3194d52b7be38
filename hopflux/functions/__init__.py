"""Column expressions of the graph model."""

from hopflux.functions.expressions import clamp, finite, missing, or_infinity

__all__ = ["clamp", "finite", "missing", "or_infinity"]
