"""Rounding and exact-sum expressions."""

from __future__ import annotations


def not_nan(x: str) -> str:
    """NaN becomes NULL; every aggregate then skips it."""
    return f"nanvl({x}, cast(null as double))"


def half_even(x: str, digits: int = 2) -> str:
    """Round half-even on the scaled double (``round`` is half-up)."""
    scale = f"{10**digits}D"
    return f"(rint(({x}) * {scale}) / {scale})"


def to_units(x: str, digits: int = 2) -> str:
    """A measure as an integer number of its last kept decimal.

    Sums of these are exact, so they do not depend on the order in which
    partitions are merged, and stay primitive longs in the hash aggregate.
    """
    return f"cast(rint({not_nan(x)} * {10**digits}D) as bigint)"


def from_units(n: str, digits: int = 2) -> str:
    return f"(cast({n} as double) / {10**digits}D)"


def truncated(x: str) -> str:
    """Integer part, towards zero."""
    return f"cast({x} as bigint)"
