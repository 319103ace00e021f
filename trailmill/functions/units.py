"""Unit conversions of the activity, gear and weather records."""

from __future__ import annotations

from trailmill.functions.numeric import half_even, not_nan

# Conversion factors.
METRES_PER_MILE = 1609.34
MPH_PER_METRE_PER_SECOND = 2.23694
FEET_PER_METRE = 3.28084


def miles(metres: str) -> str:
    """Unrounded miles (gear totals)."""
    return f"({metres} / {METRES_PER_MILE}D)"


def miles2(metres: str) -> str:
    return half_even(miles(not_nan(metres)))


def mph2(metres_per_second: str) -> str:
    return half_even(f"{not_nan(metres_per_second)} * {MPH_PER_METRE_PER_SECOND}D")


def feet2(metres: str) -> str:
    return half_even(f"{not_nan(metres)} * {FEET_PER_METRE}D")


def fahrenheit(celsius: str) -> str:
    return f"(({celsius}) * 9D / 5D + 32D)"
