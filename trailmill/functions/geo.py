"""Distances on the sphere."""

from __future__ import annotations

EARTH_KM = 6371.0


def unit_vector(lat: str, lon: str) -> tuple[str, str, str]:
    """Point on the unit sphere; straight-line distance there orders points
    exactly as great-circle distance does, without poles or a date line."""
    phi, lam = f"radians({lat})", f"radians({lon})"
    return f"cos({phi}) * cos({lam})", f"cos({phi}) * sin({lam})", f"sin({phi})"


def chord(a: tuple[str, str, str], b: tuple[str, str, str]) -> str:
    squares = [f"({p} - {q}) * ({p} - {q})" for p, q in zip(a, b)]
    return f"sqrt({' + '.join(squares)})"


def arc_km(chord_length: str) -> str:
    """Great-circle distance behind a straight line on the unit sphere."""
    return f"(asin(least({chord_length} / 2D, 1D)) * {2 * EARTH_KM}D)"
