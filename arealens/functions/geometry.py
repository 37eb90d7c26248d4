"""Plane geometry as column expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from arealens import presets

EARTH_RADIUS_KM = 6371.0088


def lambert_conformal(
    lon: Column, lat: Column, p: Mapping[str, float] = presets.LONG_ISLAND_LCC
) -> tuple[Column, Column]:
    """Ellipsoidal Lambert conformal conic with two standard parallels (textbook formulas)."""
    flat = 1.0 / p["inv_f"]
    e = math.sqrt(flat * (2.0 - flat))

    def m_of(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1.0 - (e * math.sin(phi)) ** 2)

    def t_of(phi: float) -> float:
        s = e * math.sin(phi)
        return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (e / 2)

    phi1, phi2, phi0 = (math.radians(p[k]) for k in ("lat_1", "lat_2", "lat_0"))
    n = (math.log(m_of(phi1)) - math.log(m_of(phi2))) / (math.log(t_of(phi1)) - math.log(t_of(phi2)))
    scale = p["a"] * m_of(phi1) / (n * t_of(phi1) ** n)
    rho0 = scale * t_of(phi0) ** n

    phi = F.radians(lat)
    s = F.lit(e) * F.sin(phi)
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
    rho = F.lit(scale) * F.pow(t, F.lit(n))
    theta = F.lit(n) * F.radians(lon - F.lit(p["lon_0"]))
    x = (rho * F.sin(theta) + F.lit(p["x_0"])) / F.lit(p["unit"])
    y = (F.lit(rho0) - rho * F.cos(theta) + F.lit(p["y_0"])) / F.lit(p["unit"])
    return x, y


def equirectangular_km(lon: Column, lat: Column, lat_0: float) -> tuple[Column, Column]:
    """Local plane in kilometres around ``lat_0``; the error grows with the distance from it
    (about 0.1 % at 10 km for mid latitudes, see README)."""
    x = F.radians(lon) * F.lit(EARTH_RADIUS_KM * math.cos(math.radians(lat_0)))
    return x, F.radians(lat) * F.lit(EARTH_RADIUS_KM)


# The edge tests below are SQL texts over an edge struct ``e`` (x1, y1, x2, y2) and the names of two
# point columns: they run inside array functions, where one parsed text replaces dozens of columns.


def crosses(px: str, py: str, e: str) -> str:
    """Does the ray from the point towards +x cross the edge?

    The rule is half open in y, so a vertex shared by two edges counts once.
    """
    at = f"({e}.x2 - {e}.x1) * ({py} - {e}.y1) / ({e}.y2 - {e}.y1) + {e}.x1"
    return f"if(({e}.y1 > {py}) != ({e}.y2 > {py}), {px} < {at}, false)"


def on_edge(px: str, py: str, e: str) -> str:
    """Is the point exactly on the edge? A point on the boundary is not within the polygon."""
    return (
        f"(({e}.x2 - {e}.x1) * ({py} - {e}.y1) = ({px} - {e}.x1) * ({e}.y2 - {e}.y1)"
        f" AND {px} BETWEEN least({e}.x1, {e}.x2) AND greatest({e}.x1, {e}.x2)"
        f" AND {py} BETWEEN least({e}.y1, {e}.y2) AND greatest({e}.y1, {e}.y2))"
    )


def contains(px: str, py: str, edges: str) -> str:
    """Odd number of crossings and not on the boundary."""
    crossings = f"size(filter({edges}, e -> {crosses(px, py, 'e')}))"
    return f"({crossings} % 2 = 1 AND NOT exists({edges}, e -> {on_edge(px, py, 'e')}))"


def squared_distance_to_edge(px: str, py: str, e: str) -> str:
    dx, dy = f"({e}.x2 - {e}.x1)", f"({e}.y2 - {e}.y1)"
    length = f"({dx} * {dx} + {dy} * {dy})"
    along = f"greatest(0D, least(1D, (({px} - {e}.x1) * {dx} + ({py} - {e}.y1) * {dy}) / {length}))"
    ox, oy = f"({px} - {e}.x1 - {along} * {dx})", f"({py} - {e}.y1 - {along} * {dy})"
    return f"({ox} * {ox} + {oy} * {oy})"
