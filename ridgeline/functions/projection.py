"""Transverse Mercator on GRS 80 between SWEREF 99 TM grid points and degrees, as column expressions.

Latitudes go through the isometric latitude in closed form; the way between the conformal sphere and the grid is the public
Krueger series in the third flattening, to its fifth power, whose next terms are below a hundredth of a micrometre.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ellipsoid, central meridian, scale and false easting of the grid
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
SCALE, MERIDIAN, EAST, NORTH = 0.9996, 15.0, 500000.0, 0.0

N = FLATTENING / (2 - FLATTENING)
E = math.sqrt(FLATTENING * (2 - FLATTENING))
RADIUS = SCALE * AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
# Coefficients of the series, from the grid and to it
FROM_GRID = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360 - 81 * N**5 / 512,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440 + 46 * N**5 / 105,
    17 * N**3 / 480 - 37 * N**4 / 840 - 209 * N**5 / 4480,
    4397 * N**4 / 161280 - 11 * N**5 / 504,
    4583 * N**5 / 161280,
)
TO_GRID = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180 - 127 * N**5 / 288,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440 + 281 * N**5 / 630,
    61 * N**3 / 240 - 103 * N**4 / 140 + 15061 * N**5 / 26880,
    49561 * N**4 / 161280 - 179 * N**5 / 168,
    34729 * N**5 / 80640,
)
#: Steps from the isometric latitude to the latitude; each takes the error to less than a hundredth.
STEPS = 7


def _let(body, **values: Column) -> Column:
    """``body`` of the values, each computed once for a row: written out where they are used, the formulas would outgrow a method."""
    return F.transform(F.array(F.struct(*(c.alias(k) for k, c in values.items()))), body)[0]


def _along(factors, xi: Column, eta: Column) -> Column:
    return sum((f * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, f in enumerate(factors, 1)), F.lit(0.0))


def _across(factors, xi: Column, eta: Column) -> Column:
    return sum((f * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, f in enumerate(factors, 1)), F.lit(0.0))


def _from_grid(x: Column, y: Column, body) -> Column:
    """``body`` of the place (xi, eta) of a grid point on the conformal sphere's own grid."""
    return _let(
        lambda g: _let(body, xi=g["xi"] - _along(FROM_GRID, g["xi"], g["eta"]), eta=g["eta"] - _across(FROM_GRID, g["xi"], g["eta"])),
        xi=(y.cast("double") - NORTH) / RADIUS,
        eta=(x.cast("double") - EAST) / RADIUS,
    )


def latitude(x: Column, y: Column) -> Column:
    """Degrees north of a grid point."""

    def of(isometric: Column) -> Column:
        sine = F.tanh(isometric)
        for _ in range(STEPS):
            sine = F.tanh(isometric + E * F.atanh(E * sine))
        return F.degrees(F.asin(sine))

    return _from_grid(x, y, lambda s: _let(lambda v: of(v["isometric"]), isometric=F.atanh(F.sin(s["xi"]) / F.cosh(s["eta"]))))


def longitude(x: Column, y: Column) -> Column:
    """Degrees east of a grid point."""
    return _from_grid(x, y, lambda s: MERIDIAN + F.degrees(F.atan2(F.sinh(s["eta"]), F.cos(s["xi"]))))


def _to_grid(lon: Column, lat: Column, body) -> Column:
    """``body`` of the place (xi, eta) of a geographic point on the conformal sphere's own grid."""
    sine = F.sin(F.radians(lat.cast("double")))
    return _let(
        lambda v: _let(body, xi=F.atan2(F.sinh(v["isometric"]), F.cos(v["turn"])), eta=F.atanh(F.sin(v["turn"]) / F.cosh(v["isometric"]))),
        isometric=F.atanh(sine) - E * F.atanh(E * sine),
        turn=F.radians(lon.cast("double") - MERIDIAN),
    )


def easting(lon: Column, lat: Column) -> Column:
    """Metres east of a geographic point."""
    return _to_grid(lon, lat, lambda s: EAST + RADIUS * (s["eta"] + _across(TO_GRID, s["xi"], s["eta"])))


def northing(lon: Column, lat: Column) -> Column:
    """Metres north of a geographic point."""
    return _to_grid(lon, lat, lambda s: NORTH + RADIUS * (s["xi"] + _along(TO_GRID, s["xi"], s["eta"])))


def grid_box(box: Column) -> Column:
    """The four grid corners of a geographic box [west, south, east, north], in ring order: only corners are projected."""
    corner = lambda a, b: F.struct(easting(box[a], box[b]).alias("x"), northing(box[a], box[b]).alias("y"))
    return F.array(corner(0, 1), corner(2, 1), corner(2, 3), corner(0, 3))
