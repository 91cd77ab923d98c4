"""SQL of the map projection by another derivation than the library's, for the oracles alone.

The grid is the meridian arc of a complex latitude, whose isometric latitude is that of the point with its longitude as the imaginary
part. The arc's waves are integrated numerically from the ellipsoid, and both ways are iterated: nothing is taken from the library's series.
"""

from __future__ import annotations

import math

_AXIS, _E2 = 6378137.0, (2 - 1 / 298.257222101) / 298.257222101  # fixed values: the ellipsoid
_E = math.sqrt(_E2)
#: Places of the trapezoid rule over a period, which is exact for so smooth a function; waves of the arc.
_PLACES, _WAVES = 64, 7


def _arc() -> tuple[float, list[float]]:
    """(metres of a radian on average, waves) of the meridian arc: metres * (latitude + sum of wave k * sin(2 k latitude))."""
    at = [math.pi * j / _PLACES for j in range(_PLACES)]
    bend = [(1 - _E2 * math.sin(p) ** 2) ** -1.5 for p in at]
    mean = sum(bend) / _PLACES
    waves = [2 * sum(b * math.cos(2 * k * p) for b, p in zip(bend, at, strict=True)) / _PLACES / (2 * k * mean) for k in range(1, _WAVES + 1)]
    return 0.9996 * _AXIS * (1 - _E2) * mean, waves


_METRES, _G = _arc()


def _sum(of: str, by: str) -> str:
    return " + ".join(f"({g!r}) * {of}({2 * k} * p) * {by}({2 * k} * q)" for k, g in enumerate(_G, 1))


#: e * atanh(e * sin(p + iq)), its real and imaginary part, from the columns u + iv = e * sin(p + iq).
_BEND = f"{_E!r} / 2 * atanh(2 * u / (1 + u * u + v * v))", f"{_E!r} / 2 * atan2(2 * v, 1 - u * u - v * v)"


def _sine(source: str) -> str:
    return f"(SELECT *, {_E!r} * sin(p) * cosh(q) AS u, {_E!r} * cos(p) * sinh(q) AS v FROM {source})"


def degrees_of(source: str, x: str, y: str) -> str:
    """The source's rows with ``lat`` and ``lon`` of the grid point (x, y)."""
    out = f"(SELECT *, p0 AS p, q0 AS q FROM (SELECT *, ({y}) / {_METRES!r} AS p0, (({x}) - 500000) / {_METRES!r} AS q0 FROM {source}))"
    for _ in range(8):
        out = f"(SELECT * REPLACE (p0 - ({_sum('sin', 'cosh')}) AS p, q0 - ({_sum('cos', 'sinh')}) AS q) FROM {out})"
    out = f"(SELECT *, atanh(sin(p) / cosh(q)) - {_BEND[0]} AS psi, atan2(sinh(q), cos(p)) - {_BEND[1]} AS turn FROM {_sine(out)})"
    out = f"(SELECT *, asin(tanh(psi)) AS phi FROM {out})"
    for _ in range(5):  # Newton's steps from the conformal latitude
        out = f"(SELECT * REPLACE (phi - (atanh(sin(phi)) - {_E!r} * atanh({_E!r} * sin(phi)) - psi) * (1 - {_E2!r} * sin(phi) * sin(phi)) * cos(phi) / {1 - _E2!r} AS phi) FROM {out})"
    return f"(SELECT * EXCLUDE (p0, q0, p, q, u, v, psi, turn, phi), degrees(phi) AS lat, 15 + degrees(turn) AS lon FROM {out})"


def metres_of(source: str, lon: str, lat: str) -> str:
    """The source's rows with ``north`` and ``east`` of the geographic point (lon, lat)."""
    out = f"(SELECT *, asinh(tan(radians({lat}))) - {_E!r} * atanh({_E!r} * sin(radians({lat}))) AS psi, radians(({lon}) - 15) AS turn FROM {source})"
    out = f"(SELECT *, atan2(sinh(psi), cos(turn)) AS p, atanh(sin(turn) / cosh(psi)) AS q FROM {out})"
    for _ in range(8):
        out = f"(SELECT * EXCLUDE (u, v) REPLACE (atan2(sinh(psi + {_BEND[0]}), cos(turn + {_BEND[1]})) AS p, atanh(sin(turn + {_BEND[1]}) / cosh(psi + {_BEND[0]})) AS q) FROM {_sine(out)})"
    return f"(SELECT * EXCLUDE (p, q, psi, turn), {_METRES!r} * (p + {_sum('sin', 'cosh')}) AS north, 500000 + {_METRES!r} * (q + {_sum('cos', 'sinh')}) AS east FROM {out})"
