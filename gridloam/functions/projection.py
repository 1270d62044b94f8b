"""From projected coordinates to degrees, as column expressions.

`Projection.of_wkt` reads the text of a .prj file: geographic coordinates, transverse Mercator, Lambert's conformal conic
with one or two parallels, and Mercator. Latitudes come from series in the third flattening, which are good to well under a
millimetre; datums are not shifted. Everything is arithmetic of columns, so rings are moved within Spark's expressions.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = {
    "transverse_mercator": "tm",
    "gauss_kruger": "tm",
    "lambert_conformal_conic": "lcc",
    "lambert_conformal_conic_1sp": "lcc",
    "lambert_conformal_conic_2sp": "lcc",
    "mercator": "merc",
    "mercator_1sp": "merc",
    "mercator_auxiliary_sphere": "sphere",
}


def _series(coefficients: list[float], angle, sin=math.sin):
    """The sum of c_j sin(2 j angle), j from 1."""
    return sum(c * sin(angle * (2 * j)) for j, c in enumerate(coefficients, 1))


@dataclass(frozen=True)
class Projection:
    """A projection by its parameters, in degrees and in units of `unit` metres."""

    kind: str = "degrees"
    a: float = 6378137.0
    inverse_flattening: float = 298.257223563
    unit: float = 1.0
    parameters: dict[str, float] = field(default_factory=dict)

    @classmethod
    def of_wkt(cls, text: str) -> Projection:
        number = r"([-+]?[\d.]+(?:[eE][-+]?\d+)?)"
        found = re.search(rf'SPHEROID\[\s*"[^"]*"\s*,\s*{number}\s*,\s*{number}', text, re.I)
        a, rf = (float(found[1]), float(found[2])) if found else (cls.a, cls.inverse_flattening)
        if not re.match(r"\s*PROJCS\b", text, re.I):
            return cls("degrees", a, rf)
        name = re.search(r'PROJECTION\[\s*"([^"]*)"', text, re.I)
        kind = KINDS.get(re.sub(r"\W+", "_", name[1]).lower() if name else "")
        if kind is None:
            raise ValueError(f"projection {name[1] if name else 'without a name'} is not supported")
        unit = re.findall(rf'UNIT\[\s*"[^"]*"\s*,\s*{number}', text, re.I)[-1]
        said = re.findall(rf'PARAMETER\[\s*"([^"]*)"\s*,\s*{number}', text, re.I)
        return cls(kind, a, rf, float(unit), {k.lower(): float(v) for k, v in said})

    def _get(self, *names: str, default: float = 0.0) -> float:
        return next((self.parameters[n] for n in names if n in self.parameters), default)

    @property
    def _n(self) -> float:
        f = 1 / self.inverse_flattening if self.inverse_flattening else 0.0
        return f / (2 - f)

    @property
    def _e(self) -> float:
        f = 1 / self.inverse_flattening if self.inverse_flattening else 0.0
        return math.sqrt(f * (2 - f))

    def _conformal(self, latitude: float) -> float:
        """The conformal latitude, both in radians."""
        s = math.sin(latitude)
        return math.atan(math.sinh(math.atanh(s) - self._e * math.atanh(self._e * s)))

    def _latitude(self, conformal: Column) -> Column:
        n = self._n
        c = [
            2 * n - 2 / 3 * n**2 - 2 * n**3 + 116 / 45 * n**4,
            7 / 3 * n**2 - 8 / 5 * n**3 - 227 / 45 * n**4,
            56 / 15 * n**3 - 136 / 35 * n**4,
            4279 / 630 * n**4,
        ]
        return conformal + _series(c, conformal, F.sin)

    def degrees(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(longitude, latitude) of projected coordinates."""
        if self.kind == "degrees":
            return x, y
        x = (x - self._get("false_easting")) * self.unit
        y = (y - self._get("false_northing")) * self.unit
        k = self._get("scale_factor", default=1.0)
        turn = math.radians(self._get("central_meridian", "longitude_of_center", "longitude_of_origin"))
        at = math.radians(self._get("latitude_of_origin", "latitude_of_center"))
        if self.kind == "tm":
            east, north = self._transverse(x, y, k, at)
        elif self.kind == "lcc":
            east, north = self._conic(x, y, k, at)
        else:
            if self.kind == "merc":  # the scale on the parallel that is true to length
                s = math.sin(math.radians(self._get("standard_parallel_1")))
                k *= math.sqrt(1 - s**2) / math.sqrt(1 - (self._e * s) ** 2)
            east, north = x / (self.a * k), F.atan(F.sinh(y / (self.a * k)))
            north = north if self.kind == "sphere" else self._latitude(north)
        return F.degrees(east + turn), F.degrees(north)

    def _transverse(self, x: Column, y: Column, k: float, at: float) -> tuple[Column, Column]:
        n = self._n
        radius = k * self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        up = [
            n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4,
            13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4,
            61 / 240 * n**3 - 103 / 140 * n**4,
            49561 / 161280 * n**4,
        ]
        down = [
            n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 / 1440 * n**4,
            17 / 480 * n**3 - 37 / 840 * n**4,
            4397 / 161280 * n**4,
        ]
        chi = self._conformal(at)
        xi, eta = y / radius + chi + _series(up, chi), x / radius
        north = xi - sum(c * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) for j, c in enumerate(down, 1))
        east = eta - sum(c * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) for j, c in enumerate(down, 1))
        return F.atan2(F.sinh(east), F.cos(north)), self._latitude(F.asin(F.sin(north) / F.cosh(east)))

    def _conic(self, x: Column, y: Column, k: float, at: float) -> tuple[Column, Column]:
        def scale(latitude: float) -> tuple[float, float]:
            s = math.sin(latitude)
            t = math.tan(math.pi / 4 - self._conformal(latitude) / 2)
            return math.cos(latitude) / math.sqrt(1 - (self._e * s) ** 2), t

        first = math.radians(self._get("standard_parallel_1", default=math.degrees(at)))
        second = math.radians(self._get("standard_parallel_2", default=math.degrees(first)))
        (m1, t1), (m2, t2), (_, t0) = scale(first), scale(second), scale(at)
        n = math.sin(first) if abs(first - second) < 1e-12 else math.log(m1 / m2) / math.log(t1 / t2)
        size = self.a * k * m1 / (n * t1**n)
        top = size * t0**n
        sign = math.copysign(1.0, n)
        rho = F.sqrt(x * x + (F.lit(top) - y) * (F.lit(top) - y))
        t = F.pow(rho / abs(size), F.lit(1 / n))
        return F.atan2(x * sign, (F.lit(top) - y) * sign) / n, self._latitude(F.lit(math.pi / 2) - F.atan(t) * 2)

    def rings(self, rings: Column) -> Column:
        """Rings of points (x, y) moved to degrees."""
        if self.kind == "degrees":
            return rings

        def moved(p: Column) -> Column:
            lon, lat = self.degrees(p["x"], p["y"])
            return F.struct(lon.alias("x"), lat.alias("y"))

        return F.transform(rings, lambda ring: F.transform(ring, moved))
