"""Distances, equal-size hexagons and the grid cells behind radius joins."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0  # a little short of the true 111.19, so that cells are never too small
_OFFSET = 1 << 20
_SPAN = 1 << 21


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    lat1, lng1, lat2, lng2 = (_num(v) for v in (lat1, lng1, lat2, lng2))
    s_lat = F.sin(F.radians(lat2 - lat1) / F.lit(2.0))
    s_lng = F.sin(F.radians(lng2 - lng1) / F.lit(2.0))
    a = s_lat * s_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s_lng * s_lng
    return F.lit(2.0 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def haversine_m(lat1, lng1, lat2, lng2) -> Column:
    return haversine_km(lat1, lng1, lat2, lng2) * F.lit(1000.0)


def unit_vector(lat: Column, lng: Column) -> Column:
    """struct<x, y, z> on the unit sphere."""
    la, lo = F.radians(lat), F.radians(lng)
    return F.struct(
        (F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"), F.sin(la).alias("z")
    )


def fixed_unit_vector(lat: float, lng: float) -> tuple[float, float, float]:
    la, lo = math.radians(lat), math.radians(lng)
    return math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)


def chord2(u: Column, v: Column) -> Column:
    """Squared straight-line distance of two unit vectors; grows with the distance on the ground."""
    dx, dy, dz = u["x"] - v["x"], u["y"] - v["y"], u["z"] - v["z"]
    return dx * dx + dy * dy + dz * dz


def chord2_of_km(km: float) -> float:
    return (2.0 * math.sin(km / (2.0 * EARTH_KM))) ** 2


def in_box(lat: Column, lng: Column, box) -> Column:
    """Inclusive bounding box; values that are not numbers are outside."""
    lat, lng = lat.try_cast("double"), lng.try_cast("double")
    inside = lat.between(box.lat_min, box.lat_max) & lng.between(box.lng_min, box.lng_max)
    return F.coalesce(inside, F.lit(False))


@dataclass(frozen=True)
class HexGrid:
    """Pointy-top hexagons on a local plane around (lat0, lng0).

    Equal-size cells with a bigint id made of the axial coordinates. Resolution 8
    has a mean cell area of about 0.74 km2; each step changes the area sevenfold.
    """

    lat0: float
    lng0: float
    resolution: int = 8

    @property
    def edge_km(self) -> float:
        return 0.5332 * 7 ** ((8 - self.resolution) / 2)

    @property
    def _cos0(self) -> float:
        return math.cos(math.radians(self.lat0))

    def cell(self, lat: Column, lng: Column) -> Column:
        x = F.lit(EARTH_KM) * F.radians(lng - F.lit(self.lng0)) * F.lit(self._cos0)
        y = F.lit(EARTH_KM) * F.radians(lat - F.lit(self.lat0))
        fq = (F.lit(math.sqrt(3) / 3) * x - y / F.lit(3.0)) / F.lit(self.edge_km)
        fr = (F.lit(2.0 / 3.0) * y) / F.lit(self.edge_km)
        fs = -fq - fr
        q, r, s = (F.floor(v + F.lit(0.5)) for v in (fq, fr, fs))
        dq, dr, ds = F.abs(q - fq), F.abs(r - fr), F.abs(s - fs)
        fix_q = (dq > dr) & (dq > ds)
        fix_r = (~fix_q) & (dr > ds)
        q2 = F.when(fix_q, -r - s).otherwise(q)
        r2 = F.when(fix_r, -q - s).otherwise(r)
        return ((q2 + F.lit(_OFFSET)) * F.lit(_SPAN) + r2 + F.lit(_OFFSET)).cast("bigint")

    def _centre_xy(self, cell: Column) -> tuple[Column, Column]:
        q = F.shiftright(cell, 21) - F.lit(_OFFSET)
        r = cell % F.lit(_SPAN) - F.lit(_OFFSET)
        x = F.lit(self.edge_km * math.sqrt(3)) * (q + r / F.lit(2.0))
        y = F.lit(self.edge_km * 1.5) * r
        return x, y

    def _to_latlng(self, x: Column, y: Column) -> Column:
        return F.struct(
            (F.lit(self.lat0) + F.degrees(y / F.lit(EARTH_KM))).alias("lat"),
            (F.lit(self.lng0) + F.degrees(x / F.lit(EARTH_KM * self._cos0))).alias("lng"),
        )

    def centre(self, cell: Column) -> Column:
        return F.when(cell.isNotNull(), self._to_latlng(*self._centre_xy(cell)))

    def boundary(self, cell: Column) -> Column:
        """Six corners, counter-clockwise, as array<struct<lat,lng>>."""
        x, y = self._centre_xy(cell)
        corners = []
        for k in range(6):
            angle = math.radians(60 * k - 30)
            corners.append(
                self._to_latlng(
                    x + F.lit(self.edge_km * math.cos(angle)), y + F.lit(self.edge_km * math.sin(angle))
                )
            )
        return F.when(cell.isNotNull(), F.array(*corners))


@dataclass(frozen=True)
class RadiusCells:
    """Square-ish cells at least ``radius_m`` wide at every latitude.

    Two points closer than the radius always lie in the same or in touching cells,
    so a radius join becomes an equi-join on ``home`` against exploded ``around``.
    """

    radius_m: float

    @property
    def step(self) -> float:
        return self.radius_m / 1000.0 / KM_PER_DEGREE

    def _row(self, lat: Column) -> Column:
        return F.floor(lat / F.lit(self.step)).cast("bigint")

    def _width(self, row: Column) -> Column:
        far = F.greatest(F.abs(row), F.abs(row + 1)) * F.lit(self.step)
        # the last degree before a pole is one cell all around
        return F.when(far > 89.0, F.lit(360.0)).otherwise(F.lit(self.step) / F.cos(F.radians(far)))

    @staticmethod
    def _east(lng: Column) -> Column:
        """Degrees east of the date line, below 360."""
        return F.pmod(lng + F.lit(180.0), F.lit(360.0))

    @staticmethod
    def _key(row: Column, col: Column) -> Column:
        return row * F.lit(1 << 32) + col

    def _keys(self, row: Column, cols: Column) -> Column:
        return F.transform(cols, lambda c: self._key(row, c))

    def home(self, lat: Column, lng: Column) -> Column:
        row = self._row(lat)
        return self._key(row, F.floor(self._east(lng) / self._width(row)).cast("bigint"))

    def around(self, lat: Column, lng: Column) -> Column:
        row = self._row(lat)
        reach = F.greatest(self._width(row - 1), self._width(row + 1))
        low, high = self._east(lng) - reach, self._east(lng) + reach
        parts = [self._keys(row + F.lit(d), self._columns(row + F.lit(d), low, high)) for d in (-1, 0, 1)]
        return F.when(lat.isNotNull() & lng.isNotNull(), F.concat(*parts))

    def touched(self, lat: Column, lng: Column, radius_m: float) -> Column:
        """The cells that points within ``radius_m`` of a place can lie in: few if cells are much wider."""
        near = F.lit(radius_m / 1000.0 / KM_PER_DEGREE)
        far = F.abs(lat) + near
        wide = F.when(far > 89.0, F.lit(360.0)).otherwise(near / F.cos(F.radians(far)))
        low, high = self._east(lng) - wide, self._east(lng) + wide
        rows = F.sequence(self._row(lat - near), self._row(lat + near))
        keys = F.flatten(F.transform(rows, lambda r: self._keys(r, self._columns(r, low, high))))
        return F.when(lat.isNotNull() & lng.isNotNull(), keys)

    def _columns(self, row: Column, low: Column, high: Column) -> Column:
        """Columns of a row between two degrees east of the date line, which may lie beyond it."""
        w = self._width(row)
        last = F.floor(F.lit(360.0) / w).cast("bigint")
        none = F.array().cast("array<bigint>")

        def column(degrees: Column) -> Column:
            return F.least(F.greatest(F.floor(degrees / w).cast("bigint"), F.lit(0).cast("bigint")), last)

        # the row is a ring: what reaches over the date line goes on at its other end
        cols = F.concat(
            F.sequence(column(low), column(high)),
            F.when(low < 0, F.sequence(column(low + 360.0), last)).otherwise(none),
            F.when(high >= 360.0, F.sequence(F.lit(0).cast("bigint"), column(high - 360.0))).otherwise(none),
        )
        return F.array_distinct(cols)

    def reach(self, lat: Column, lng: Column, km: Column) -> Column:
        """array<struct<row, col, cell>>: the cells that points within ``km`` of a place can lie in, and a few more."""
        steps = (F.floor(km / F.lit(self.radius_m / 1000.0)) + 1).cast("bigint")
        row = self._row(lat)
        wide = F.greatest(self._width(row - steps), self._width(row + steps)) * steps
        low, high = self._east(lng) - wide, self._east(lng) + wide
        none = F.array().cast("array<bigint>")

        def of_row(r: Column) -> Column:
            w = self._width(r)
            last = F.floor(F.lit(360.0) / w).cast("bigint")

            def column(degrees: Column) -> Column:
                return F.least(F.greatest(F.floor(degrees / w).cast("bigint"), F.lit(0).cast("bigint")), last)

            cols = F.concat(
                F.sequence(column(low), column(high)),
                F.when(low < 0, F.sequence(column(low + 360.0), last)).otherwise(none),
                F.when(high >= 360.0, F.sequence(F.lit(0).cast("bigint"), column(high - 360.0))).otherwise(none),
            )
            return F.transform(
                F.array_distinct(cols), lambda c: F.struct(r.alias("row"), c.alias("col"), self._key(r, c).alias("cell"))
            )

        return F.when(lat.isNotNull() & lng.isNotNull() & (km >= 0), F.flatten(F.transform(F.sequence(row - steps, row + steps), of_row)))

    def farthest_km(self, row: Column, col: Column, lat: Column, lng: Column) -> Column:
        """Distance from a place to the farthest point of a cell, which is a corner; null for cells around a pole.

        Along a parallel the distance grows with the difference in longitude, and along a meridian it is largest at
        an end, unless the cell holds the place's antipode, whose corners are far away as well.
        """
        w, south = self._width(row), row * F.lit(self.step)
        corners = [
            haversine_km(lat, lng, south + F.lit(d * self.step), (col + F.lit(e)) * w - F.lit(180.0)) for d in (0, 1) for e in (0, 1)
        ]
        return F.when(w < 90.0, F.greatest(*corners))
