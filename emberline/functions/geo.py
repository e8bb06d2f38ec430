"""Positions, distances, boxes and grid indices as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import as_col

EARTH_KM = 6371.0
EARTH_M_SINUSOIDAL = 6371007.181  # fixed value: sphere of the sinusoidal tile grid, metres
TILE_M = 1111950.0  # fixed value: tile width, metres
X_MIN, Y_MAX = -20015109.0, 10007555.0  # fixed values: the tile grid's west and north edges, metres
TILE_PIXEL_M = 463.31271653  # fixed value: width of a "500 m" pixel, metres


def valid_degrees(lon: str | Column, lat: str | Column) -> Column:
    """True where both are degrees on the globe; NULL, NaN and sentinels give FALSE."""
    lon, lat = as_col(lon), as_col(lat)
    return F.coalesce(lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0), F.lit(False))


def is_unit(x: Column, y: Column, z: Column, tolerance: float = 1e-6) -> Column:
    return F.coalesce(F.abs(x * x + y * y + z * z - 1.0) < tolerance, F.lit(False))


def unit_xyz(lon: str | Column, lat: str | Column) -> tuple[Column, Column, Column]:
    """Unit vector of a position in degrees."""
    a, b = F.radians(as_col(lon)), F.radians(as_col(lat))
    return F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)


def position_degrees() -> tuple[Column, Column]:
    """Longitude and latitude of a detection: the degrees where valid, else from the direction; NULL if neither."""
    ok = valid_degrees("longitude", "latitude")
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    unit = is_unit(x, y, z)
    lon = F.when(ok, F.col("longitude")).when(unit, F.degrees(F.atan2(y, x)))
    lat = F.when(ok, F.col("latitude")).when(unit, F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z)))))
    return lon, lat


def position_xyz() -> tuple[Column, Column, Column]:
    """Direction of a detection: from the degrees where valid, else ``x, y, z``; NULL if neither."""
    ok = valid_degrees("longitude", "latitude")
    unit = is_unit(F.col("x"), F.col("y"), F.col("z"))
    calc = unit_xyz("longitude", "latitude")
    a, b, c = (F.when(ok, v).when(unit, F.col(n)) for v, n in zip(calc, "xyz", strict=True))
    return a, b, c


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in km of positions in degrees."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def cell_area_km2(lat: str | Column, step: float) -> Column:
    """Area of a grid cell: its height at the equator times its width at the latitude."""
    lat, zero = as_col(lat).cast("double"), F.lit(0.0)
    return haversine_km(zero, zero, zero, F.lit(float(step))) * haversine_km(zero, lat, F.lit(float(step)), lat)


def tile_of(lon: str | Column, lat: str | Column) -> dict[str, Column]:
    """Sinusoidal tile (``tile_h``, ``tile_v``) and the pixel in it whose centre is next below: row ``indx`` (from y), column ``indy`` (from x)."""
    lon, lat = F.radians(as_col(lon)), F.radians(as_col(lat))
    x = F.lit(EARTH_M_SINUSOIDAL) * lon * F.cos(lat) - X_MIN
    y = Y_MAX - F.lit(EARTH_M_SINUSOIDAL) * lat
    return {
        "tile_h": F.floor(x / TILE_M).cast("int"),
        "tile_v": F.floor(y / TILE_M).cast("int"),
        "indx": F.floor(F.pmod(y, F.lit(TILE_M)) / TILE_PIXEL_M - 0.5).cast("int"),
        "indy": F.floor(F.pmod(x, F.lit(TILE_M)) / TILE_PIXEL_M - 0.5).cast("int"),
    }


def tile_lonlat(h: Column, v: Column, row: Column, col: Column, px: float = TILE_PIXEL_M) -> tuple[Column, Column]:
    """Degrees of a pixel's centre in a sinusoidal tile."""
    x = (col + 0.5) * px + h * TILE_M + X_MIN
    y = Y_MAX - (row + 0.5) * px - v * TILE_M
    lat = y / EARTH_M_SINUSOIDAL
    return F.degrees(x / (F.lit(EARTH_M_SINUSOIDAL) * F.cos(lat))), F.degrees(lat)


@dataclass(frozen=True)
class BBox:
    """A box in degrees, east of Greenwich or not, never across the date line.  ``closed``: edges belong to it."""

    north: float
    west: float
    south: float
    east: float
    closed: bool = False

    @classmethod
    def from_order(cls, order: str, bounds: tuple[float, float, float, float], closed: bool = False) -> BBox:
        """Bounds listed in any order of the letters N, S, W, E."""
        if sorted(order) != ["E", "N", "S", "W"]:
            raise ValueError(f"{order!r} isn't an order of N, S, W, E")
        by = dict(zip(order, bounds, strict=True))
        return cls(by["N"], by["W"], by["S"], by["E"], closed)

    def predicate(self, lon: str | Column = "longitude", lat: str | Column = "latitude") -> Column:
        lon, lat = as_col(lon), as_col(lat)
        if self.closed:
            return lon.between(self.west, self.east) & lat.between(self.south, self.north)
        return (lon > self.west) & (lon < self.east) & (lat > self.south) & (lat < self.north)


#: Named boxes (north, west, south, east).
NAMED_BOXES = {
    "indonesia": BBox(8.0, 93.0, -13.0, 143.0),
    "riau": BBox(3.0, 99.0, -2.0, 104.0),
}


@dataclass(frozen=True)
class Grid:
    """A regular grid of points; each is the centre of its cell."""

    box: BBox
    step: float = 0.25
    legacy_top: bool = True

    @property
    def n_lon(self) -> int:
        return int((self.box.east - self.box.west) / self.step) + 1

    @property
    def n_lat(self) -> int:
        return int((self.box.north - self.box.south) / self.step) + 1

    @property
    def lon_edge(self) -> float:
        return self.box.west - self.step / 2

    @property
    def lat_edge(self) -> float:
        return self.box.south - self.step / 2

    @property
    def lat_bins(self) -> int:
        """With ``legacy_top`` and a box that reaches the northern half, the top half-row falls into the row below."""
        return self.n_lat - 1 if self.legacy_top and self.box.north >= 0 else self.n_lat

    def _index(self, value: str | Column, edge: float, bins: int) -> Column:
        v = as_col(value)
        inside = F.least(F.floor((v - edge) / self.step), F.lit(bins - 1))
        return F.when(v < edge, F.lit(-1)).when(v.isNotNull() & ~F.isnan(v), inside).cast("int")

    def lonind(self, lon: str | Column = "longitude") -> Column:
        """Bin of a longitude: -1 below the first edge, the last bin above the last edge; NULL for NULL and NaN."""
        return self._index(lon, self.lon_edge, self.n_lon)

    def latind(self, lat: str | Column = "latitude") -> Column:
        return self._index(lat, self.lat_edge, self.lat_bins)

    def longitude(self, lonind: str | Column = "lonind") -> Column:
        """Coordinate of an index; NULL outside of the grid."""
        i = as_col(lonind)
        return F.when(i.between(0, self.n_lon - 1), self.box.west + i * self.step)

    def latitude(self, latind: str | Column = "latind") -> Column:
        i = as_col(latind)
        return F.when(i.between(0, self.n_lat - 1), self.box.south + i * self.step)


def open_cell(lon: str | Column, lat: str | Column, step: float = 0.25, west: float = 92.875, south: float = -13.125) -> tuple[Column, Column]:
    """Cell indices of an unbounded grid: plain floors, no clamping at the edges."""
    lon, lat = as_col(lon), as_col(lat)
    return F.floor((lon - west) / step).cast("int"), F.floor((lat - south) / step).cast("int")
