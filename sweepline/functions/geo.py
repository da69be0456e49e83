"""Geodetic expressions; angles in degrees, lengths in metres, ellipsoid WGS 84 unless given."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ellipsoid:
    a: float = 6378137.0
    f: float = 1 / 298.257223563

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)


WGS84 = Ellipsoid()


def lla_vec(lat: Column, lon: Column, alt: Column) -> Column:
    """Latitude and longitude in radians, and altitude."""
    return F.array(F.radians(lat), F.radians(lon), alt)


def ecef(lat: Column, lon: Column, alt: Column, on: Ellipsoid = WGS84) -> tuple[Column, Column, Column]:
    """Earth-centred, earth-fixed coordinates."""
    phi, lam = F.radians(lat), F.radians(lon)
    n = F.lit(on.a) / F.sqrt(1 - F.lit(on.e2) * F.sin(phi) * F.sin(phi))
    return (n + alt) * F.cos(phi) * F.cos(lam), (n + alt) * F.cos(phi) * F.sin(lam), (n * F.lit(1 - on.e2) + alt) * F.sin(phi)


def enu(lat: Column, lon: Column, alt: Column, origin: tuple[float, float, float], on: Ellipsoid = WGS84) -> tuple[Column, Column, Column]:
    """East, north, up from an origin (degrees, degrees, metres)."""
    here, there = ecef(lat, lon, alt, on), ecef(*(F.lit(float(v)) for v in origin), on)
    dx, dy, dz = (a - b for a, b in zip(here, there, strict=True))
    phi, lam = F.radians(F.lit(float(origin[0]))), F.radians(F.lit(float(origin[1])))
    east = -F.sin(lam) * dx + F.cos(lam) * dy
    north = -F.sin(phi) * F.cos(lam) * dx - F.sin(phi) * F.sin(lam) * dy + F.cos(phi) * dz
    up = F.cos(phi) * F.cos(lam) * dx + F.cos(phi) * F.sin(lam) * dy + F.sin(phi) * dz
    return east, north, up


def ned(lat: Column, lon: Column, alt: Column, origin: tuple[float, float, float], on: Ellipsoid = WGS84) -> tuple[Column, Column, Column]:
    """North, east, down from an origin."""
    east, north, up = enu(lat, lon, alt, origin, on)
    return north, east, -up
