"""Coordinates, angles and the sun as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: GRS80 and the UTM projection.
A, INV_F, K0, EAST, SOUTH = 6378137.0, 298.257222101, 0.9996, 500000.0, 10000000.0
FLAT = 1 / INV_F
E2 = FLAT * (2 - FLAT)
EP2 = E2 / (1 - E2)


def circular_delta(a: Column, b: Column) -> Column:
    """a - b in [-180, 180)."""
    return F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180.0) / 6.0) + 1).cast("int")


def central_meridian(zone: Column) -> Column:
    return (zone - 1) * 6.0 - 177.0


def _arc(phi: Column) -> Column:
    """Length of the meridian from the equator."""
    c0 = 1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256
    c2 = 3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024
    c4 = 15 * E2**2 / 256 + 45 * E2**3 / 1024
    return A * (c0 * phi - c2 * F.sin(2 * phi) + c4 * F.sin(4 * phi) - 35 * E2**3 / 3072 * F.sin(6 * phi))


def utm_forward(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """(x, y) of the southern hemisphere by the transverse Mercator series."""
    phi, lam = F.radians(lat), F.radians(lon - central_meridian(zone))
    n = A / F.sqrt(1 - E2 * F.sin(phi) ** 2)
    t, c, a = F.tan(phi) ** 2, EP2 * F.cos(phi) ** 2, lam * F.cos(phi)
    x = EAST + K0 * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * EP2) * a**5 / 120)
    y = SOUTH + K0 * (_arc(phi) + n * F.tan(phi) * (a**2 / 2 + (5 - t + 9 * c + 4 * c * c) * a**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * EP2) * a**6 / 720))
    return x, y


def utm_inverse(x: Column, y: Column, zone: Column) -> tuple[Column, Column]:
    """(lon, lat) of a southern UTM point."""
    e1 = (1 - (1 - E2) ** 0.5) / (1 + (1 - E2) ** 0.5)
    mu = (y - SOUTH) / K0 / (A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    phi = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + 151 * e1**3 / 96 * F.sin(6 * mu) + 1097 * e1**4 / 512 * F.sin(8 * mu)
    s = 1 - E2 * F.sin(phi) ** 2
    n, r = A / F.sqrt(s), A * (1 - E2) / (s * F.sqrt(s))
    t, c, d = F.tan(phi) ** 2, EP2 * F.cos(phi) ** 2, (x - EAST) / (A / F.sqrt(s) * K0)
    lat = phi - n * F.tan(phi) / r * (d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * EP2) * d**4 / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * EP2 - 3 * c * c) * d**6 / 720)
    lon = (d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * EP2 + 24 * t * t) * d**5 / 120) / F.cos(phi)
    return F.degrees(lon) + central_meridian(zone), F.degrees(lat)


def detect_zone(x: Column, y: Column, lon_hint: Column, lat_hint: Column | None = None, tolerance: float = 1.5) -> tuple[Column, Column]:
    """(zone, degrees off): the first of the hint's zone and its neighbours before and after in which a southern UTM
    point lies within ``tolerance`` of the hint; null, and how far off the hint's own zone is, if there is none."""
    own = utm_zone(lon_hint)

    def off(zone: Column) -> Column:
        lon, lat = utm_inverse(x, y, zone)
        return F.abs(lon - lon_hint) if lat_hint is None else F.hypot(lon - lon_hint, lat - lat_hint)

    tried = [(own + k, off(own + k)) for k in (0, -1, 1)]
    pick = lambda i, rest: F.when(tried[0][1] <= tolerance, tried[0][i]).when(tried[1][1] <= tolerance, tried[1][i]).when(tried[2][1] <= tolerance, tried[2][i]).otherwise(rest)
    return pick(0, F.lit(None).cast("int")), pick(1, tried[0][1])


def convergence(lon: Column, lat: Column, zone: Column) -> Column:
    """Meridian convergence in degrees."""
    return F.degrees(F.atan(F.tan(F.radians(lon - central_meridian(zone))) * F.sin(F.radians(lat))))


def bearing(east: Column, north: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def rotate(u: Column, v: Column, degrees: Column) -> tuple[Column, Column]:
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return u * c - v * s, u * s + v * c


def solar_elevation(epoch: Column, lat: float, lon: float) -> Column:
    """Elevation of the sun in degrees by the low-precision almanac formula; ``epoch`` in seconds."""
    d = epoch / 86400.0 + 2440587.5 - 2451545.0
    g, q = F.radians(357.529 + 0.98560028 * d), 280.459 + 0.98564736 * d
    ecl, tilt = F.radians(q + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g)), F.radians(23.439 - 0.00000036 * d)
    ra, dec = F.atan2(F.cos(tilt) * F.sin(ecl), F.cos(ecl)), F.asin(F.sin(tilt) * F.sin(ecl))
    hour = F.radians(F.pmod(F.lit(18.697374558) + 24.06570982441908 * d, F.lit(24.0)) * 15.0 + lon) - ra
    phi = F.radians(F.lit(lat))
    return F.degrees(F.asin(F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.cos(hour)))


def sector(degrees: Column) -> Column:
    """One of 16 compass sectors, halves up."""
    return F.pmod(F.floor(F.pmod(degrees, F.lit(360.0)) / 22.5 + 0.5), F.lit(16)).cast("int")


def speed_bin(kmh: Column) -> Column:
    return F.when(kmh < 10, 0).when(kmh < 20, 1).when(kmh < 30, 2).when(kmh < 40, 3).otherwise(4)


def pack_int16(value: Column, scale: float) -> Column:
    """Half-even multiples of ``scale`` within the int16 range; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.least(F.bround(value / scale), F.lit(32767.0)), F.lit(-32767.0)).cast("smallint"))
