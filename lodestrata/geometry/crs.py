"""Closed-form map projections. The operation is always named by the caller, never guessed.

Ellipsoids and parameters are fixed public values of the EPSG definitions.
"""

from __future__ import annotations

import numpy as np

# Semi-major axis and inverse flattening.
GRS80 = (6378137.0, 298.257222101)
WGS84 = (6378137.0, 298.257223563)
# Parameters of the projected systems.
TM_19N = {"ellipsoid": GRS80, "lon0": -69.0, "k0": 0.9996, "x0": 500000.0, "y0": 0.0}
ALBERS_US = {"ellipsoid": GRS80, "lat0": 23.0, "lon0": -96.0, "lat1": 29.5, "lat2": 45.5}
OPERATIONS = ("4269:26919", "26919:4269", "4269:5070", "5070:4269", "4326:3857", "3857:4326")


def _series(ellipsoid):
    n = 1 / (2 * ellipsoid[1] - 1)
    radius = ellipsoid[0] / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    backward = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    lat = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    return n, radius, forward, backward, lat


def to_transverse_mercator(lon, lat, p=TM_19N):
    """Degrees to metres by the Krueger series (millimetres within a zone)."""
    n, radius, alpha, _, _ = _series(p["ellipsoid"])
    phi, lam = np.radians(lat), np.radians(np.asarray(lon) - p["lon0"])
    k = 2 * np.sqrt(n) / (1 + n)
    t = np.sinh(np.arctanh(np.sin(phi)) - k * np.arctanh(k * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    north = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
    east = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
    return p["x0"] + p["k0"] * radius * east, p["y0"] + p["k0"] * radius * north


def from_transverse_mercator(x, y, p=TM_19N):
    _, radius, _, beta, delta = _series(p["ellipsoid"])
    xi, eta = (np.asarray(y) - p["y0"]) / (p["k0"] * radius), (np.asarray(x) - p["x0"]) / (p["k0"] * radius)
    a = xi - sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(beta, 1))
    e = eta - sum(b * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, b in enumerate(beta, 1))
    chi = np.arcsin(np.sin(a) / np.cosh(e))
    lat = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(delta, 1))
    return p["lon0"] + np.degrees(np.arctan2(np.sinh(e), np.cos(a))), np.degrees(lat)


def _q(phi, e):
    s = np.sin(phi)
    return (1 - e * e) * (s / (1 - (e * s) ** 2) - np.log((1 - e * s) / (1 + e * s)) / (2 * e))


def _albers(p):
    a, inverse = p["ellipsoid"]
    f = 1 / inverse
    e = np.sqrt(2 * f - f * f)
    lat0, lat1, lat2 = (np.radians(p[k]) for k in ("lat0", "lat1", "lat2"))
    m = lambda t: np.cos(t) / np.sqrt(1 - (e * np.sin(t)) ** 2)
    n = (m(lat1) ** 2 - m(lat2) ** 2) / (_q(lat2, e) - _q(lat1, e))
    c = m(lat1) ** 2 + n * _q(lat1, e)
    return a, e, n, c, a * np.sqrt(c - n * _q(lat0, e)) / n


def to_albers(lon, lat, p=ALBERS_US):
    a, e, n, c, rho0 = _albers(p)
    rho = a * np.sqrt(c - n * _q(np.radians(lat), e)) / n
    theta = n * np.radians(np.asarray(lon) - p["lon0"])
    return rho * np.sin(theta), rho0 - rho * np.cos(theta)


def from_albers(x, y, p=ALBERS_US):
    a, e, n, c, rho0 = _albers(p)
    x, y = np.asarray(x, float), np.asarray(y, float)
    q = (c - (np.hypot(x, rho0 - y) * n / a) ** 2) / n
    phi = np.arcsin(np.clip(q / 2, -1, 1))
    for _ in range(8):
        s = np.sin(phi)
        phi = phi + (1 - (e * s) ** 2) ** 2 / (2 * np.cos(phi)) * (q / (1 - e * e) - s / (1 - (e * s) ** 2) + np.log((1 - e * s) / (1 + e * s)) / (2 * e))
    return p["lon0"] + np.degrees(np.arctan2(x, rho0 - y) / n), np.degrees(phi)


def to_web_mercator(lon, lat):
    r = WGS84[0]
    return r * np.radians(lon), r * np.arctanh(np.sin(np.radians(lat)))


def from_web_mercator(x, y):
    r = WGS84[0]
    return np.degrees(np.asarray(x) / r), np.degrees(np.arcsin(np.tanh(np.asarray(y) / r)))


def transform(x, y, operation: str):
    """Coordinates through a named operation, e.g. 4269:26919."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation}")
    steps = {
        "4269:26919": to_transverse_mercator, "26919:4269": from_transverse_mercator, "4269:5070": to_albers,
        "5070:4269": from_albers, "4326:3857": to_web_mercator, "3857:4326": from_web_mercator,
    }
    return steps[operation](np.asarray(x, float), np.asarray(y, float))
