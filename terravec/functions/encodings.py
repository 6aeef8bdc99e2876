"""Positional encodings of points: Column expressions giving array<double>, one row in, one row out, no shuffle."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from terravec.functions import geo

#: Three unit vectors 120 degrees apart.
DIRECTIONS = ((1.0, 0.0), (-0.5, math.sqrt(3) / 2), (-0.5, -math.sqrt(3) / 2))


def freq_list(n: int, max_radius: float, min_radius: float = 1.0, kind: str = "geometric", seed: int = 42) -> list[float]:
    """Frequencies: geometric between the radii, random up to max_radius, or powers of two times pi."""
    if kind == "geometric":
        step = math.log(max_radius / min_radius) / (n - 1) if n > 1 else 0.0
        return [1.0 / (min_radius * math.exp(i * step)) for i in range(n)]
    if kind == "random":
        return (np.random.default_rng(seed).random(n) * max_radius).tolist()
    if kind == "nerf":
        return [math.pi * 2.0**i for i in range(n)]
    raise ValueError(f"unknown kind of frequencies: {kind}")


def _array(parts: list[Column]) -> Column:
    return F.array(*parts)


def direct(lon: Column, lat: Column) -> Column:
    return F.array(F.radians(lon) - math.pi, F.radians(lat) - math.pi)


def cartesian3d(lon: Column, lat: Column) -> Column:
    x, y = F.radians(lon), F.radians(lat)
    return F.array(F.cos(x) * F.cos(y), F.sin(x) * F.cos(y), F.sin(y))


def wrap(lon: Column, lat: Column) -> Column:
    x, y = F.radians(lon), F.radians(lat)
    return F.array(F.cos(x), F.sin(x), F.cos(y), F.sin(y))


def grid(lon: Column, lat: Column, freqs: list[float]) -> Column:
    """Per coordinate and frequency (sine, cosine); degrees as they are. gridcell and gridcellnorm are the same numbers."""
    return _array([g(c * f) for c in (lon, lat) for f in freqs for g in (F.sin, F.cos)])


gridcell = gridcellnorm = grid


def _twice(parts: list[Column]) -> list[Column]:
    return [p for p in parts for _ in range(2)]


def spherec(lon: Column, lat: Column, freqs: list[float]) -> Column:
    out = []
    for f in freqs:
        x, y = lon * f, lat * f
        out += _twice([F.sin(y), F.cos(y) * F.cos(x), F.cos(y) * F.sin(x)])
    return _array(out)


def spherecplus(lon: Column, lat: Column, freqs: list[float]) -> Column:
    out = []
    for f in freqs:
        x, y = lon * f, lat * f
        out += _twice([F.sin(y), F.cos(y), F.sin(x), F.cos(x), F.cos(y) * F.cos(x), F.cos(y) * F.sin(x)])
    return _array(out)


def _mixed(lon: Column, lat: Column, f: float) -> list[Column]:
    """Products of one scaled with one unscaled angle."""
    x, y = lon * f, lat * f
    return [F.cos(y) * F.cos(lon), F.cos(lat) * F.cos(x), F.cos(y) * F.sin(lon), F.cos(lat) * F.sin(x)]


def spherem(lon: Column, lat: Column, freqs: list[float]) -> Column:
    return _array([c for f in freqs for c in _twice([F.sin(lat * f), *_mixed(lon, lat, f)])])


def spheremplus(lon: Column, lat: Column, freqs: list[float]) -> Column:
    out = []
    for f in freqs:
        x, y = lon * f, lat * f
        out += _twice([F.sin(y), F.cos(y), F.sin(x), F.cos(x), *_mixed(lon, lat, f)])
    return _array(out)


def _directed(lon: Column, lat: Column, freqs: list[float]) -> list[Column]:
    return [(lon * a + lat * b) * f for f in freqs for a, b in DIRECTIONS]


def csp_theory(lon: Column, lat: Column, freqs: list[float]) -> Column:
    """Per frequency sine and cosine of the three directions' angles."""
    return _array([g(a) for a in _directed(lon, lat, freqs) for g in (F.sin, F.cos)])


def csp_theorynorm(lon: Column, lat: Column, freqs: list[float]) -> Column:
    return csp_theory(F.radians(lon), F.radians(lat), freqs)


def csp_theorydiag(lon: Column, lat: Column, freqs: list[float]) -> Column:
    """csp_theory kept as one array of six per frequency."""
    return _array([csp_theory(lon, lat, [f]) for f in freqs])


def theory(lon: Column, lat: Column, freqs: list[float]) -> Column:
    """The same angles in two halves; whether sine or cosine comes first starts anew in each half."""
    angles = [a for a in _directed(lon, lat, freqs) for _ in range(2)]
    half = len(angles) // 2
    return _array([(F.sin if (i % half) % 2 == 0 else F.cos)(a) for i, a in enumerate(angles)])


def hexagrid(lon: Column, lat: Column, n: int, max_radius: float) -> Column:
    """Per coordinate and frequency the sine at three phases."""
    by = [max_radius ** (i / (n - 1)) if n > 1 else 1.0 for i in range(n)]
    return _array([F.sin(c / d + phase) for c in (lon, lat) for d in by for phase in (0.0, math.pi * 2.0 / 3, math.pi * 4.0 / 3)])


def naive(lon: Column, lat: Column, extent: tuple[float, float, float, float] | None = None) -> Column:
    return F.array(*geo.normalize_extent(lon, lat, extent))


def rbf(lon: Column, lat: Column, anchors: list[tuple[float, float]], sigma: float, ratio: float = 0.0) -> Column:
    """One kernel per anchor; with a ratio an anchor's width grows with its distance from zero."""
    out = []
    for x, y in anchors:
        s = math.hypot(x, y) * ratio + sigma if ratio > 0 else sigma
        out.append(F.exp(-((lon - x) * (lon - x) + (lat - y) * (lat - y)) / (2.0 * s * s)))
    return _array(out)


def rff(lon: Column, lat: Column, directions: list[tuple[float, float]], shifts: list[float], extent: tuple[float, float, float, float] | None = None) -> Column:
    x, y = geo.normalize_extent(lon, lat, extent)
    scale = math.sqrt(2.0 / len(directions))
    return _array([F.cos(x * a + y * b + s) * scale for (a, b), s in zip(directions, shifts, strict=True)])


def sin_cos(lon: Column, lat: Column) -> Column:
    x, y = geo.normalize_global(lon, lat)
    return F.array(F.sin(x * math.pi), F.sin(y * math.pi), F.cos(x * math.pi), F.cos(y * math.pi))


geo_net_fft = sin_cos


def encode_date(fraction: Column, how: str = "encode_cos_sin") -> Column:
    """A year's fraction in [0, 1] as (sine, cosine), or as itself in [-1, 1]."""
    d = fraction * 2 - 1
    return F.array(d) if how == "encode_none" else F.array(F.sin(d * math.pi), F.cos(d * math.pi))


def date_fraction(ts: Column) -> Column:
    return (F.dayofyear(ts) - 1) / 365.0


def loc_time(lon: Column, lat: Column, fraction: Column | None = None, loc: str = "encode_cos_sin", date: str = "encode_cos_sin") -> Column:
    """Location (cosine and sine, 3D, or none) and, where given, date."""
    x, y = geo.normalize_global(lon, lat)
    if loc == "encode_cos_sin":
        out = sin_cos(lon, lat)
    elif loc == "encode_3D":
        out = F.array(F.cos(x * math.pi) * F.cos(y * math.pi), F.sin(x * math.pi) * F.cos(y * math.pi), F.sin(y * math.pi))
    else:
        out = F.array(x, y)
    return out if fraction is None else F.concat(out, encode_date(fraction, date))


def harmonics(lon: np.ndarray, lat: np.ndarray, degree: int) -> np.ndarray:
    """Real spherical harmonics, orders 0 to degree - 1, each with m from -l to l. Legendre values by the usual recurrences,
    shared by all orders of one m."""
    phi, theta = np.radians(lon + 180), np.radians(lat + 90)
    x, s = np.cos(theta), np.sqrt(np.maximum(1 - np.cos(theta) ** 2, 0))
    out = np.empty((len(lon), degree * degree))
    diagonal = np.ones_like(x)
    for m in range(degree):
        if m:
            diagonal = diagonal * -(2 * m - 1) * s
        below, now = np.zeros_like(x), diagonal
        for l in range(m, degree):
            k = math.sqrt((2 * l + 1) / (4 * math.pi) * math.exp(math.lgamma(l - m + 1) - math.lgamma(l + m + 1)))
            if m == 0:
                out[:, l * l + l] = k * now
            else:
                out[:, l * l + l + m] = math.sqrt(2) * k * np.cos(m * phi) * now
                out[:, l * l + l - m] = math.sqrt(2) * k * np.sin(m * phi) * now
            below, now = now, ((2 * l + 1) * x * now - (l + m) * below) / (l - m + 1)
    return out


def spherical_harmonics(lon: Column, lat: Column, degree: int = 10) -> Column:
    """Closed form, degree squared numbers."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(list(harmonics(x.to_numpy(float), y.to_numpy(float), degree)))

    return run(lon, lat)


def analytic_factors(degree: int) -> list[float]:
    """What turns the closed form into the analytic one: (-1)^m for m other than 0, pi for m = 0."""
    return [math.pi if m == 0 else (-1.0) ** m for l in range(degree) for m in range(-l, l + 1)]


def spherical_harmonics_analytic(lon: Column, lat: Column, degree: int = 10) -> Column:
    return F.zip_with(spherical_harmonics(lon, lat, degree), F.array(*map(F.lit, analytic_factors(degree))), lambda a, b: a * b)


def harmonic_weight_rows(degree: int) -> list[tuple[int, int]]:
    """Where the weight of each (l, m) is: [l, m], or [-l, m] with negative indices from the end."""
    return [(l, m) if m >= 0 else (-l % degree, m % degree) for l in range(degree) for m in range(-l, l + 1)]


def spherical_harmonics_weighted(lon: Column, lat: Column, weights: np.ndarray) -> Column:
    """weights[l, m, e] -> e numbers, each the weighted sum of the analytic harmonics."""
    degree = weights.shape[0]
    y = spherical_harmonics_analytic(lon, lat, degree)
    rows = harmonic_weight_rows(degree)
    total = lambda e: F.aggregate(F.zip_with(y, F.array(*(F.lit(float(weights[l, m, e])) for l, m in rows)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.array(*(total(e) for e in range(weights.shape[2])))


def concat_all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: F.concat(a, b), parts)
