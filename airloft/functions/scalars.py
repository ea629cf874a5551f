"""Scalar functions: keys, dates, distances, grids, units, scales and proxies."""

from __future__ import annotations

from functools import reduce
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_RADIUS, MILES_RADIUS = 6371.0, 3959.0
#: Boxes as (south, north, west, east).
REGION_BOX = (25.5, 36.6, -107.0, -93.0)

# Reference points (latitude, longitude) of the coast and of large metros.
COAST = ((25.97, -97.50), (27.80, -97.40), (28.93, -95.97), (29.30, -94.79), (29.70, -93.90))
METROS = ((32.78, -96.80), (29.76, -95.37), (30.27, -97.74), (29.42, -98.49), (32.75, -97.33), (31.76, -106.49))


def null_nan(c: Column) -> Column:
    """NaN as null: means and medians here skip both."""
    return F.when(~F.isnan(c), c)


def number(c: Column) -> Column:
    """A double, or null where the text is none."""
    return null_nan(F.expr("try_cast({} AS double)".format(c)) if isinstance(c, str) else c.try_cast("double"))


# Keys


def pad_key(c: Column, n: int) -> Column:
    """Left-padded with zeros to n characters; longer text is left whole."""
    text = c.cast("string")
    return F.when(F.length(text) < n, F.lpad(text, n, "0")).otherwise(text)


def normalize_geoid(c: Column) -> Column:
    """11-character tract key of anything that reads as a number, else null."""
    return pad_key(number(c).cast("bigint").cast("string"), 11)


def fips_key(state: Column, county: Column, tract: Column) -> Column:
    return F.concat(pad_key(state, 2), pad_key(county, 3), pad_key(tract, 6))


def county_of(geoid: Column) -> Column:
    return F.substring(geoid, 1, 5)


def tract_suffix(geoid: Column) -> Column:
    return F.right(geoid, F.lit(6))


def strip_county(name: Column) -> Column:
    return F.regexp_replace(name, "(?i) County$", "")


def canon_id(c: Column) -> Column:
    """A numeric id as plain text."""
    return number(c).cast("bigint").cast("string")


def has_prefix(c: Column, prefix: str) -> Column:
    return c.startswith(prefix)


# Positions


def in_box(lat: Column, lon: Column, box=REGION_BOX) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def parse_latlon(text: Column, box=REGION_BOX) -> Column:
    """struct(lat, lon, error): error is 'format', 'number' or 'bounds', or null where the pair is good."""
    parts = F.split(text, ",")
    lat, lon = number(F.trim(F.get(parts, 0))), number(F.trim(F.get(parts, 1)))
    error = (
        F.when(text.isNull() | (F.size(parts) != 2), "format")
        .when(lat.isNull() | lon.isNull(), "number")
        .when(~in_box(lat, lon, box), "bounds")
    )
    good = error.isNull()
    return F.struct(F.when(good, lat).alias("lat"), F.when(good, lon).alias("lon"), error.alias("error"))


def _half_chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2) - F.radians(lat1), F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return 2 * KM_RADIUS * F.asin(F.sqrt(_half_chord(lat1, lon1, lat2, lon2)))


def haversine_mi(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = _half_chord(lat1, lon1, lat2, lon2)
    return 2 * MILES_RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def min_dist(lat: Column, lon: Column, points) -> Column:
    """Kilometres to the nearest of a few constant points; no join."""
    away = [haversine_km(lat, lon, F.lit(float(a)), F.lit(float(b))) for a, b in points]
    return F.least(*away) if len(away) > 1 else away[0]


def cell_index(c: Column, deg: float) -> Column:
    """Integer grid index, half to even."""
    return F.rint(c / deg).cast("int")


def cell_key(lat: Column, lon: Column, deg: float) -> Column:
    """Text key of a grid cell for display; joins use cell_index."""
    return F.format_string("%.1f,%.1f", F.rint(lat / deg) * deg, F.rint(lon / deg) * deg)


# Time


def to_day(c: Column) -> Column:
    return F.try_to_timestamp(c).cast("date")


def epoch_day(c: Column) -> Column:
    """UTC day of epoch seconds."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c / 86400).cast("int"))


def ymd(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd")


def from_ymd(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyyMMdd")).cast("date")


def weekday(c: Column) -> Column:
    """Monday is 0."""
    return F.weekday(c)


def cyclic(c: Column, period: float) -> tuple[Column, Column]:
    angle = 2 * pi * c / period
    return F.sin(angle), F.cos(angle)


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "Winter").when(month.isin(3, 4, 5), "Spring").when(month.isin(6, 7, 8), "Summer").when(month.isin(9, 10, 11), "Fall")


# Units and scales


def c_to_f(c: Column) -> Column:
    return c * 9.0 / 5.0 + 32.0


def ms_to_mph(c: Column) -> Column:
    return c * 2.23694


def kmh_to_ms(c: Column) -> Column:
    return c / 3.6


def kpa_to_hpa(c: Column) -> Column:
    return c * 10.0


def null_if_sentinel(c: Column, sentinel: float = -999.0) -> Column:
    return F.when(c != sentinel, c)


def fit_scale(c: Column) -> Column:
    return F.log1p(c)


def orig_scale(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.expm1(c))


def display_float(c: Column) -> Column:
    """One decimal for display; 0 for null, NaN or text that is no number."""
    return F.coalesce(F.bround(number(c), 1), F.lit(0.0))


def urban_index(traffic: Column, diesel: Column, ej: Column) -> Column:
    zero = lambda c: F.coalesce(number(c), F.lit(0.0))
    return (zero(traffic) * 0.4 + zero(diesel) * 0.3 + zero(ej) * 0.3) / 100.0


def coast_proxy(lon: Column) -> Column:
    return F.abs(F.coalesce(number(lon), F.lit(-97.0)) + 94.0)


def border_proxy(lat: Column) -> Column:
    return F.abs(F.coalesce(number(lat), F.lit(31.0)) - 26.0)


def soft_norm(c: Column, top: Column, floor: float, clip: float = 1.0) -> Column:
    """c relative to a percentile that counts as `floor` at least, clipped, on 0..1."""
    return F.least(F.greatest(c / F.greatest(top, F.lit(float(floor))), F.lit(0.0)), F.lit(float(clip))) / clip


def display_precision(c: Column, digits: int = 6) -> Column:
    """Rounded so that sums in another order give the same value: the small offset keeps clear of decimal ties."""
    return F.round(c + 1.37e-8, digits)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)
