"""PM2.5 bands, AQI and colours."""

from __future__ import annotations

from math import nextafter

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public AQI breakpoints (concentration low and high, index low and high).
AQI_STEPS = (
    (0.0, 9.0, 0, 50), (9.1, 35.4, 51, 100), (35.5, 55.4, 101, 150),
    (55.5, 125.4, 151, 200), (125.5, 225.4, 201, 300), (225.5, 325.4, 301, 500),
)
# Bands with their inclusive upper ends, ranges, colours from low to high, and messages.
BANDS = (
    ("Good", 9.0, "0–9", (0x90EE90, 0x00B894), "Air quality is good — within the U.S. EPA annual PM2.5 standard (9 µg/m³)."),
    ("Moderate", 13.0, "9–13", (0xFFFF99, 0xFFD700), "Moderate — above the EPA annual standard. Unusually sensitive people may want to limit prolonged outdoor exertion."),
    ("Elevated", 17.0, "13–17", (0xFFB347, 0xE8590C), "Elevated — above the WHO 24-hour guideline (15 µg/m³). Sensitive groups should limit prolonged outdoor activity."),
    ("High", None, "17+", (0xFF6B6B, 0x800000), "⚠️ High — everyone may begin to feel effects; sensitive groups are at greater risk. Often driven by wildfire smoke or dust."),
)
NAMES = tuple(b[0] for b in BANDS)
#: Width of the open last band for colours.
HIGH_SPAN = 38.0
# Densities of smoke.
DENSITIES = {"light": 1, "medium": 2, "heavy": 3}


def epa_aqi(pm: Column) -> Column:
    """AQI of a daily mean: truncated to 0.1, interpolated within its step, half to even, 500 beyond the table."""
    c = F.greatest(F.lit(0.0), F.floor(pm.cast("double") * 10) / 10)
    out = None
    for lo, hi, a, b in AQI_STEPS:
        start = F.when(c >= lo, lo).otherwise(0.0)
        value = F.rint((b - a) / (hi - start) * (c - start) + a).cast("int")
        out = F.when(c <= hi, value) if out is None else out.when(c <= hi, value)
    return F.when(pm.isNotNull(), out.otherwise(500))


def _by_band(pm: Column, values) -> Column:
    out = None
    for (_, top, *_), value in zip(BANDS[:-1], values):
        out = F.when(pm <= top, value) if out is None else out.when(pm <= top, value)
    return F.when(pm.isNotNull(), out.otherwise(values[-1]))


def band_name(pm: Column) -> Column:
    return _by_band(pm, [b[0] for b in BANDS])


def pm_band(pm: Column) -> Column:
    """struct(category, aqi_range, health_msg)."""
    return F.struct(band_name(pm).alias("category"), _by_band(pm, [b[2] for b in BANDS]).alias("aqi_range"), _by_band(pm, [b[4] for b in BANDS]).alias("health_msg"))


def pm_color(pm: Column) -> Column:
    """Hex colour between the ends of the band, channels half up."""
    c, low, shades = F.greatest(pm.cast("double"), F.lit(0.0)), 0.0, []
    for _, top, _, (first, last), _ in BANDS:
        part = F.least((c - low) / (HIGH_SPAN if top is None else top - low), F.lit(1.0))
        channel = lambda shift: F.floor((first >> shift & 255) + ((last >> shift & 255) - (first >> shift & 255)) * part + 0.5).cast("int")  # noqa: B023, E731
        shades.append(F.format_string("#%02x%02x%02x", channel(16), channel(8), channel(0)))
        low = top
    return _by_band(c, shades)


def density_tier(c: Column) -> Column:
    """Ordinal of a smoke density: 0 for null or empty, 1 for a word that is not known."""
    word, out = F.lower(F.trim(c)), F.when(c.isNull() | (c == ""), 0)
    for name, tier in DENSITIES.items():
        out = out.when(word == name, tier)
    return out.otherwise(1)


# Boxes (south, north, west, east; null is open) of the places outside the region, and their names, in order of precedence.
OUTSIDE = (
    (None, 25.84, None, None, "Mexico"),
    (None, None, None, -103.043, "New Mexico"),
    (nextafter(36.5, 90.0), None, -103.043, -94.43, "Oklahoma"),  # north of 36.5
    (33.5, 37.0, -100.0, -94.43, "Oklahoma"),
    (33.0, None, -94.43, None, "Arkansas"),
    (None, 33.0, -94.04, None, "Louisiana"),
    (None, 27.0, -97.0, None, "Gulf of Mexico"),
)
ELSEWHERE = "Outside TX (unclassified)"


def outside_label(lat: Column, lon: Column) -> Column:
    """Rough region of a point known to lie outside: the name of the first box that holds it.

    A south bound and both of a pair of bounds count as inside, other single bounds don't.
    """

    def held(x: Column, low: float | None, high: float | None) -> Column:
        if low is not None and high is not None:
            return x.between(low, high)
        return F.lit(True) if low is None and high is None else x < high if low is None else x > low

    north_of = lambda s, n: lat >= s if s is not None and n is None else held(lat, s, n)
    found = [F.when(north_of(s, n) & held(lon, w, e), name) for s, n, w, e, name in OUTSIDE]
    return F.coalesce(*found, F.lit(ELSEWHERE))
