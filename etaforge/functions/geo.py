"""Great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius in kilometres.
EARTH_RADIUS_KM = 6371.0


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Distance in km between two points given in degrees; NULL when any coordinate is NULL."""

    def half_chord(a: Column, b: Column) -> Column:
        return F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))

    chord = half_chord(lat_a, lat_b) + (
        F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half_chord(lon_a, lon_b)
    )
    # Rounding can lift the chord of antipodal points above 1. greatest() skips NULLs, so
    # the guard must not turn an unknown chord into a number: sqrt(chord) keeps it NULL.
    rest = F.greatest(1 - chord, F.lit(0.0))
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(chord), F.sqrt(rest))
