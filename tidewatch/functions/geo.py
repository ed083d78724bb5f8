"""Places: great-circle distance, grid cells, corridor between two countries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.plans.registry import CELL_DEGREES, CORRIDORS, EARTH_RADIUS_KM


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlon), 2
    )
    # Rounding may push the root past one; `least` would also turn an unknown place into one.
    root = F.sqrt(a)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.when(root > 1.0, 1.0).otherwise(root))


def geo_cell(lat: Column, lon: Column) -> Column:
    """Key of the grid square a point falls in."""
    return F.concat_ws(
        ":",
        F.floor(lat / F.lit(CELL_DEGREES)).cast("string"),
        F.floor(lon / F.lit(CELL_DEGREES)).cast("string"),
    )


def corridor_class(
    home: Column, home_blocs: Column, home_continent: Column, away: Column, away_blocs: Column,
    away_continent: Column,
) -> Column:
    """A country shares every bloc with itself, so the same-country test has to come first."""
    domestic, intra, cross, between = CORRIDORS
    return (
        F.when(home == away, domestic)
        .when(F.arrays_overlap(home_blocs, away_blocs), intra)
        .when(home_continent == away_continent, cross)
        .otherwise(between)
    )
