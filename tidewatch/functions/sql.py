"""The scalar functions under SQL names, as temporary SQL functions: no Python in the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidewatch.plans.registry import CELL_DEGREES, EARTH_RADIUS_KM

_RATE = "s / nullif(n, 0D)"
_SPREAD = f"1.96D * sqrt({_RATE} * (1 - {_RATE}) / n + 3.8416D / (4 * n * n))"
_CENTRE = f"({_RATE} + 3.8416D / (2 * n))"

DEFINITIONS = {
    "haversine_km": (
        "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
        f"{2 * EARTH_RADIUS_KM}D * asin(nullif(least(1D, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2)"
        " + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))),"
        " CASE WHEN lat1 + lon1 + lat2 + lon2 IS NULL THEN 1D END))",
    ),
    "geo_cell": (
        "lat DOUBLE, lon DOUBLE", "STRING",
        f"concat(cast(floor(lat / {CELL_DEGREES}D) AS STRING), ':', cast(floor(lon / {CELL_DEGREES}D) AS STRING))",
    ),
    "wilson_lower": ("s DOUBLE, n DOUBLE", "DOUBLE", f"greatest(0D, ({_CENTRE} - {_SPREAD}) / (1 + 3.8416D / n))"),
    "wilson_upper": ("s DOUBLE, n DOUBLE", "DOUBLE", f"least(1D, ({_CENTRE} + {_SPREAD}) / (1 + 3.8416D / n))"),
    "local_hour": (
        "t BIGINT, utc_offset_hours INT", "INT", "hour(timestamp_micros(t + utc_offset_hours * 3600000000L))",
    ),
    "fold_of": (
        "account STRING, folds INT", "INT",
        "cast(aggregate(transform(sequence(1, length(hex(encode(account, 'UTF-8'))) - 1, 2),"
        " i -> cast(conv(substring(hex(encode(account, 'UTF-8')), i, 2), 16, 10) AS BIGINT)), 0L,"
        " (acc, b) -> (acc * 131 + b) % 2147483647L) % folds AS INT)",
    ),
    "corridor_class": (
        "home STRING, home_blocs ARRAY<STRING>, home_continent STRING, away STRING, away_blocs ARRAY<STRING>,"
        " away_continent STRING", "STRING",
        "CASE WHEN home = away THEN 'DOMESTIC' WHEN arrays_overlap(home_blocs, away_blocs) THEN 'INTRA_BLOC'"
        " WHEN home_continent = away_continent THEN 'CROSS_BLOC_AFRICA' ELSE 'INTERCONTINENTAL' END",
    ),
}


def register(spark: SparkSession) -> None:
    """Makes the functions available to SQL text of this session."""
    for name, (arguments, result, body) in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
