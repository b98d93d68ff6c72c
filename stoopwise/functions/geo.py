"""Distances, walking times, coordinates and WKT text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stoopwise.params import METRES_PER_MINUTE, Box

EARTH_RADIUS_M = 6_371_008.8


def haversine(
    lat1: Column, lon1: Column, cos1: Column, lat2: Column, lon2: Column, cos2: Column
) -> Column:
    """Great-circle distance in metres, given the cosines of the latitudes."""
    half_lat = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0))
    half_lon = F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    h = half_lat + cos1 * cos2 * half_lon
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    return haversine(lat1, lon1, F.cos(F.radians(lat1)), lat2, lon2, F.cos(F.radians(lat2)))


def stop_minutes(distance: Column, m_per_min: float = METRES_PER_MINUTE) -> Column:
    """Whole walking minutes, halves to the even minute."""
    return F.bround(distance / F.lit(float(m_per_min)), 0).cast("int")


def grocery_minutes(distance: Column, m_per_min: float = METRES_PER_MINUTE) -> Column:
    """Walking minutes with one decimal."""
    return F.bround(distance / F.lit(float(m_per_min)), 1)


def walk_radius(minutes: Column, m_per_min: float = METRES_PER_MINUTE) -> Column:
    return minutes * F.lit(m_per_min)


def is_place(lat: Column, lon: Column) -> Column:
    """Whether a coordinate pair lies on the globe; null counts as no."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def in_box(lat: Column, lon: Column, box: Box) -> Column:
    return lat.between(box.south, box.north) & lon.between(box.west, box.east)


def number(text: Column) -> Column:
    """Text to double; null where it is no number."""
    return F.trim(text.cast("string")).try_cast("double")


def geocode(text: Column) -> Column:
    """``"lat,lon"`` text to ``struct<lat,lon>``; null where it is not two numbers."""
    parts = F.split(text, ",")
    lat, lon = number(F.get(parts, 0)), number(F.get(parts, 1))
    good = (F.size(parts) == 2) & lat.isNotNull() & lon.isNotNull()
    return F.when(good, F.struct(lat.alias("lat"), lon.alias("lon")))


def point_of(lat: Column, lon: Column) -> Column:
    """A ``struct<lon,lat>`` from any two castable values; null where either fails."""
    lat, lon = number(lat), number(lon)
    return F.when(
        lat.isNotNull() & lon.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat"))
    )


def _line(text: Column) -> Column:
    def point(pair: Column) -> Column:
        xy = F.split(F.trim(pair), r"\s+")
        return F.struct(
            F.get(xy, 0).try_cast("double").alias("lon"),
            F.get(xy, 1).try_cast("double").alias("lat"),
        )

    return F.transform(F.split(text, ","), point)


def lines_from_wkt(wkt: Column) -> Column:
    """``LINESTRING`` or ``MULTILINESTRING`` text to an array of lines.

    A single line becomes an array of one, any other geometry null.
    """
    body = F.regexp_extract(wkt, r"(?i)^\s*(?:MULTI)?LINESTRING\s*Z?\s*\((.*)\)\s*$", 1)
    inner = F.regexp_replace(F.regexp_replace(body, r"^\s*\(", ""), r"\)\s*$", "")
    many = F.transform(F.split(inner, r"\)\s*,\s*\("), _line)
    return (
        F.when(wkt.rlike(r"(?i)^\s*MULTILINESTRING\s*Z?\s*\("), many)
        .when(wkt.rlike(r"(?i)^\s*LINESTRING\s*Z?\s*\("), F.array(_line(body)))
        .otherwise(F.lit(None))
    )


def _coordinates(line: Column, sep: str) -> Column:
    return F.array_join(
        F.transform(
            line, lambda p: F.concat(p["lon"].cast("string"), F.lit(sep), p["lat"].cast("string"))
        ),
        ", ",
    )


def wkt_from_lines(lines: Column) -> Column:
    """An array of lines to ``MULTILINESTRING`` text."""
    body = F.transform(lines, lambda line: F.concat(F.lit("("), _coordinates(line, " "), F.lit(")")))
    return F.concat(F.lit("MULTILINESTRING ("), F.array_join(body, ", "), F.lit(")"))
