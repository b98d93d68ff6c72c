"""Defaults of the jobs. Every job takes them as arguments."""

from __future__ import annotations

import datetime
from typing import NamedTuple


class Box(NamedTuple):
    """A latitude/longitude box; all four sides are inclusive."""

    south: float
    north: float
    west: float
    east: float


# Walking speed and neighbourhood boxes.
METRES_PER_MINUTE = 70
NEIGHBOURHOOD = Box(south=41.780, north=41.810, west=-87.630, east=-87.580)
SURVEYED_BOX = Box(south=41.780482, north=41.809647, west=-87.615877, east=-87.579056)

# Defaults of the violation jobs.
START_DATE = datetime.date(2020, 1, 1)
CATEGORIES = ("COMPLAINT", "PERIODIC")
TRIVIAL_CODES = ("CN190019", "CN193305", "CN190029")

# Walking-time buckets in minutes, and the minutes of a feature without any.
TIME_BUCKETS = (5, 10, 15)
MISSING_MINUTES = 999

# Amenity and transit types.
AMENITY_TYPES = ("grocery", "pharmacy", "restaurant", "cafe", "bar", "hospital", "other")
TRANSIT_TYPES = ("cta", "metra", "shuttle", "divvy", "other")

# Place types asked of the places feed, and the ones imported as amenities.
PLACE_TYPES = (
    "grocery_or_supermarket", "cafe", "library", "book_store", "university",
    "hospital", "pharmacy", "doctor", "dentist", "park", "gym", "bank", "atm",
    "post_office", "restaurant", "meal_takeaway", "meal_delivery",
    "hair_care", "beauty_salon", "convenience_store", "drugstore",
)
PLACE_TO_AMENITY = {"grocery_or_supermarket": "grocery"}

# Stop rows of these routes are rail lines or routes without a line.
EXCLUDED_ROUTES = (
    "992", "999", "Blue", "Brown", "Green", "Orange", "Pink", "Purple", "Red", "Yellow",
)

# Shuttle routes renamed, dropped and kept.
SHUTTLE_RENAMES = {"Downtown Campus Connector": "Downtown Connector"}
SHUTTLES_DROPPED = ("GE Gleacher Express", "MED Medical Shuttle")
SHUTTLES_KEPT = (
    "53rd Street Express", "Apostolic", "Apostolic/Drexel", "Downtown Connector",
    "Drexel", "Friend Center/Metra", "Red Line/Arts Block", "Midway Metra",
)

# Fixed value: the urban area an address must lie in.
URBAN_AREA = "Chicago, IL--IN"

# Rows one task should handle when a group has to be split.
ROWS_PER_TASK = 2_000_000
