"""Fixed schemas of the feeds and tables."""

from __future__ import annotations

# Header of the violations file and the columns it is read into.
VIOLATION_COLUMNS = {
    "ID": ("violation_id", "string"),
    "VIOLATION LAST MODIFIED DATE": ("violation_last_modified_date", "date"),
    "VIOLATION DATE": ("violation_date", "date"),
    "VIOLATION CODE": ("violation_code", "string"),
    "VIOLATION STATUS": ("violation_status", "string"),
    "VIOLATION STATUS DATE": ("violation_status_date", "date"),
    "VIOLATION DESCRIPTION": ("violation_description", "string"),
    "VIOLATION LOCATION": ("violation_location", "string"),
    "VIOLATION INSPECTOR COMMENTS": ("violation_inspector_comments", "string"),
    "VIOLATION ORDINANCE": ("violation_ordinance", "string"),
    "INSPECTOR ID": ("inspector_id", "string"),
    "INSPECTION NUMBER": ("inspection_number", "int"),
    "INSPECTION STATUS": ("inspection_status", "string"),
    "INSPECTION WAIVED": ("inspection_waived", "string"),
    "INSPECTION CATEGORY": ("inspection_category", "string"),
    "DEPARTMENT BUREAU": ("department_bureau", "string"),
    "ADDRESS": ("address", "string"),
    "STREET NUMBER": ("street_number", "int"),
    "STREET DIRECTION": ("street_direction", "string"),
    "STREET NAME": ("street_name", "string"),
    "STREET TYPE": ("street_type", "string"),
    "PROPERTY GROUP": ("property_group", "int"),
    "SSA": ("ssa", "string"),
    "LATITUDE": ("latitude", "double"),
    "LONGITUDE": ("longitude", "double"),
}
VIOLATIONS_CSV = ", ".join(f"`{name}` string" for name in VIOLATION_COLUMNS)
# Holds a record whose number of fields is wrong; null for a good one.
BROKEN = "_broken"

STOPS_CSV = (
    "route_id string, var_1 string, stop_name string, stop_id string, "
    "latitude string, longitude string, var_2 string, var_3 string"
)
ROUTE_NAMES = ["geometry", "route_id", "route_name", "weekday", "saturday", "sunday"]

POINT = "struct<type: string, coordinates: array<double>>"
SHUTTLE_STOPS = (
    f"geometry: {POINT}, "
    "properties: struct<stop_id: string, stop_name: string, route_name: string>"
)
GROCERY_FEED = (
    f"geometry: {POINT}, properties: struct<store_name: string, address: string, "
    "zip: string, new_status: string, last_updated: string>"
)
PLACES = (
    "type string, results array<struct<name: string, vicinity: string, "
    "geometry: struct<location: struct<lat: double, lng: double>>, "
    "rating: double, user_ratings_total: bigint>>"
)
SHUTTLE_SYSTEM = (
    "name string, shortName string, id string, groupColor string, fullname string, "
    "distance double, latitude double, longitude double, "
    "stops array<struct<id: string, name: string, latitude: double, longitude: double>>"
)
# Header of the shuttle route file and the fields it is written from.
SHUTTLE_ROUTE_HEADER = {
    "Route Name": "name",
    "Short Name": "shortName",
    "Route ID": "id",
    "Color": "groupColor",
    "Full Name": "fullname",
    "Distance (m)": "distance",
    "Latitude": "latitude",
    "Longitude": "longitude",
}

# Longest texts of the tables, checked by the quality rules.
VIOLATION_LENGTHS = {
    "violation_id": 10,
    "violation_code": 20,
    "violation_status": 10,
    "inspector_id": 20,
    "inspection_status": 10,
    "inspection_waived": 5,
    "inspection_category": 20,
    "department_bureau": 50,
    "address": 100,
    "street_direction": 5,
    "street_name": 20,
    "street_type": 10,
    "ssa": 10,
}
AMENITY_LENGTHS = {"name": 255, "address": 255}
ROUTE_LENGTHS = {"route_id": 20, "name": 255}
