"""Address, date and report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns.
# What stands behind an opening bracket, last character first: whole brackets and text.
FROM_THE_END = r"[^()]*+(?:\)[^()]*+\([^()]*+)*+\("
# A citation, last character first: never closed, or closed by the last bracket, behind which
# may stand blanks and one line separator.
CITATION = rf"^(?:{FROM_THE_END}|[\u0085\u2028\u2029]?+\s*+\){FROM_THE_END})"
BLANKS = " \t\n\x0b\x0c\r"
FENCED_JSON = r"(?is)```json\s*(.*?)\s*```"
CSV_DATE = "M/d/yyyy"

# Street words and their postal abbreviations.
STREET_WORDS = {
    "NORTH": "N",
    "SOUTH": "S",
    "EAST": "E",
    "WEST": "W",
    "AVENUE": "AVE",
    "BOULEVARD": "BLVD",
    "COURT": "CT",
    "DRIVE": "DR",
    "LANE": "LN",
    "PARKWAY": "PKWY",
    "PLACE": "PL",
    "ROAD": "RD",
    "STREET": "ST",
    "TERRACE": "TER",
}
STREET_SUFFIXES = ("AVE", "BLVD", "CT", "DR", "LN", "PKWY", "PL", "RD", "ST", "TER")


def strip(text: Column) -> Column:
    """Trim every kind of blank, not only the space character."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def address_head(address: Column) -> Column:
    """Upper-case text before the first comma."""
    return strip(F.get(F.split(F.upper(address), ","), 0))


def address_title(address: Column) -> Column:
    return js_title_case(F.get(F.split(address, ",", 2), 0))


def address_subtitle(address: Column) -> Column:
    return js_title_case(F.get(F.split(address, ",", 2), 1))


def js_title_case(text: Column) -> Column:
    """Capitalise every run that holds neither a blank nor a hyphen."""
    runs = F.regexp_extract_all(text, F.lit(r"([^-\s]+|[-\s]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def py_title_case(text: Column) -> Column:
    """Capitalise every run of letters, so ``55TH`` becomes ``55Th``."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def proper_address(address: Column) -> Column:
    """Title case with the state abbreviation kept in capitals."""
    return F.regexp_replace(py_title_case(address), r"\bIl\b", "IL")


def normal_address(address: Column) -> Column:
    """Address head with street words abbreviated, one space between words."""
    words = F.split(address_head(address), r"\s+")
    table = F.create_map(*[F.lit(x) for pair in STREET_WORDS.items() for x in pair])
    short = F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))
    return F.array_join(short, " ")


def without_suffix(normal: Column) -> Column:
    """A normalised address without its street suffix."""
    return F.regexp_replace(normal, r"\s+(?:" + "|".join(STREET_SUFFIXES) + r")$", "")


def parse_date(text: Column, strict: bool = True) -> Column:
    """Month/day/year text to a date; blank is null.

    Any other text that is no date raises, or gives null when not ``strict``.
    """
    filled = F.nullif(F.btrim(text, F.lit(BLANKS)), F.lit(""))
    if strict:
        return F.to_date(filled, CSV_DATE)
    return F.try_to_timestamp(filled, F.lit(CSV_DATE)).cast("date")


def parse_timestamp(text: Column) -> Column:
    """Timestamp text to a timestamp; blank or broken text is null."""
    return F.try_to_timestamp(blank_to_null(text))


def strip_citation(text: Column) -> Column:
    """Drop the building-code citation at the end of an ordinance text.

    A citation is the last bracket that only whole brackets follow inside of it, and its
    closing bracket may be missing. Read from the end, each whole bracket is passed over
    once and the first opening one that is left begins the citation, so a text is read
    once whatever its length. One expression finds both kinds, so none is worked out twice.
    """
    cut = F.regexp_replace(F.reverse(F.coalesce(text, F.lit(""))), CITATION, "")
    return F.reverse(F.ltrim(cut, F.lit(BLANKS)))


def unfence_json(text: Column) -> Column:
    """The inside of the first fenced json block, else the whole text, trimmed."""
    return strip(
        F.when(text.rlike(FENCED_JSON), F.regexp_extract(text, FENCED_JSON, 1)).otherwise(text)
    )


def comma_list(text: Column) -> Column:
    """Comma-separated text to trimmed tokens; blank text gives an empty list."""
    tokens = F.transform(F.split(text, ","), strip)
    return F.when(strip(text) == "", F.array().cast("array<string>")).otherwise(tokens)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def display_name(custom_name: Column, address: Column) -> Column:
    return F.coalesce(blank_to_null(custom_name), address)


def card_date(day: Column) -> Column:
    return F.date_format(day, "MMM d, yyyy")


def report_date(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def piped_id(*parts: Column) -> Column:
    """Key text: the parts joined by a bar; null when a part is null."""
    joined = [parts[0].cast("string")]
    for part in parts[1:]:
        joined += [F.lit("|"), part.cast("string")]
    return F.concat(*joined)
