"""Row filters of the violation, transit and place jobs."""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoopwise.functions import geo
from stoopwise.params import SURVEYED_BOX, START_DATE, TRIVIAL_CODES, Box


def one_of(col: Column, values: Iterable[str]) -> Column:
    """Membership that is false, not null, for a null value."""
    return F.coalesce(col.isin(*values), F.lit(False))


def between_dates(df: DataFrame, start: str, end: str, date: str = "violation_date") -> DataFrame:
    """Rows from ``start`` to ``end``, both days included."""
    return df.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def since(
    df: DataFrame,
    start: datetime.date | str = START_DATE,
    inclusive: bool = True,
    date: str = "violation_date",
) -> DataFrame:
    day = F.lit(start).cast("date")
    return df.where(F.col(date) >= day if inclusive else F.col(date) > day)


def in_box(df: DataFrame, box: Box = SURVEYED_BOX) -> DataFrame:
    return df.where(geo.in_box(F.col("latitude"), F.col("longitude"), box))


def with_categories(
    df: DataFrame, categories: Iterable[str], category: str = "inspection_category"
) -> DataFrame:
    """Rows of the wanted categories; the argument is upper-cased, the data is not."""
    return df.where(F.col(category).isin(*[c.upper() for c in categories]))


def drop_codes(
    df: DataFrame, codes: Iterable[str] = TRIVIAL_CODES, code: str = "violation_code"
) -> DataFrame:
    """Rows without the given codes; a row without any code stays."""
    return df.where(~one_of(F.col(code), codes))


def with_code(df: DataFrame, code: str, column: str = "violation_code") -> DataFrame:
    return df.where(F.col(column) == code)


def with_address_prefix(df: DataFrame, prefix: str, address: str = "address") -> DataFrame:
    """Rows whose address starts with the text, case ignored and no wildcards."""
    return df.where(F.upper(address).startswith(prefix.upper()))


def mentions(col: Column, text: str) -> Column:
    """Whether the text occurs; null counts as no."""
    return F.coalesce(col.contains(text), F.lit(False))
