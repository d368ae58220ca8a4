"""Timestamps and calendar features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens.schema import TIMESTAMP_FORMAT


def parse_timestamp(text: Column, fmt: str = TIMESTAMP_FORMAT) -> Column:
    """Timestamp without time zone; null where the text does not fit the format."""
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def response_hours(review_ts: Column, replied_at: Column) -> Column:
    """Hours from review to reply; negative if the reply is older."""
    seconds = F.timestamp_diff("SECOND", review_ts, replied_at)
    return seconds.cast("double") / F.lit(3600.0)
