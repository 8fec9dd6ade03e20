"""Times of day as text: hours, minutes and seconds of a number of seconds, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_text(seconds: Column) -> Column:
    """'h:mm:ss', with six decimals unless whole, after 'n days, ' from a day on; seconds are not negative."""
    micros = F.round(seconds * 1_000_000).cast("bigint")
    whole, rest = F.floor(micros / 1_000_000).cast("bigint"), micros % 1_000_000
    days = F.floor(whole / 86_400).cast("bigint")
    two = lambda x: F.lpad(F.floor(x).cast("bigint").cast("string"), 2, "0")
    hours = F.floor(whole % 86_400 / 3_600).cast("bigint").cast("string")
    day = F.when(days == 0, "").when(days == 1, "1 day, ").otherwise(F.concat(days.cast("string"), F.lit(" days, ")))
    part = F.when(rest == 0, "").otherwise(F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0")))
    return F.concat(day, hours, F.lit(":"), two(whole % 3_600 / 60), F.lit(":"), two(whole % 60), part)


def clock_seconds(text: Column) -> Column:
    """The seconds of 'h:mm:ss[.ffffff]', with days before if any; null for other texts."""
    part = lambda i: F.nullif(F.regexp_extract(text, r"^(?:(\d+) days?, )?(\d+):(\d\d):(\d\d(?:\.\d+)?)$", i), F.lit(""))
    days = F.coalesce(part(1).cast("bigint"), F.lit(0))
    return (days * 86_400 + part(2).cast("bigint") * 3_600 + part(3).cast("bigint") * 60) + part(4).cast("double")
