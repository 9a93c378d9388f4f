"""Times as ISO 8601 text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = r"(\d{4})(-?)(\d{2})\2(\d{2})"
_TIME = r"([01]\d|2[0-3])(?:(:?)([0-5]\d)(?:\7([0-5]\d)(?:[.,](\d+))?)?)?"
_ZONE = r"(Z|([+-])([01]\d|2[0-3])(?::?([0-5]\d)(?::?([0-5]\d)(?:\.(\d+))?)?)?)?"
# Any one character may stand between date and time.
ISO = f"^{_DATE}(?:(?s:(.)){_TIME}{_ZONE})?$"


def parse_iso(value: Column) -> Column:
    """The instant an ISO 8601 text names, or null where it names none.

    Extended and basic forms of calendar dates, with hours, minutes, seconds and a fraction
    (beyond six digits it is cut), and an offset or Z. Without an offset the text is UTC,
    without a time midnight. A day that no month has is bad, and so is anything around the text.
    """
    def part(i: int) -> Column:
        return F.regexp_extract(value, ISO, i)

    def number(i: int) -> Column:
        return F.coalesce(F.nullif(part(i), F.lit("")).cast("long"), F.lit(0))

    def fraction(i: int) -> Column:
        return F.rpad(F.substring(part(i), 1, 6), 6, "0").cast("long")

    day = F.concat_ws("-", part(1), part(3), part(4)).try_cast("date")
    clock = (number(6) * 60 + number(8)) * 60 + number(9)
    offset = ((number(13) * 60 + number(14)) * 60 + number(15)) * 1_000_000 + fraction(16)
    micros = (F.unix_date(day).cast("long") * 86_400 + clock) * 1_000_000 + fraction(10) - F.when(
        part(12) == "-", -offset).otherwise(offset)
    return F.when(value.rlike(ISO), F.timestamp_micros(micros))
