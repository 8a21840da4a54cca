"""Calendar expressions on zone-less timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day names from Sunday.
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def floor_time(ts: Column | str, width: str) -> Column:
    """Round a TIMESTAMP_NTZ down to a multiple of ``width`` (for example ``"15 minutes"``).

    A tumbling window start is plain integer arithmetic on the stored microseconds. ``date_trunc``
    would go through the session time zone and shift readings that fall in a DST gap. Rows with a
    NULL timestamp belong to no window and are dropped.
    """
    return F.window(ts, width)["start"]


def floor_to_hour(ts: Column | str) -> Column:
    return floor_time(ts, "1 hour")


def month_start(day: Column | str) -> Column:
    """First day of the month, as DATE."""
    return F.trunc(day, "month")


def day_number(ts: Column | str) -> Column:
    """Day of week with Sunday = 0."""
    return F.dayofweek(ts) - 1


def day_title(ts: Column | str) -> Column:
    """Full English day name; unlike ``date_format`` it needs neither time zone nor locale."""
    return F.element_at(F.array(*[F.lit(name) for name in DAY_NAMES]), F.dayofweek(ts))


def _since_epoch(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def utc_from_instant(instant: Column) -> Column:
    """UTC wall-clock time of an instant, whatever the session time zone."""
    return _since_epoch(F.unix_micros(instant))


def utc_from_nanoseconds(number: Column) -> Column:
    """UTC wall-clock time of a number of nanoseconds since the epoch, in whole numbers throughout."""
    nanos = number.cast("long")
    return _since_epoch(F.call_function("div", nanos - F.pmod(nanos, F.lit(1000)), F.lit(1000)))


def utc_from_text(text: Column) -> Column:
    """UTC wall-clock time of a text timestamp; NULL when it cannot be read.

    A date, or a date and time, is taken as UTC. A date and time with anything after it that names a zone
    (``Z``, ``+10``, ``+1000``, ``+10:00``, ``UTC``, ``Australia/Melbourne``) is an instant and is moved to UTC. Other
    text, unknown zones included, is NULL.
    """
    text = F.trim(text)
    time = r"\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?"
    plain = text.rlike(rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}([ T]{time})?$")
    zoned = text.rlike(rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}[ T]{time}\s*[A-Za-z+-].*$")
    # The cast wants a colon in the offset and, before a zone, the seconds.
    colon = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    colon = F.regexp_replace(colon, r"^(\S+[ T]\d{1,2}:\d{1,2})(\s*[A-Za-z+-])", "$1:00$2")
    return F.when(plain, text.try_cast("timestamp_ntz")).when(
        zoned, utc_from_instant(colon.try_cast("timestamp_ltz"))
    )
