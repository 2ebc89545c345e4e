"""Column functions for timestamps (session time zone UTC; history times are timestamp_ntz)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from learnlog import constants as K

# FIXED VALUES: display formats (clock, day + minute, file stamp)
CLOCK_FORMAT = "HH:mm:ss"
DAY_MINUTE_FORMAT = "dd.MM.yyyy HH:mm"
FILE_STAMP_FORMAT = "yyyyMMdd_HHmmss"
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_iso_local(x) -> Column:
    """ISO-8601 text to ``timestamp_ntz`` keeping the wall clock (offset / ``Z`` dropped,
    not applied); unparseable text gives null."""
    return _c(x).try_cast("timestamp_ntz")


def iso_text(ts) -> Column:
    return F.date_format(_c(ts), ISO_FORMAT)


def clock(ts) -> Column:
    return F.date_format(_c(ts), CLOCK_FORMAT)


def day_minute(ts) -> Column:
    return F.date_format(_c(ts), DAY_MINUTE_FORMAT)


def file_stamp(ts) -> Column:
    return F.date_format(_c(ts), FILE_STAMP_FORMAT)


def effective_ttl(ttl) -> Column:
    """Falsy ttl (null or 0) means the default of 300 seconds."""
    t = _c(ttl)
    return F.when(t.isNull() | (t == 0), F.lit(K.DEFAULT_TTL_SECONDS)).otherwise(t)


def expires_at(ts, ttl) -> Column:
    return _c(ts) + F.make_dt_interval(secs=effective_ttl(ttl).cast("decimal(18,6)"))


def is_expired(ts, ttl, as_of) -> Column:
    """Expired strictly after the expiry instant; exactly at expiry is still active."""
    return _c(as_of) > expires_at(ts, ttl)


def utc_now(session_time_zone: str = "UTC") -> Column:
    """Current UTC wall-clock time as ``timestamp_ntz`` (what ``utcnow()`` stores), whatever
    the session time zone is."""
    local = F.current_timestamp().cast("timestamp_ntz")   # wall clock in the session zone
    if session_time_zone == "UTC":
        return local
    return F.convert_timezone(F.lit(session_time_zone), F.lit("UTC"), local)
