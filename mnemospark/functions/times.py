"""Times kept as text: parsing to epoch milliseconds, display zones, prefix ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?(Z|[+-]\d{2}:?\d{2})?$"
_ZONE = r"\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$"


def to_millis(c: Column | str) -> Column:
    """Epoch milliseconds (UTC) of a text time; null where the text is no time.

    Understood are ISO-8601 dates and times with ``Z``, with an offset or without a zone
    (then UTC), and epoch milliseconds of 11 to 14 digits. Null, empty and impossible
    times (month 0, hour 25) give null; nothing raises. The session's zone has no say.
    """
    c = F.col(c) if isinstance(c, str) else c
    s = F.trim(c)
    zoned = F.when(s.rlike(_ZONE), F.regexp_replace(s, r"([+-]\d{2})(\d{2})$", "$1:$2")).when(
        F.length(s) == 10, F.concat(s, F.lit("T00:00:00Z"))
    ).otherwise(F.concat(s, F.lit("Z")))
    return F.when(s.rlike(r"^\d{11,14}$"), s.try_cast("bigint")).when(
        s.rlike(_ISO), F.unix_millis(zoned.try_cast("timestamp"))
    )


def millis_text(ms: Column) -> Column:
    """ISO-8601 with milliseconds and Z, as the stored texts have it."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def within_dates(stamp: Column, after: Column | None = None, before: Column | None = None) -> Column:
    """Inclusive range on the text prefix as long as the bound; a missing bound is open."""
    keep = F.lit(True)
    if after is not None:
        keep = keep & (F.length(after).isNull() | (F.length(after) == 0) | (F.substring(stamp, F.lit(1), F.length(after)) >= after))
    if before is not None:
        keep = keep & (F.length(before).isNull() | (F.length(before) == 0) | (F.substring(stamp, F.lit(1), F.length(before)) <= before))
    return F.coalesce(keep, F.lit(False))


def local_day(ts: Column, hours: int = 8) -> Column:
    """Calendar day of a timestamp in a fixed zone east of UTC."""
    return F.to_date(ts + F.make_dt_interval(hours=F.lit(hours)))
