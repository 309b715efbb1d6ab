"""Timestamp, time-zone and calendar expressions."""

from __future__ import annotations

import re
import zoneinfo

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from usageweave import constants as C

# Names the JVM does not know although other time-zone libraries list them.
_NOT_ON_JVM = {"Factory", "ROC", "localtime", "posixrules"}
_OFFSET_ZONE = r"^(UTC|GMT)?[+-]\d\d:\d\d$"


def require_utc(spark: SparkSession) -> None:
    """Wall-clock arithmetic here relies on a UTC session."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"set spark.sql.session.timeZone to UTC (it is {zone})")


def _normalised(text: Column) -> Column:
    zulu = F.replace(text, F.lit("Z"), F.lit("+00:00"))
    tail = F.right(zulu, F.lit(6))
    head = F.left(zulu, F.length(zulu) - 6)
    has_offset = (F.length(zulu) >= 6) & F.left(tail, F.lit(1)).isin("+", "-")
    with_millis = F.when(has_offset, F.concat(head, F.lit(".000"), tail)).otherwise(
        F.concat(zulu, F.lit(".000"))
    )
    return F.when(F.contains(zulu, F.lit(".")), zulu).otherwise(with_millis)


def fix_timestamp(text: Column) -> Column:
    """ISO text with an explicit offset and a fraction; null when too short."""
    fixed = _normalised(text)
    return F.when(F.length(fixed) >= C.MIN_TIMESTAMP_LENGTH, fixed)


def parse_timestamp(text: Column) -> Column:
    """Instant of an ISO text; text without an offset is read as UTC."""
    return F.try_to_timestamp(text)


def read_timestamp(text: Column) -> Column:
    """Instant of a raw text, null where the fixed text would be too short.

    The added fraction and offset do not change the instant, so the length of
    the fixed text is worked out without building it.
    """
    added = F.when(F.contains(text, F.lit("Z")), 5).otherwise(0) + F.when(
        F.contains(text, F.lit(".")), 0
    ).otherwise(4)
    long_enough = F.length(text) + added >= C.MIN_TIMESTAMP_LENGTH
    return F.when(long_enough, parse_timestamp(text))


def timestamp_error(text: Column) -> Column:
    """True where text is present but no instant can be read from it."""
    return text.isNotNull() & read_timestamp(text).isNull()


def text_offset_zone(text: Column) -> Column:
    """Zone named by the offset at the end of a timestamp text."""
    tail = F.right(text, F.lit(6))
    short = F.right(text, F.lit(5))
    utc = F.lit("UTC")
    return (
        F.when(F.endswith(text, F.lit("Z")) | tail.isin("+00:00", "-00:00"), utc)
        .when(tail.rlike(r"^[+-]\d\d:\d\d$"), F.concat(utc, tail))
        .when(F.contains(text, F.lit(":")) & short.isin("+0000", "-0000"), utc)
        .when(
            F.contains(text, F.lit(":")) & short.rlike(r"^[+-]\d{4}$"),
            F.concat(utc, F.left(short, F.lit(3)), F.lit(":"), F.right(short, F.lit(2))),
        )
    )


def zone_names() -> list[str]:
    return sorted(zoneinfo.available_timezones() - _NOT_ON_JVM)


def is_zone(name: str) -> bool:
    return name in zone_names() or re.match(_OFFSET_ZONE, name) is not None


def usable_zone(name: str) -> Column:
    """The zone name in a column when it can be converted to, else null."""
    known = F.expr(f"{name} IN ({', '.join(repr(z) for z in zone_names())})")
    return F.when(known | F.col(name).rlike(_OFFSET_ZONE), F.col(name))


def wall_clock(micros: Column, zone: Column) -> Column:
    """Local date-time (no zone) of an instant given in microseconds."""
    return F.from_utc_timestamp(F.timestamp_micros(micros), zone).cast("timestamp_ntz")


def ntz_micros(local: Column) -> Column:
    return F.unix_micros(local.cast("timestamp"))


def local_text(local: Column, micros: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss.SSSSSS±hh:mm`` of a wall-clock time.

    ``micros`` is the instant it stands for; the offset is what differs.
    """
    minutes = ((ntz_micros(local) - micros) / 60_000_000).cast("int")
    offset = F.concat(
        F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad((F.abs(minutes) / 60).cast("int").cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"),
    )
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss.SSSSSS"), offset)


def clock_hours(local: Column) -> Column:
    """Hour of day as a decimal number; fractions of a second are ignored."""
    return F.hour(local) + F.minute(local) / 60 + F.second(local) / 3600


def calendar(local: Column) -> dict[str, Column]:
    """Calendar columns of a wall-clock time, Sunday being day 1."""
    day = F.dayofweek(local)

    def flag(condition: Column) -> Column:
        return F.coalesce(condition.cast("int"), F.lit(0))

    return {
        "date": F.to_date(local),
        "day": day,
        "weekdayMF": flag(day.between(2, 6)),
        "weekdayMTh": flag(day.between(2, 5)),
        "weekdaySuTh": flag(day.between(1, 5)),
        "hour": F.hour(local),
        "quarter": F.quarter(local),
    }
