"""Timestamp texts of many layouts, rewritten to one canonical text and read from that."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The timestamp layouts read here, each with its rewrite to
# `year-month-day hour:minute:second|fraction|half of day|zone`.
_HMS = r"(\d\d?):(\d\d):(\d\d)"
_FRACTION = r"(?:[.,](\d{1,9}))?"
_ZONE = r"\s?(Z|[A-Z]{2,5}|[+-]\d\d:?\d\d)?"
LAYOUTS = [
    (rf"^(\d{{4}})[-/](\d\d)[-/](\d\d)[T ]{_HMS}{_FRACTION}{_ZONE}$", "$1-$2-$3 $4:$5:$6|$7||$8"),
    (rf"^(\d{{4}})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d){_FRACTION}{_ZONE}$", "$1-$2-$3 $4:$5:$6|$7||$8"),
    (rf"^(\d\d?)\.(\d\d?)\.(\d{{4}}) {_HMS}{_FRACTION}{_ZONE}$", "$3-$2-$1 $4:$5:$6|$7||$8"),
    (rf"^[A-Z]{{3}} ([A-Z]{{3}}) +(\d\d?) {_HMS}{_FRACTION} (\d{{4}})$", "$7-$1-$2 $3:$4:$5|$6||"),
    (rf"^[A-Z]{{3}}, (\d\d?) ([A-Z]{{3}}) (\d{{4}}) {_HMS}{_FRACTION}{_ZONE}$", "$3-$2-$1 $4:$5:$6|$7||$8"),
    (rf"^(\d\d?)/([A-Z]{{3}})/(\d{{4}}):{_HMS}{_FRACTION}{_ZONE}$", "$3-$2-$1 $4:$5:$6|$7||$8"),
    (r"^(\d\d)(\d\d)(\d\d) (\d\d)(\d\d)(\d\d)$", "20$1-$2-$3 $4:$5:$6|||"),
]
_SLASH = rf"^(\d\d?)/(\d\d?)/(\d{{4}}) {_HMS}{_FRACTION}\s?(AM|PM)?{_ZONE}$"
_EPOCH = r"^-?\d{10}(?:\.\d{1,9}|\d{3}|\d{6}|\d{9})?$"
_MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once: a lambda variable is never inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def canonical(text: Column, month_first: Column) -> Column:
    """`text` (trimmed, upper case) as canonical text, null where no layout fits.

    `month_first` orders the first two numbers of slash dates.
    """
    out = F.when(
        text.rlike(_SLASH),
        F.when(month_first, F.regexp_replace(text, _SLASH, "$3-$1-$2 $4:$5:$6|$7|$8|$9")).otherwise(
            F.regexp_replace(text, _SLASH, "$3-$2-$1 $4:$5:$6|$7|$8|$9")
        ),
    )
    for pattern, target in LAYOUTS:
        out = out.when(text.rlike(pattern), F.regexp_replace(text, pattern, target))
    return out


def _number(c: Column) -> Column:
    return c.try_cast("int")


def read_parts(canon: Column) -> Column:
    """A struct of a canonical text: local time as if in UTC, its milliseconds, zone text."""
    return let(F.split(canon, "[- :|]", 9), _fields)


def _fields(p: Column) -> Column:
    at = lambda k: F.get(p, F.lit(k))
    month = F.when(at(1).rlike("^[A-Z]"), F.floor((F.position(at(1), F.lit(_MONTHS)) + 2) / 3).cast("int")).otherwise(_number(at(1)))
    hour = _number(at(3))
    half = at(7)
    hour24 = (
        F.when(half == "", hour)
        .when(~hour.between(1, 12), F.lit(None).cast("int"))
        .when(half == "AM", F.pmod(hour, F.lit(12)))
        .otherwise(F.pmod(hour, F.lit(12)) + 12)
    )
    second = _number(at(5))
    local = F.try_make_timestamp(_number(at(0)), month, _number(at(2)), hour24, _number(at(4)), F.when(second < 60, second).cast("decimal(16,6)"), F.lit("UTC"))
    millis = F.coalesce(F.rpad(F.nullif(at(6), F.lit("")), 3, "0").substr(1, 3).cast("int"), F.lit(0))
    return F.struct(local.alias("local"), millis.alias("millis"), F.nullif(at(8), F.lit("")).alias("zone"))


def epoch_millis(text: Column) -> Column:
    """Milliseconds of an epoch number in seconds, milli-, micro- or nanoseconds; finer digits cut off."""
    whole = F.regexp_extract(text, r"^-?\d+", 0)
    fraction = F.rpad(F.regexp_extract(text, r"\.(\d+)$", 1), 3, "0").substr(1, 3)
    number = whole.try_cast("bigint")
    digits = F.length(F.regexp_replace(whole, "-", ""))
    # micro- and nanoseconds drop their digits as text: as doubles they would round
    value = (
        F.when(digits == 10, number * 1000 + F.coalesce(fraction.try_cast("bigint"), F.lit(0)))
        .when(digits == 13, number)
        .otherwise(whole.substr(F.lit(1), F.length(whole) - (digits - 13)).try_cast("bigint"))
    )
    return F.when(text.rlike(_EPOCH), value)


def offset_seconds(zone: Column) -> Column:
    """Seconds east of UTC of a numeric offset, Z, UTC or GMT; null for other zone texts."""
    digits = F.regexp_replace(zone, "[^0-9]", "")
    seconds = digits.substr(1, 2).try_cast("int") * 3600 + digits.substr(3, 2).try_cast("int") * 60
    return F.when(zone.isin("Z", "UTC", "GMT"), F.lit(0)).when(
        zone.rlike(r"^[+-]\d\d:?\d\d$"), F.when(zone.startswith("-"), -seconds).otherwise(seconds)
    )
