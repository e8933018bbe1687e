"""Times and small scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import let

#: Seconds of the 400 years after which dates repeat.
CYCLE = 146097 * 86400


def gaussian_time(gap: Column, sigma: float) -> Column:
    """exp(-gap^2 / (2 sigma^2)); 0 for a sigma of 0 or less."""
    return F.exp(-(gap * gap) / F.lit(2.0 * sigma * sigma)) if sigma > 0 else F.lit(0.0)


def utc_day(seconds: Column) -> Column:
    return F.floor(seconds / 86400)


def parse_iso(text: Column, strip_zone: bool = False) -> Column:
    """Unix seconds of a text in any of the formats that sources use; 0 where none fits (session time zone UTC)."""
    c = F.regexp_replace(text, r"(Z|\+00:00)$", "") if strip_zone else text
    plain = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    formats = plain if strip_zone else ["yyyy-MM-dd'T'HH:mm:ssXXX", *plain[:2]]
    tries = [F.try_to_timestamp(c, F.lit(f)) for f in formats]
    return F.coalesce(F.unix_timestamp(F.coalesce(*tries)), F.lit(0))


def sport_of(sport_id: Column, source: str) -> Column:
    table = fixed.SPORT_IDS[source]
    return reduce(lambda c, kv: c.when(sport_id == kv[0], kv[1]), table.items(), F.when(F.lit(False), "")).otherwise("unknown")


def sport_id_of(sport: str, source: str) -> str:
    return next((k for k, v in fixed.SPORT_IDS[source].items() if v == sport), "")


def normalize_dob(text: Column) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, 10)


def utc_date(seconds: Column) -> Column:
    """The date of any whole number of unix seconds, years of more than four digits without a plus.

    Timestamps end in the year 294247. A date ends in the year 5881580, so further off its day is found in the cycle that
    begins in 1970, and the year is moved back.
    """

    def placed(n: Column) -> Column:
        cycle = F.call_function("div", n, F.lit(CYCLE)) - F.when(n % CYCLE < 0, 1).otherwise(0)
        return let(F.date_from_unix_date(F.floor(F.pmod(n, F.lit(CYCLE)) / 86400).cast("int")), lambda d: F.concat((F.year(d) + cycle * 400).cast("string"), F.substring(d.cast("string"), 5, 6)))

    near = F.ltrim(F.date_from_unix_date(F.floor(seconds / 86400).cast("int")).cast("string"), F.lit("+"))
    return F.when(F.abs(F.floor(seconds / 86400)) < 1 << 31, near).otherwise(let(seconds, placed))


def dob_of_seconds(text: Column) -> Column:
    """A birthday kept as unix seconds, as a date."""
    n = text.try_cast("long")
    return F.when(n.isNotNull() & (n != 0), utc_date(n)).otherwise(F.coalesce(text, F.lit("")))


def round3(value: Column) -> Column:
    """Three decimals, halves away from zero."""
    return F.signum(value) * F.floor(F.abs(value) * 1000 + 0.5) / 1000
