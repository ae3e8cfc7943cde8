"""Instants and validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds an as-of instant may lie between (1970-01-01 and 2100-01-01).
AT_MIN, AT_MAX = 0, 4102444800

RFC3339 = (
    "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"
)


def rfc3339(text: Column) -> Column:
    """an instant, or null where the text is not RFC 3339."""
    # the JVM parser reads at most nanoseconds; digits past the sixth do not reach a microsecond
    short = F.regexp_replace(F.translate(text, ",", "."), "(\\.[0-9]{6})[0-9]+", "$1")
    return F.when(text.rlike(RFC3339), short.try_cast("timestamp"))


def epoch_seconds(instant: Column) -> Column:
    return F.unix_seconds(instant.cast("timestamp"))


def epoch_micros(instant: Column) -> Column:
    return F.unix_micros(instant.cast("timestamp"))


def is_resolved(ends_at: Column, now: Column) -> Column:
    """ended strictly before now; a missing or malformed end is not."""
    return F.coalesce(rfc3339(ends_at) < now, F.lit(False))


def valid_at(at: Column, valid_from: Column, valid_to: Column) -> Column:
    """Half-open validity, null end is open."""
    return (at >= valid_from) & (valid_to.isNull() | (at < valid_to))


def as_of_seconds(text: Column, now_s: Column) -> Column:
    """An as-of parameter in epoch seconds; blank is now, null when unusable."""
    given = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))
    at = F.when(F.coalesce(text, F.lit("")) == "", now_s).otherwise(given)
    return F.when((F.coalesce(text, F.lit("")) == "") | at.between(AT_MIN, AT_MAX), at)
