"""Instants: strict parsing, coverage, calendar months and sync cut-offs."""

from __future__ import annotations

import calendar
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinclock.schema import ntz

# Fixed value: the accepted grammar.
INSTANT = r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2}))?)?(Z|[+-]\d{2}:\d{2})?\z"
MAX_LENGTH = 40
# Fixed value: what counts as white space at the ends of a text.
BLANK = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def trimmed(text) -> Column:
    """Without white space at either end, whatever kind it is."""
    return F.regexp_replace(text, rf"\A{BLANK}+|{BLANK}+\z", "")


def parse_instant(text) -> Column:
    """struct(instant, error) in UTC; a value without offset is UTC, fractions of a second are refused.

    ``error`` is required, length, format, calendar, offset or range.
    """
    raw = F.col(text) if isinstance(text, str) else text
    # inside a lambda the text is trimmed once, and the generated code stays small
    return F.element_at(F.transform(F.array(raw), lambda r: F.element_at(F.transform(F.array(trimmed(r)), lambda s: _parsed(r, s)), 1)), 1)


def _parsed(raw: Column, s: Column) -> Column:
    def part(i):
        return F.regexp_extract(s, INSTANT, i)

    clock = F.concat(*[F.when(part(i) == "", "00").otherwise(part(i)) if i == 4 else
                       F.concat(F.lit(":"), F.when(part(i) == "", "00").otherwise(part(i))) for i in (4, 5, 6)])
    # straight to a timestamp without zone: the session's zone plays no part
    local = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), clock).try_cast("timestamp_ntz")
    offset = part(7)
    hours = F.substring(offset, 2, 2).cast("int")
    minutes = F.substring(offset, 5, 2).cast("int")
    sign = F.when(offset.startswith("-"), 1).otherwise(-1)
    has_offset = (offset != "") & (offset != "Z")
    shift = F.make_dt_interval(hours=F.when(has_offset, sign * hours).otherwise(0),
                               mins=F.when(has_offset, sign * minutes).otherwise(0))
    utc = local + shift
    error = (F.when(raw.isNull() | (raw == ""), "required")
             .when(F.length(raw) > MAX_LENGTH, "length")
             .when(~s.rlike(INSTANT), "format")
             .when(local.isNull(), "calendar")
             .when(has_offset & ((hours > 14) | (minutes > 59)), "offset")
             .when(~F.year(utc).between(1000, 9998), "range"))
    return F.struct(F.when(error.isNull(), utc).alias("instant"), error.alias("error"))


def coverage_error(ts, start, end) -> Column:
    """OUT_OF_COVERAGE outside the closed window, else null."""
    return F.when(~F.col(ts).between(ntz(start), ntz(end)), "OUT_OF_COVERAGE")


def add_months(ts, months) -> Column:
    """Calendar months with the day clamped to the month's end."""
    months = months if isinstance(months, Column) else F.lit(months)
    return (F.col(ts) if isinstance(ts, str) else ts) + F.make_ym_interval(F.lit(0), months)


def month_step(start: datetime, months: int) -> datetime:
    years, month = divmod(start.month - 1 + months, 12)
    year = start.year + years
    last = calendar.monthrange(year, month + 1)[1]
    return start.replace(year=year, month=month + 1, day=min(start.day, last))


def sync_cutoffs(start: datetime, end: datetime, months: int) -> list[datetime]:
    """Steps of ``months`` from the start; one less than a day before the end gives way to the end itself."""
    cutoffs, k = [], 1
    while months > 0 and end - (at := month_step(start, k * months)) >= timedelta(days=1):
        cutoffs.append(at)
        k += 1
    return [*cutoffs, end]


def cutoff_rows(bounds: DataFrame, months: int) -> DataFrame:
    """The same cut-offs as rows, for a table of windows with columns start and end."""
    steps = (F.months_between(F.col("end"), F.col("start")) / months).cast("int") + 1 if months > 0 else F.lit(0)
    inner = F.filter(
        F.transform(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))),
                    lambda k: F.col("start") + F.make_ym_interval(F.lit(0), (k * months).cast("int"))),
        lambda c: c + F.expr("interval 1 day") <= F.col("end")) if months > 0 else F.array().cast("array<timestamp_ntz>")
    return bounds.select("start", "end", F.posexplode(F.concat(inner, F.array("end"))).alias("step", "cutoff")) \
        .withColumn("step", F.col("step") + 1)
