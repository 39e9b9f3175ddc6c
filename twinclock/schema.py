"""Shared constants and schemas.

Column names used by every operator:

* events      entity, rev_id, ts, plus any attributes
* timeline    entity, rev_id, valid_from, valid_to          (application time, half-open)
* versions    any columns, row_start, row_end               (system time, half-open)

``sources.adapters.as_events`` maps other column names onto these.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# They must be these for results to match.
INFINITY = "9999-12-31 23:59:59"
SYSTEM_MAX = "2106-02-07 06:28:15.999999"
USABLE_STATUSES = ("resolved", "redirect")
STATUSES = ("resolved", "redirect", "missing", "disambiguation", "duplicate", "error")
# Reasons why a title was not resolved; the first two of the second group are followed by a detail.
REDIRECT_CYCLE = "redirect_cycle"
NOT_IN_RESPONSE = "page_not_in_response"
DOES_NOT_EXIST = "page_does_not_exist"
NO_URL = "api_returned_no_url"
DISAMBIGUATION = "page_is_a_disambiguation_page"
INVALID_TITLE = "invalid_title: "
OTHER_NAMESPACE = "not_an_article_namespace_"
SAME_PAGE = 'resolves to the same page as "'
MAX_PACK_BYTES = 8 * 1024 * 1024
MAX_PACK_TEXTS = 64
HUNK_CONTEXT = 3
PAGE_SIZE = 50

EVENT_KEY = ["entity", "rev_id"]
TIMELINE = ["entity", "rev_id", "valid_from", "valid_to"]

REVISION_JSON = T.StructType([
    T.StructField("revid", T.LongType()),
    T.StructField("parentid", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("userid", T.LongType()),
    T.StructField("userhidden", T.BooleanType()),
    T.StructField("comment", T.StringType()),
    T.StructField("commenthidden", T.BooleanType()),
    T.StructField("minor", T.BooleanType()),
    T.StructField("size", T.LongType()),
    T.StructField("sha1", T.StringType()),
    T.StructField("sha1hidden", T.BooleanType()),
    T.StructField("texthidden", T.BooleanType()),
    T.StructField("suppressed", T.BooleanType()),
])

CURATED_JSON = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("domain", T.StringType()),
])


def ntz(value) -> Column:
    """A timestamp_ntz literal from a string, or the value itself when it is a column already."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def infinity() -> Column:
    return ntz(INFINITY)


def system_max() -> Column:
    return ntz(SYSTEM_MAX)


def null_if_open(col) -> Column:
    """Show an open end as null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col < infinity(), col)
