"""Entity keys and the 15-minute time grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwatch import constants as K

ENTITY = ["method", "bank"]
REASON_ENTITY = ["method", "bank", "error_reason"]


def scoped_bank(method: Column, bank: Column) -> Column:
    """The bank where failures of the method can name one, else NULL."""
    return F.when(method.isin(K.BANK_SCOPED_METHODS), bank)


def micros(moment: Column) -> Column:
    """Microseconds since 1970-01-01 of a UTC wall-clock timestamp."""
    return F.unix_micros(moment.cast("timestamp"))


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value).cast("timestamp_ntz")


def _whole(elapsed: Column, width_seconds: int) -> Column:
    """Floor division of microseconds in integers."""
    width = F.lit(width_seconds * 1_000_000)
    return F.call_function("div", elapsed - F.pmod(elapsed, width), width)


def bucket_index(moment: Column, width_seconds: int = K.BUCKET_SECONDS) -> Column:
    """Whole buckets since 1970-01-01; floors before the epoch too."""
    return _whole(micros(moment), width_seconds)


def bucket_start(index: Column, width_seconds: int = K.BUCKET_SECONDS) -> Column:
    return from_micros(index * F.lit(width_seconds * 1_000_000))


def floor_to_bucket(moment: Column, width_seconds: int = K.BUCKET_SECONDS) -> Column:
    return bucket_start(bucket_index(moment, width_seconds), width_seconds)


def index_on_grid(moment: Column, origin: Column, width_seconds: int = K.BUCKET_SECONDS) -> Column:
    """Bucket position counted from the grid origin; a moment before it is an error."""
    index = _whole(micros(moment) - micros(origin), width_seconds)
    return F.when(moment < origin, F.raise_error(F.lit("moment precedes the grid origin"))).otherwise(index)
