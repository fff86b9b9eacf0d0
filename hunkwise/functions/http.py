"""How answers of outer services are judged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def error_status(status: Column) -> Column:
    """The error that an answer's status becomes, null if it passes; a null status is a failed connection."""
    return F.when(status.isNull(), 502).when(status.isin(401, 403, 404), status).when(status >= 400, 502).otherwise(F.lit(None).cast("int"))


def request_id(header: Column) -> Column:
    """The id that a request brings, or a new one."""
    return F.coalesce(F.when(header != "", header), F.uuid())


def duration_ms(seconds: Column) -> Column:
    """Milliseconds to two places."""
    return F.round(seconds * 1000, 2)
