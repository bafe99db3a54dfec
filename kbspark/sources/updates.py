"""Scheduled knowledge updates ``(content, source, updated_at)``.

Any DataFrame (or stream) in the update schema is a feed; ``normalise`` casts
and names the columns.  The reference's placeholder feed is two constant rows;
here the feed is whatever the caller lands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.schema import UPDATE


def normalise(df: DataFrame, content: str = "content", source: str = "source",
              updated_at: str = "updated_at", extra: list[str] | None = None) -> DataFrame:
    cols = [F.col(content).cast("string").alias("content"), F.col(source).cast("string").alias("source"),
            F.col(updated_at).cast("timestamp").alias("updated_at")]
    return df.select(*cols, *(extra or []))


UPDATE_SCHEMA = UPDATE
