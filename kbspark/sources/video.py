"""Landed video-list API responses -> Content.

Only the first item counts; zero items (or an unparseable body) rejects the
fetch with "video not found".  title, text = snippet title, description;
source = ``youtube``; url = ``https://youtube.com/watch?v=<id>``; published_at =
now (the snippet date is ignored, as in the reference).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions.text import go_string

VIDEO_SCHEMA = "items array<struct<id string, snippet struct<title string, description string>>>"
# Fixed values of the reference's video processor.
VIDEO_SOURCE = "youtube"
VIDEO_URL_PREFIX = "https://youtube.com/watch?v="


def parse_videos(landed: DataFrame, now: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Landed ``(source_id, url = video id, body, fetched_at)`` -> Content rows + ``error``
    (for an error row, ``url`` is the landed video id); columns ``keep`` are carried along."""
    now = now if now is not None else F.current_timestamp()
    x = landed.withColumn("_first", F.try_element_at(
        F.from_json(F.col("body"), VIDEO_SCHEMA)["items"], F.lit(1)))
    ok = F.col("_first").isNotNull()
    return x.select(
        "source_id",
        go_string(F.col("_first.snippet.title")).alias("title"),
        go_string(F.col("_first.snippet.description")).alias("text"),
        F.lit(VIDEO_SOURCE).alias("source"),
        F.when(ok, F.concat(F.lit(VIDEO_URL_PREFIX), go_string(F.col("url")))).otherwise(F.col("url")).alias("url"),
        now.alias("published_at"),
        F.when(~ok, F.lit("video not found")).alias("error"), *keep)
