"""Paged document text -> Content (one row per document).

Input is page-text rows ``(path, page_no, text)``: pages in page order, NULL
pages skipped, text concatenated without separator; title = source = url =
path.  A document whose pages are all NULL still gives one row with ``''``.

Two-level ordered concatenation so that one huge document (a third of all
pages) is not concatenated by one task from raw rows: pages are first joined
within blocks of ``block_pages`` (distributed over (path, block)), then the
few block strings of a path are joined in block order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_PAGES = 256


def _ordered_concat(key_col: str, text_col: str) -> Column:
    """Concatenate ``text_col`` of the group in ``key_col`` order; NULLs skipped."""
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(key_col), F.col(text_col)))),
                    lambda s: s[text_col]), "")


def stitch_pages(pages: DataFrame, now: Column | None = None, block_pages: int = BLOCK_PAGES,
                 keys: list[str] | None = None) -> DataFrame:
    """``(path, page_no, text)`` (+ ``keys``) -> Content rows (+ ``keys``), one per path."""
    now = now if now is not None else F.current_timestamp()
    keys = list(keys or [])
    blocks = (pages.withColumn("_blk", F.floor(F.col("page_no") / F.lit(block_pages)))
              .groupBy(*keys, "path", "_blk").agg(_ordered_concat("page_no", "text").alias("_t")))
    docs = blocks.groupBy(*keys, "path").agg(_ordered_concat("_blk", "_t").alias("text"))
    path = F.coalesce(F.col("path"), F.lit(""))
    return docs.select(*keys, path.alias("title"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
                       path.alias("source"), path.alias("url"), now.alias("published_at"))
