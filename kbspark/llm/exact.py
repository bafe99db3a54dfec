"""Exact duplicates: group by a 128-bit content hash, keep one stable id, compare bytes inside groups.

Texts are equal when they are identical after A-Z is lower-cased (nothing else is folded).

1. One scan of the texts hashes every row; the narrow rows (row key, id, hash, SHA-256) are stored.
2. The hashes are grouped; only groups of several rows are stored, each with its size and the row that stays.
3. *Bytes are compared inside those groups*: their texts are grouped by (hash, text), so equal copies
   collapse in the task that reads them and what is left per hash is the number of different texts.
   Hashes with more than one (collisions) are grouped again by the text itself.
4. Every narrow row is joined to its group; a row without one is alone.

Scale: DataFrame functions only. The stored groups are counted: if they fit ``broadcast_bytes`` they are
broadcast to both joins, so that texts of rows that are alone are never shuffled and nothing is dealt
out by a hot hash; beyond that both are sort-merge joins, of which AQE splits hot hashes (both sides
are plain scans). Groups are formed by partial aggregates, so a text that is a third of all rows costs
one row per task.

Defined cases: null texts count as empty, and all empty texts are one group; repeated rows and
repeated ids are rows of their own, of which exactly one per group stays; which of several rows with
the same id and text stays is arbitrary (they differ at most in columns this operator does not
read); rows with a null id are left behind rows with an id (a group of null ids only has a null
``keep_id`` and still one row that stays); an empty table gives no rows; extra columns are ignored,
whatever their names (``drop_exact_duplicates`` carries them along).
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.session import scratch_dir


def folded(text: Column) -> Column:
    """The text with A-Z lower-cased and null as empty. Texts of single bytes take the short way."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return (F.when(F.octet_length(t) == F.char_length(t), F.lower(t))
            .otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase)))


def content_hash(text: Column) -> Column:
    """128 bits of the content."""
    return F.unhex(F.md5(text))


#: What a group takes in a broadcast hash table.
GROUP_BYTES = 128


def exact_duplicates(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text",
                     content_hash: Callable[[Column], Column] = content_hash, broadcast_bytes: int = 128 << 20) -> DataFrame:
    """One row per document: ``id_col``, keep_id, group_size, kept, text_sha256 (of the folded text).

    ``keep`` is ``smallest`` or ``largest``: which id of a group stays.
    """
    out = _classes(docs, F.monotonically_increasing_id(), keep, id_col, text_col, content_hash, broadcast_bytes)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text",
                          broadcast_bytes: int = 128 << 20) -> DataFrame:
    """The rows that stay, with all their columns. The rows are stored once, under a row key."""
    key = "row_key"
    while key in docs.columns:
        key += "_"
    path = scratch_dir(docs.sparkSession, "exact") + "/staged"
    docs.withColumn(key, F.monotonically_increasing_id()).write.parquet(path)
    staged = docs.sparkSession.read.parquet(path)
    stay = _classes(staged, F.col(f"`{key}`"), keep, id_col, text_col, content_hash, broadcast_bytes).filter("kept")
    return staged.join(stay.select(F.col("row").alias(key)), key, "left_semi").select(*[f"`{c}`" for c in docs.columns])


def _groups(rows: DataFrame, by: list[str], keep: str) -> DataFrame:
    """Groups of several rows: the columns ``by``, group_size, keep_id, keep_row."""
    best, row_of = (F.min, F.min_by) if keep == "smallest" else (F.max, F.max_by)
    return (rows.groupBy(*by)
            .agg(F.count(F.lit(1)).alias("group_size"), best("id").alias("keep_id"),
                 F.coalesce(row_of("row", "id"), F.min("row")).alias("keep_row"))
            .filter("group_size > 1"))


def _classes(docs: DataFrame, row: Column, keep: str, id_col: str, text_col: str,
             content_hash: Callable[[Column], Column], broadcast_bytes: int) -> DataFrame:
    """row, id, sha, keep_id, group_size, kept of every row."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    spark, base = docs.sparkSession, scratch_dir(docs.sparkSession, "exact")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    texts = docs.select(F.col(f"`{id_col}`").alias("id"), folded(F.col(f"`{text_col}`")).alias("t"))
    rows = stored(docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("id"), folded(F.col(f"`{text_col}`")).alias("t"))
                  .select("row", "id", content_hash(F.col("t")).alias("h"), F.unhex(F.sha2("t", 256)).alias("sha")), "rows")
    groups = stored(_groups(rows, ["h"], keep), "groups")
    if groups.count() * GROUP_BYTES <= broadcast_bytes:
        groups = F.broadcast(groups)

    hashed = texts.withColumn("h", content_hash(F.col("t")))
    different = hashed.join(groups.select("h"), "h", "left_semi").groupBy("h", "t").agg(F.count(F.lit(1)).alias("n"))
    collided = stored(different.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "collided")
    if collided.isEmpty():
        return _joined(rows, groups, ["h"])

    clash = stored(hashed.join(collided, "h", "left_semi")
                   .select(F.monotonically_increasing_id().alias("row"), "id", "t", F.unhex(F.sha2("t", 256)).alias("sha")), "clash")
    return (_joined(rows.join(collided, "h", "left_anti"), groups, ["h"])
            .unionByName(_joined(clash, stored(_groups(clash, ["t"], keep), "clash_groups"), ["t"])))


def _joined(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    alone = F.col("keep_row").isNull()
    return (rows.join(groups, by, "left")
            .select("row", "id", "sha", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                    (alone | (F.col("row") == F.col("keep_row"))).alias("kept")))


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT *, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM w
"""
