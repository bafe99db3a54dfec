"""Connected components of an edge table, by contraction in DataFrame steps.

Each round every vertex points to the neighbour (or itself) of the smallest hash; pointers are
followed twice and the edges contracted, so the vertices shrink by a constant factor a round on
average whatever the shape (chains included, as the order is by hash). Minima are aggregated
before the shuffle, so a hub with a third of all edges sends one row per task. Pointer tables are
broadcast while they have at most ``BROADCAST_ROWS`` rows and shuffled beyond that. Rounds are cut
by tables in the shared checkpoint folder; only row counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.session import scratch_dir

MAX_ROUNDS = 100
BROADCAST_ROWS = 200_000
#: Steps over tables of at most this many rows end in few tasks.
FEW_ROWS = 500_000


def in_few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df``, made of about ``rows`` rows, with no more partitions than so small a table needs."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism) if rows <= FEW_ROWS else df


def _stored(df: DataFrame, path: str, rows: int | None = None) -> DataFrame:
    if rows is not None:
        df = in_few_tasks(df, rows)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table, marked for broadcast if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= rows else df


def _by_hash(c: str) -> Column:
    return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(id, root) for every vertex of an edge; ``root`` is one vertex of its component.

    Vertices may have any orderable type; null ends and self loops link nothing.
    """
    spark = edges.sparkSession
    base = scratch_dir(spark, "components")
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b").distinct()
    e = _stored(e, f"{base}/edges0")
    found = None                                            # (id, root) so far
    for k in range(1, MAX_ROUNDS):
        n = e.count()
        if n == 0:
            break
        near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = (near.groupBy("a").agg(F.min(_by_hash("b")).alias("m"))
                 .select(F.col("a").alias("v"), F.least(F.col("m"), _by_hash("a"))["x"].alias("p")))
        point = _stored(point, f"{base}/point{k}", n)
        few = small(point) is not point
        mark = F.broadcast if few else (lambda df: df)
        hop = mark(point.select(F.col("v").alias("p"), F.col("p").alias("q")))
        jump = _stored(point.join(hop, "p").select("v", F.col("q").alias("root")), f"{base}/jump{k}", n)
        left = mark(jump.select(F.col("v").alias("a"), F.col("root").alias("ra")))
        right = mark(jump.select(F.col("v").alias("b"), F.col("root").alias("rb")))
        e = e.join(left, "a").join(right, "b").filter("ra <> rb")
        e = _stored(e.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{base}/edges{k}", n)
        if found is None:
            found = jump.select(F.col("v").alias("id"), "root")
        else:
            step = mark(jump.select(F.col("v").alias("root"), F.col("root").alias("next")))
            found = _stored(found.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root")), f"{base}/found{k}")
    else:
        raise RuntimeError("connected components did not converge")
    if found is None:
        found = e.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return found
