"""T4: approximate top-k with an inverted-file (IVF) index, cosine metric.

Build: ``pyspark.ml`` KMeans (cosine distance, distributed Lloyd iterations
over the whole table) gives ``n_lists`` centroids; every vector is assigned
its cell by the fitted model (JVM, no join back).  The index can be written
partitioned by cell, with large cells spread over several files (rebalance by
size), so a probe reads only the cells it needs (partition pruning).

Search: each query probes its ``n_probe`` most similar centroids; scoring runs
in the same Arrow-batched matmul scorers as the exact search (broadcast queries, or the
shuffled grid of ``operators.grid`` for a large query table), restricted per
cell to the queries that probe it, then the exact per-query top-k.  With
``n_probe = n_lists`` the result equals the exact search.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.functions.vectors import l2_normalize
from kbspark.operators.grid import keys_of, unit_rows
from kbspark.operators.retrieve import _to_matrix, top_k_batch
from kbspark.session import ensure_checkpoint_dir

# Fixed default of the reference's index (ivfflat, lists = 100).
DEFAULT_LISTS = 100
MAX_CENTROIDS = 65_536


@dataclass
class IVFIndex:
    centroids: np.ndarray        # (n_lists x dim), unit rows
    data: DataFrame              # doc_id, embedding, cell (+ other columns)

    @property
    def n_lists(self) -> int:
        return len(self.centroids)

    def write(self, path: str) -> "IVFIndex":
        """Persist partitioned by cell; the rebalance splits a large cell over writers by its size."""
        (self.data.hint("rebalance", "cell").write.mode("errorifexists").partitionBy("cell").parquet(path))
        return IVFIndex(self.centroids, self.data.sparkSession.read.parquet(path))

    def probe_fn(self, n_probe: int):
        cent = self.centroids

        def probes(qmat: np.ndarray) -> np.ndarray:
            p = min(n_probe, cent.shape[0])
            top = np.argsort(-keys_of(qmat @ cent.T), axis=1, kind="stable")[:, :p]
            mask = np.zeros((len(qmat), len(cent)), dtype=bool)
            np.put_along_axis(mask, top, True, axis=1)
            return mask
        return probes


def assign_ivf(kb: DataFrame, centroids: DataFrame, vec_col: str = "embedding") -> IVFIndex:
    """An index on given centroids: a small table of vectors, one cell each, in row order (at most
    ``MAX_CENTROIDS``). Vectors without a direction are in no cell."""
    cent = _unit_centroids(centroids, vec_col)
    data = _assigned(kb, cent, vec_col)
    ensure_checkpoint_dir(kb.sparkSession)
    return IVFIndex(cent, data.checkpoint(eager=True))


def _unit_centroids(centroids: DataFrame, vec_col: str) -> np.ndarray:
    rows = centroids.select(vec_col).limit(MAX_CENTROIDS + 1).collect()
    if not 0 < len(rows) <= MAX_CENTROIDS:
        raise ValueError(f"1 to {MAX_CENTROIDS} centroids expected")
    cent, ok = _to_matrix([r[0] for r in rows], max(len(r[0] or ()) for r in rows))
    if not ok.all():
        raise ValueError("a centroid has no direction")

    return cent


def _assigned(kb: DataFrame, cent: np.ndarray, vec_col: str) -> DataFrame:
    """``kb`` with the ``cell`` of each usable vector."""
    at = kb.columns.index(vec_col)

    def assign(batches):
        for b in batches:                          # the columns stay as they are: 64-bit ids are exact
            unit, good = unit_rows(b.column(at), cent.shape[1])
            yield b.filter(pa.array(good)).append_column("cell", pa.array(np.argmax(keys_of(unit @ cent.T), axis=1) if len(unit) else [], pa.int32()))

    return kb.mapInArrow(assign, T.StructType([*kb.schema.fields, T.StructField("cell", T.IntegerType())]))


def build_ivf(kb: DataFrame, n_lists: int = DEFAULT_LISTS, seed: int = 42, max_iter: int = 20,
              vec_col: str = "embedding") -> IVFIndex:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = l2_normalize(F.col(vec_col))
    data = kb.select("doc_id", unit.alias("_unit")).filter(F.col("_unit").isNotNull()) \
        .select(array_to_vector("_unit").alias("_features"))
    km = KMeans(k=n_lists, seed=seed, maxIter=max_iter, distanceMeasure="cosine",
                featuresCol="_features", predictionCol="cell")
    ensure_checkpoint_dir(kb.sparkSession)
    data = data.persist()           # Lloyd iterations re-read the training set
    model = km.fit(data)
    cent = np.array([np.asarray(c, dtype=np.float64) for c in model.clusterCenters()])
    norms = np.linalg.norm(cent, axis=1)
    cent[norms > 0] /= norms[norms > 0, None]
    data.unpersist()
    full = kb.withColumn("_unit", unit).filter(F.col("_unit").isNotNull()).withColumn("_features", array_to_vector("_unit"))
    assigned = model.transform(full).drop("_unit", "_features").withColumn("cell", F.col("cell").cast("int"))
    # The built index is materialised once (reliable checkpoint).
    return IVFIndex(cent, assigned.checkpoint(eager=True))


def ann_topk(queries: DataFrame, index: IVFIndex, k: int = 10, n_probe: int = 1,
             threshold: float | None = None, query_id: str = "query_id", query_vec: str = "embedding",
             max_broadcast_bytes: int | None = None, strategy: str = "auto") -> DataFrame:
    """Approximate per-query top-k: ``(query_id, doc_id, sim_key, similarity, rank)``."""
    return top_k_batch(queries, index.data, k=k, threshold=threshold, query_id=query_id, query_vec=query_vec,
                       max_broadcast_bytes=max_broadcast_bytes, strategy=strategy,
                       _probe=(index.centroids, index.probe_fn(n_probe), n_probe))


class StoredIndex:
    """An IVF index that stays current under writes (W1, W5): a stored table with a partition per cell.

    An upsert or a delete rewrites the cells that hold the old or the new vectors of its keys, as one
    version; other cells are neither read (but for their ids, to find the old ones) nor written. The
    contents equal a fresh assignment of the current vectors to the same centroids. Rows with a NULL id or
    without a usable vector are in no cell; an upsert of such a vector takes the old one out. Several
    writers and replays are safe, as the table's commits are (``sources.buckets``).
    """

    def __init__(self, spark, root: str, centroids: DataFrame | None = None, vec_col: str = "embedding"):
        from kbspark.sources.buckets import BucketStore
        self.vec_col, path = vec_col, f"{root.rstrip('/')}/centroids"
        if centroids is not None:                  # a small table, see ``assign_ivf``; its order names the cells
            rows = centroids.select(vec_col).limit(MAX_CENTROIDS + 1).collect()
            spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "cell int, embedding array<float>").coalesce(1).write.parquet(path)
        self.centroids = spark.read.parquet(path).orderBy("cell").select(F.col("embedding").alias(vec_col))
        self._cent = _unit_centroids(self.centroids, vec_col)
        schema = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField(vec_col, T.ArrayType(T.FloatType())),
                               T.StructField("cell", T.IntegerType())])
        self.store = BucketStore(spark, root, schema, key="doc_id", n_buckets=len(self._cent), bucket_by="cell", dated=False)

    def index(self) -> IVFIndex:
        """The current index, for ``ann_topk``; a search reads only the partitions of the cells it probes."""
        return IVFIndex(self._cent, self.store.read())

    def _assigned(self, rows: DataFrame) -> DataFrame:
        ensure_checkpoint_dir(rows.sparkSession)
        rows = rows.filter(F.col("doc_id").isNotNull()).select("doc_id", F.col(self.vec_col).cast("array<float>").alias(self.vec_col))
        return _assigned(rows, self._cent, self.vec_col).checkpoint(eager=True)

    def build(self, rows: DataFrame, batch_id=None) -> bool:
        """The whole index anew from ``doc_id`` and the vector column."""
        return self.store.replace(self._assigned(rows), batch_id)

    def upsert(self, rows: DataFrame, batch_id=None) -> bool:
        """Replace or insert the vectors of ``rows`` (one row per ``doc_id``)."""
        return self._replace(rows.select("doc_id"), self._assigned(rows), batch_id)

    def delete(self, ids: DataFrame, batch_id=None) -> bool:
        """Take the given ``doc_id`` out."""
        return self._replace(ids.select("doc_id"), None, batch_id)

    def keep_only(self, kb: DataFrame, batch_id=None) -> bool:
        """Take out what ``kb`` does not hold (any more), as after a retention delete."""
        return self._replace(lambda have: have.join(kb.select("doc_id"), "doc_id", "left_anti"), None, batch_id)

    def _replace(self, ids, new: DataFrame | None, batch_id) -> bool:
        from kbspark.operators.store import _keys

        def plan(s):
            have = self.store.read(state=s, with_day=True).select("doc_id", "bucket")
            gone = ids(have.select("doc_id")) if callable(ids) else ids
            gone = _keys(gone.filter(F.col("doc_id").isNotNull()), "doc_id")
            cells = {r[0] for r in have.join(gone, "doc_id", "left_semi").select("bucket").distinct().collect()}
            cells |= set(self.store.buckets_of(new)) if new is not None else set()
            touched = sorted(cells)                # at most the number of cells
            if not touched:
                return None, {"buckets": []}
            left = self.store.read(touched, s).join(gone, "doc_id", "left_anti").select(*self.store.columns)
            return (left if new is None else left.unionByName(new)), {"buckets": touched}
        return self.store.update(plan, batch_id)
