"""Two-phase exact search over a stored index (T1, T2, T3, X1): 8-bit codes first, exact scores of what can matter.

The index keeps, beside each vector, its unit vector's 8-bit *code* (``dim`` bytes), the step of the code and the
distance ``err`` between the unit vector and what the code stands for. For a unit query q, Cauchy-Schwarz gives
|q.u - q.code| <= err, a proven bound. So:

1. The first scan reads ids, codes and bounds (column pruning: about an eighth of the bytes of float64
   vectors, a quarter of float32). A row whose upper bound is below the k-th best *lower* bound cannot be in the top k.
2. The rows that are left are looked up by id in their buckets and scored exactly; rank key and ties as everywhere.

Equal vectors share their bounds; of those, a task passes on the k smallest ids only, so a vector that is a third of all
rows costs k candidates per task. A task holds a bounded multiple of k candidates per query and distinct vector, of at most
``QUERY_ROWS`` queries at once.

The table is a ``BucketStore``: upserts and deletes rewrite the buckets of their ids, several writers and replays
are safe. Rows with a NULL id or without a usable vector (NULL, zero, not finite) are not in the index; an upsert of such a vector takes
the old one out; a vector of another dimension is an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.functions.vectors import SIM_SCALE, key_to_sim, threshold_key
from kbspark.operators.grid import keys_of, unit_rows
from kbspark.operators.retrieve import DEFAULT_MAX_BROADCAST_BYTES, _ranked, top_k_batch
from kbspark.session import ensure_checkpoint_dir, scratch_dir
from kbspark.sources.buckets import BucketStore

#: What rounding may add to a score or take from it, and to the code's error (both far above float64's).
_SLACK = 1e-8
#: Ids that are pushed down to the scan of the second phase as literals.
MAX_LITERALS = 1000
#: Queries whose candidates a task holds at once; more are worked through in as many parts.
QUERY_ROWS = 8192

SCHEMA = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("code", T.BinaryType()), T.StructField("step", T.DoubleType()),
                       T.StructField("err", T.DoubleType()), T.StructField("same", T.LongType())])


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, steps, errors) of unit vectors: ``codes * step`` is within ``err`` of the vector."""
    step = np.abs(unit).max(axis=1, initial=0) / 127
    codes = np.rint(unit / step[:, None]).astype(np.int8)
    return codes, step, np.sqrt(((unit - codes * step[:, None]) ** 2).sum(axis=1)) + _SLACK


def _coded(rows: DataFrame, dim: int) -> DataFrame:
    def code(batches):
        for b in batches:
            unit, ok = unit_rows(b.column(1), dim)
            kept = b.filter(pa.array(ok))
            codes, step, err = encode(unit)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim), len(codes), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
            yield pa.record_batch([kept.column(0), kept.column(1), raw, pa.array(step), pa.array(err), kept.column(2)],
                                  names=[f.name for f in SCHEMA.fields])
    src = rows.filter(F.col("doc_id").isNotNull()).select("doc_id", F.col("embedding").cast("array<float>").alias("embedding"))
    return src.withColumn("same", F.xxhash64("embedding")).mapInArrow(code, SCHEMA)


class CodedIndex:
    """``dim`` is the dimension of the vectors, ``n_buckets`` the number of buckets by id."""

    def __init__(self, spark, root: str, dim: int, n_buckets: int = 64):
        self.spark, self.dim = spark, dim
        self.store = BucketStore(spark, root, SCHEMA, key="doc_id", n_buckets=n_buckets, dated=False)

    # -- write --------------------------------------------------------------------
    def build(self, rows: DataFrame, batch_id=None) -> bool:
        """The whole index anew from ``doc_id`` and ``embedding``."""
        return self.store.replace(_coded(rows, self.dim), batch_id)

    def upsert(self, rows: DataFrame, batch_id=None) -> bool:
        """Replace or insert the vectors of ``rows`` (one row per ``doc_id``)."""
        ensure_checkpoint_dir(self.spark)
        return self._replace(rows.select("doc_id"), _coded(rows, self.dim).checkpoint(eager=True), batch_id)

    def delete(self, ids: DataFrame, batch_id=None) -> bool:
        return self._replace(ids.select("doc_id"), None, batch_id)

    def _replace(self, ids: DataFrame, new: DataFrame | None, batch_id) -> bool:
        from kbspark.operators.store import _keys
        ids = ids.filter(F.col("doc_id").isNotNull())
        touched, gone = self.store.buckets_of(ids), _keys(ids, "doc_id")

        def plan(s):
            if not touched:
                return None, {"buckets": []}
            left = self.store.read(touched, s).join(gone, "doc_id", "left_anti").select(*self.store.columns)
            return (left if new is None else left.unionByName(new)), {"buckets": touched}
        return self.store.update(plan, batch_id)

    # -- search -------------------------------------------------------------------
    def similar(self, query_vector, k: int = 10, threshold: float | None = 0.5) -> DataFrame:
        """``(doc_id, sim_key, similarity, rank)`` of one query vector."""
        q = self.spark.createDataFrame([(0, [float(x) for x in query_vector])], "query_id int, embedding array<double>")
        return self.top_k(q, k, threshold).drop("query_id")

    def top_k(self, queries: DataFrame, k: int = 10, threshold: float | None = None, query_id: str = "query_id",
              query_vec: str = "embedding", max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
        """T2 / T3 for a query table, as ``top_k_batch``. Query vectors up to ``max_broadcast_bytes`` (measured)
        are broadcast; a larger table meets the vectors in the shuffled grid of ``top_k_batch``."""
        s, n = self.store.state(), queries.count()
        if n * self.dim * 8 > max_broadcast_bytes:
            return top_k_batch(queries, self.store.read(state=s).select("doc_id", "embedding"), k, threshold, query_id, query_vec, strategy="grid")
        queries = queries.select(query_id, query_vec)
        if n <= QUERY_ROWS:
            return _ranked(self._exact(queries, k, threshold, query_id, query_vec, s), k, query_id, "doc_id")
        # 25% headroom: hash parts are only approximately equal. The parts follow each other; each leaves its scores.
        n_parts, base = math.ceil(n / (0.75 * QUERY_ROWS)), scratch_dir(self.spark, "coded")
        part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_parts))
        queries.withColumn("_part", part).write.parquet(f"{base}/queries")
        dealt = self.spark.read.parquet(f"{base}/queries")
        for p in range(n_parts):
            found = self._exact(dealt.filter(F.col("_part") == p).drop("_part"), k, threshold, query_id, query_vec, s)
            found.write.parquet(f"{base}/scores/{p}")
        return _ranked(self.spark.read.schema(found.schema).parquet(f"{base}/scores/*"), k, query_id, "doc_id")

    def _exact(self, queries: DataFrame, k: int, threshold: float | None, query_id: str, query_vec: str, s) -> DataFrame:
        """(query_id, doc_id, sim_key) of the candidates, scored exactly; the queries are broadcast."""
        table = queries.select(query_id, query_vec).toArrow()
        unit, ok = unit_rows(table.column(1), self.dim)
        ids = table.column(0).filter(pa.array(ok)).combine_chunks()
        least = -np.inf if threshold is None else threshold_key(threshold) / SIM_SCALE - _SLACK
        seen = self.spark.sparkContext.broadcast(unit)
        found = self.candidates(seen, k, least, s)
        ensure_checkpoint_dir(self.spark)
        found = found.checkpoint(eager=True)

        ids_found = found.select("doc_id").distinct()
        few = [r[0] for r in ids_found.limit(MAX_LITERALS + 1).collect()]
        rows = self.store.read(self.store.buckets_of(ids_found), s).select("doc_id", "embedding")
        if len(few) <= MAX_LITERALS:               # pushed down: row groups are skipped by their range and Bloom filter
            rows = rows.filter(F.col("doc_id").isin(few))
        from kbspark.operators.store import KEY_BROADCAST_ROWS
        pairs = F.broadcast(found) if len(few) <= MAX_LITERALS or found.count() <= KEY_BROADCAST_ROWS else found
        dim, id_field = self.dim, pa.field("query_id", ids.type)

        def score(batches):
            for b in batches:
                u, _ = unit_rows(b.column(2), dim)
                at = b.column(0)
                yield pa.record_batch([ids.take(at), b.column(1), pa.array(keys_of((u * seen.value[at.to_numpy()]).sum(axis=1)).astype(np.int64))],
                                      schema=pa.schema([id_field, ("doc_id", pa.string()), ("sim_key", pa.int64())]))
        schema = T.StructType([T.StructField("query_id", queries.schema[query_id].dataType), T.StructField("doc_id", T.StringType()), T.StructField("sim_key", T.LongType())])
        exact = rows.join(pairs, "doc_id").select("q", "doc_id", "embedding").mapInArrow(score, schema)
        if threshold is not None:
            exact = exact.filter(F.col("sim_key") >= threshold_key(threshold))
        return exact

    def candidates(self, queries, k: int, least: float = -np.inf, state=None) -> DataFrame:
        """(q, doc_id): the rows that can be in the top k of query ``q`` (a row of the broadcast unit
        matrix), from codes alone."""
        dim = self.dim

        def pruned(parts: list[pa.Table], floor: np.ndarray) -> pa.Table:
            """What is still possible; of equal vectors the k smallest ids. Raises ``floor`` in place."""
            t = pa.concat_tables(parts)
            if not len(t):
                return t
            t = t.sort_by([("q", "ascending"), ("low", "descending")])
            q, low = t.column("q").to_numpy(), t.column("low").to_numpy()
            kth = np.searchsorted(q, np.arange(len(floor)), "left") + k - 1
            there = (kth < len(q)) & (q[np.minimum(kth, len(q) - 1)] == np.arange(len(floor)))
            floor[there] = np.maximum(floor[there], low[kth[there]])
            t = t.filter(pa.array(t.column("high").to_numpy() >= floor[q])).sort_by([("q", "ascending"), ("same", "ascending"), ("doc_id", "ascending")])
            q, same = t.column("q").to_numpy(), t.column("same").to_numpy()
            first = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1]) | (same[1:] != same[:-1])))) if len(q) else np.zeros(0, int)
            place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
            return t.filter(pa.array(place < k))

        def scan(batches):
            unit = queries.value
            floor, parts, held, bound = np.full(len(unit), least), [], 0, 0
            for b in batches:
                if not b.num_rows or not len(unit):
                    continue
                code = np.frombuffer(b.column(1).cast(pa.binary(dim)).buffers()[1], np.int8, b.num_rows * dim, b.column(1).cast(pa.binary(dim)).offset * dim).reshape(-1, dim)
                step, err = b.column(2).to_numpy()[:, None], b.column(3).to_numpy()[:, None]
                for a in range(0, len(unit), 512):
                    score = (code.astype(np.float64) @ unit[a:a + 512].T) * step
                    low, high = score - err, score + err
                    if len(low) >= k:
                        np.maximum(floor[a:a + 512], np.partition(low, len(low) - k, axis=0)[len(low) - k], out=floor[a:a + 512])
                    r, c = np.nonzero(high >= floor[a:a + 512])
                    at = pa.array(r)
                    parts.append(pa.table({"q": pa.array((c + a).astype(np.int32)), "doc_id": b.column(0).take(at), "low": low[r, c], "high": high[r, c], "same": b.column(4).take(at)}))
                    held += len(r)
                if held > max(1 << 16, 2 * bound):
                    parts = [pruned(parts, floor)]
                    held = bound = len(parts[0])
            if parts:
                yield from pruned(parts, floor).select(["q", "doc_id", "low", "high"]).to_batches()

        codes = self.store.read(state=state).select("doc_id", "code", "step", "err", "same")
        found = codes.mapInArrow(scan, "q int, doc_id string, low double, high double")
        w = Window.partitionBy("q").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        kth = F.coalesce(F.nth_value("low", k).over(w), F.lit(float(least)))
        return found.withColumn("kth", kth).filter(F.col("high") >= F.col("kth")).select("q", "doc_id")
