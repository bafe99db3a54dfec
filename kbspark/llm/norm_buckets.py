"""Exact top-k inner products: norm-bucketed retrieval with length and coordinate pruning.

Candidates are grouped into buckets of similar length (powers of ``1 + spread``), and long groups
are cut into blocks of at most about ``block`` rows. A first pass scores every query against one
bounded block of the longest candidates; the k-th score found is a lower bound ``theta`` of the
query's final k-th score. A bucket of greatest length ``l`` can then hold a result of a query only
if ``theta <= |q| * l``: other pairs of query and bucket are never formed (length pruning). Inside a
bucket the local cosine threshold ``tau = theta / (|q| * l)`` picks the method: if the lengths vary
more than the threshold forbids, the candidates sorted by length are cut at ``theta / |q|``; else, if
tau is positive, the query's largest coordinates f bound the candidates' normalised coordinates to
``[q_f tau - r, q_f tau + r]`` with ``r = sqrt((1 - tau^2)(1 - q_f^2))``, found by binary search in the
bucket's sorted coordinate lists. What is left is verified by its exact inner product.

Scale: queries and buckets meet in one shuffle on the bucket; queries are sent only to buckets that
they may need, as rows that stream past the one block of candidates a task holds. At most k rows per
query and bucket leave a task, and the final ranking limits before its shuffle. The driver sees the
sizes of the length groups (bounded by the range of lengths) and these first candidates.

Exactness: bounds get a slack far above rounding and keep equal scores, so ties are decided by
(score, id) alone. Products that fit 53 bits are summed in floating point exactly, others in
integers; scores outside 64 bits are cut to its range.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, as
query or candidate; so do rows with a null id; a query meets only candidates of its own dimension;
rows that repeat a candidate id are candidates of their own, but never for the query of their id;
of rows that repeat a query id the smallest vector asks; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.session import scratch_dir

#: Float sums of integers are exact below this.
EXACT = float(1 << 52)
SLACK = 1e-9
#: Coordinates looked at per query and bucket in coordinate pruning.
FOCUS = 3
#: Candidates and dimensions of the first bounds.
SEEDS, SEED_DIMS = 1000, 16


def integer_vectors(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<double>): floor(``scale`` * component) of the rows that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ok)
    # floor() returns longs; a double without its fraction keeps large values
    def whole(y):
        part = y % F.lit(1.0)
        return y - part - F.when(part < 0, 1.0).otherwise(0.0)

    return v.select("vec_id", F.transform("v", lambda x: x * F.lit(float(scale))).alias("y")).select(
        "vec_id", F.transform("y", whole).alias("x"))


def _products(q: np.ndarray, c: np.ndarray, big: bool) -> np.ndarray:
    if not big:
        return (c @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(q, row)) for row in c]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in exact], np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (score desc, id)."""
    if len(scores) > k:
        floor = np.partition(scores, -k)[-k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


class _Block:
    """The candidates of one bucket block, sorted by length, longest first."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        length = np.sqrt((x * x).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        self.ids, self.x, self.length = ids[order], x[order], length[order]
        with np.errstate(invalid="ignore", divide="ignore"):
            self.unit = np.where(self.length[:, None] > 0, self.x / self.length[:, None], 0.0)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = (self.unit[order, f], order)
        return self.lists[f]

    def candidates(self, q: np.ndarray, q_len: float, theta: float | None) -> np.ndarray | None:
        """Positions that may reach ``theta``; None for all."""
        n = len(self.ids)
        if theta is None or theta <= 0 or q_len == 0:
            return None
        tau = theta / (q_len * self.length[0]) if self.length[0] > 0 else math.inf
        if tau > 1 + SLACK:
            return np.zeros(0, np.int64)
        # length pruning: |c| >= theta / |q|
        cut = int(np.searchsorted(-self.length, -(theta / q_len) * (1 - SLACK), "right"))
        if cut < n // 4 or tau < 0.2:
            return np.arange(cut)
        # coordinate pruning: each focus coordinate leaves an interval of its sorted list
        unit, t = q / q_len, min(tau, 1.0)
        best = None
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            r = math.sqrt(max(0.0, (1 - t * t) * (1 - unit[f] * unit[f]))) + SLACK
            low = unit[f] * t - r if unit[f] * t - r > -1 else -math.inf
            high = unit[f] * t + r
            # a candidate closer than tau lies nearer to the query: the far end opens up to the query's side
            if unit[f] >= 0:
                high = math.inf if unit[f] >= t else high
            else:
                low = -math.inf if -unit[f] >= t else low
            values, order = self._list(int(f))
            a, b = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            if best is None or b - a < len(best):
                best = order[a:b]
        return best[best < cut] if cut < n else best


def _matrix(batch, column: int, dim: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096, spread: float = 0.1) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` candidates of highest integer inner product per
    query, ties to the smaller id. ``vectors`` and ``queries`` are (vec_id, x array<double>) of whole
    numbers, as from ``integer_vectors``; a query's own id is no candidate."""
    spark = vectors.sparkSession
    base = scratch_dir(spark, "norm-buckets")

    def store(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    def with_length(df: DataFrame) -> DataFrame:
        # scaled by the largest component, so that squares stay finite
        return (df.withColumn("m", F.aggregate("x", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))
                .withColumn("len", F.when(F.col("m") > 0, F.col("m") * F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + (x / F.col("m")) * (x / F.col("m"))))).otherwise(0.0))
                .withColumn("dim", F.size("x")).drop("m"))

    cand = with_length(vectors.select("vec_id", "x"))
    step = math.log1p(spread)
    cand = cand.withColumn("grp", F.when(F.col("len") > 0, F.floor(F.log("len") / F.lit(step))).otherwise(F.lit(-10_000)).cast("int"))
    cand = store(cand, "candidates")
    # Repeated query ids: the smallest vector asks.
    asks = store(with_length(queries.groupBy("vec_id").agg(F.min("x").alias("x"))), "queries")
    groups = [(r.dim, r.grp, r.n, r.top) for r in cand.groupBy("dim", "grp").agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("top")).collect()]
    if not groups:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Length groups become numbered blocks: (dim, grp) -> first block, number of blocks, greatest length.
    plan, first = [], 0
    for dim, grp, n, top in sorted(groups, key=lambda g: (g[0], -g[1])):
        blocks = math.ceil(n / block)
        plan.append((dim, grp, first, blocks, float(top)))
        first += blocks
    plan_df = F.broadcast(spark.createDataFrame(plan, "dim int, grp int, b_first int, blocks int, top double"))

    to_hold = (cand.join(plan_df, ["dim", "grp"])
               .withColumn("b", (F.col("b_first") + F.pmod(F.xxhash64("vec_id", "x"), F.col("blocks"))).cast("int"))
               .select("b", F.lit(0).alias("kind"), "vec_id", "dim", "x", F.lit(None).cast("long").alias("theta")))

    # First bounds, from the blocks of the longest candidates (at least SEEDS rows, if there are so
    # many, at most that and a block) of up to SEED_DIMS dimensions; others start without a bound.
    sizes = {(dim, grp): n for dim, grp, n, _ in groups}
    seed_blocks = []
    for d in sorted({p[0] for p in plan}, key=lambda d: -sum(n for (e, _), n in sizes.items() if e == d))[:SEED_DIMS]:
        got = 0
        for dim, grp, b_first, blocks, _ in plan:
            take = min(blocks, max(0, math.ceil((SEEDS - got) * blocks / sizes[dim, grp]))) if dim == d else 0
            seed_blocks += range(b_first, b_first + take)
            got += take * sizes[dim, grp] // blocks
    seed_rows = to_hold.filter(F.col("b").isin(seed_blocks)).select("dim", "vec_id", "x").collect()
    held = {}
    for d in {r.dim for r in seed_rows}:
        mine = [r for r in seed_rows if r.dim == d]
        held[d] = (np.array([r.vec_id for r in mine], np.int64), np.array([r.x for r in mine], float))
    held = spark.sparkContext.broadcast(held)

    def bound(batches):
        for b in batches:
            out = []
            for q, x in zip(b.column(0).to_pylist(), b.column(1)):
                x = x.values.to_numpy(zero_copy_only=False)
                ids, c = held.value.get(len(x), (np.zeros(0, np.int64), np.zeros((0, len(x)))))
                other = ids != q
                big = len(c) > 0 and np.sqrt((x * x).sum()) * np.sqrt((c * c).sum(axis=1).max()) >= EXACT
                s = _products(x, c[other], bool(big))
                out.append(int(np.partition(s, -k)[-k]) if len(s) >= k else None)
            yield pa.record_batch({**{n: b.column(i) for i, n in enumerate(b.schema.names)}, "theta": pa.array(out, pa.int64())})

    asked = asks.select("vec_id", "x", "len", "dim").mapInArrow(bound, "vec_id long, x array<double>, len double, dim int, theta long")

    reach = F.col("theta").isNull() | (F.col("theta") <= F.col("len") * F.col("top") * (1 + SLACK) + SLACK)
    to_ask = (asked.join(plan_df, "dim").filter(reach)
              .withColumn("b", F.explode(F.sequence(F.col("b_first"), F.col("b_first") + F.col("blocks") - 1)))
              .select("b", F.lit(1).alias("kind"), "vec_id", "dim", "x", "theta"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = to_hold.unionByName(to_ask).repartition(min(first, parts), "b").sortWithinPartitions("b", "kind")

    def verify(batches):
        state, ids, mats = None, [], []          # the block being gathered or asked
        blk = None
        for batch in batches:
            bs = batch.column(0).to_numpy(zero_copy_only=False)
            kinds = batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(bs) != 0) | (np.diff(kinds) != 0)) + 1
            out = ([], [], [])
            for a, z in zip([0, *edges], [*edges, len(bs)]):
                if a == z:
                    continue
                part, b, kind = batch.slice(a, z - a), int(bs[a]), int(kinds[a])
                dim = part.column(3)[0].as_py()
                if b != state:
                    state, ids, mats, blk = b, [], [], None
                if kind == 0:
                    ids.append(part.column(2).to_numpy())
                    mats.append(_matrix(part, 4, dim))
                    continue
                if not ids:
                    continue
                if blk is None:
                    blk = _Block(np.concatenate(ids), np.concatenate(mats))
                xs = _matrix(part, 4, dim)
                for q, x, theta in zip(part.column(2).to_pylist(), xs, part.column(5).to_pylist()):
                    q_len = float(np.sqrt((x * x).sum()))
                    at = blk.candidates(x, q_len, theta)
                    c, i = (blk.x, blk.ids) if at is None else (blk.x[at], blk.ids[at])
                    if not len(i):
                        continue
                    s = _products(x, c, q_len * float(blk.length[0]) >= EXACT)
                    ok = i != q
                    if theta is not None:
                        ok &= s >= theta
                    s, i = s[ok], i[ok]
                    for p in _best(s, i, k):
                        out[0].append(q)
                        out[1].append(int(i[p]))
                        out[2].append(int(s[p]))
            if out[0]:
                yield pa.record_batch([pa.array(o, pa.int64()) for o in out], ["query_id", "vec_id", "score"])

    scored = met.mapInArrow(verify, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
