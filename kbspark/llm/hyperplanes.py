"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosine check, components.

Equal vectors collapse into one class with a count. Each class vector gets ``tables`` codes of
``bits`` signs against random hyperplanes (the same for all rows, from a fixed seed). Classes
with one code in a table meet in a bucket; every pair of a bucket is compared by its exact cosine
in double precision. Two vectors of cosine c agree in one sign with probability
p = 1 - arccos(c) / pi, so at least ``1 - (1 - p^bits)^tables`` of the links are found; ``tables``
follows from the wanted recall at the threshold itself, closer pairs are found more often.

No pairs are written: a block of a bucket counts, per vector, the linked copies it meets (a pair
that already met in an earlier table is left out by its codes, so that counts are exact) and adds
a spanning forest of its links. Counts are summed per vector; components follow from the forests.

Scale: ``bits`` grows with the row count, so that buckets of unrelated vectors hold about
``per_bucket`` rows. Any bucket is cut into blocks of at most ``block`` rows and compared block
against block, each pair of blocks a group of its own, so that a bucket of a third of all rows is
spread over many tasks and each holds two blocks. One shuffle of rows x tables vectors; bucket
sizes are partial aggregates. The driver sees row counts only.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing (n_links 0, own component); vectors of different dimensions link with nothing;
repeated vec_ids are rows of their own for counting (a row does not link with itself) but one
node for components; rows with a null vec_id are counted as links of others, and get the smallest
non-null id of their component or null; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.components import connected_components, small
from kbspark.session import scratch_dir

SEED = 97


def _tables(threshold: float, bits: int, recall: float) -> int:
    p = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-(p ** bits)))) if threshold < 1 else 1


def _codes(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows x tables) sign codes."""
    rng = np.random.default_rng([SEED, x.shape[1]])
    out = np.empty((len(x), tables), np.int32)
    weight = (1 << np.arange(bits)).astype(np.int32)
    for t in range(tables):
        out[:, t] = ((x @ rng.standard_normal((x.shape[1], bits))) >= 0) @ weight
    return out


def _usable(c: str):
    v = F.col(c)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.999, per_bucket: int = 256,
                         block: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links (rows of cosine >= ``threshold``), component_id (smallest
    id reachable by links), kept (whether the vector stands for its component)."""
    spark = vectors.sparkSession
    base = scratch_dir(spark, "hyperplanes")

    def store(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    # -0.0 and 0.0 are one number
    rows = rows.select("vec_id", F.when(_usable("v"), F.transform("v", lambda x: x + F.lit(0.0))).alias("v"))
    rows = rows.withColumn("cls", F.when(F.col("v").isNotNull(), F.sha2(F.array_join(F.transform("v", lambda x: F.hex(x.cast("string"))), ","), 256)))
    classes = store(rows.filter("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"),
                                                                      F.first("v").alias("v")), "classes")
    n = classes.count()
    bits = max(4, min(24, math.ceil(math.log2(max(n, 2) / per_bucket)))) if n > per_bucket else 4
    tables = _tables(threshold, bits, recall)

    def emit(batches):
        for b in batches:
            sizes = pa.compute.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                part = b.filter(pa.array(sizes == dim))
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                codes = _codes(x, bits, tables)
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                for t in range(tables):
                    yield pa.record_batch({"tab": pa.array(np.full(len(x), t, np.int32)), "dim": pa.array(np.full(len(x), dim, np.int32)),
                                           "code": pa.array(codes[:, t]), "cls": part.column(0), "copies": part.column(1),
                                           "v": part.column(2), "codes": packed})

    hashed = classes.select("cls", "copies", "v").mapInArrow(
        emit, "tab int, dim int, code int, cls string, copies long, v array<double>, codes binary")
    key = ["tab", "dim", "code"]
    sizes = hashed.groupBy(*key).count().withColumn("blocks", F.ceil(F.col("count") / F.lit(block)).cast("int"))
    sizes = store(sizes.filter("count > 1").drop("count"), "buckets")
    # Row i of a bucket of k blocks goes to the pairs of blocks (j, other) that hold its own block j.
    placed = (hashed.join(sizes, key).withColumn("j", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
              .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("b0", F.least("j", "o")).withColumn("b1", F.greatest("j", "o")).drop("blocks", "o"))

    def compare(t: pa.Table) -> pa.Table:
        """One pair of blocks: of bounded size."""
        b0, b1, tab = t.column("b0")[0].as_py(), t.column("b1")[0].as_py(), t.column("tab")[0].as_py()
        dim = t.column("dim")[0].as_py()
        x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        scale = np.abs(x).max(axis=1)               # keeps squares of very small or large components in range
        x = x / scale[:, None]
        x = x / np.sqrt((x * x).sum(axis=1))[:, None]
        codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.int32).reshape(-1, tables)
        cls, copies = t.column("cls").to_pylist(), t.column("copies").to_numpy()
        j = t.column("j").to_numpy()
        first, second = np.flatnonzero(j == b0), np.flatnonzero(j == b1)
        counts = np.zeros(len(cls), np.int64)
        root = np.arange(len(cls))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        edges = []
        for a in range(0, len(first), 512):
            at = first[a:a + 512]
            hit = x[at] @ x[second].T >= threshold
            if b0 == b1:
                hit &= at[:, None] < second[None, :]
            p, q = np.nonzero(hit)
            p, q = at[p], second[q]
            if tab and len(p):
                new = ~(codes[p, :tab] == codes[q, :tab]).any(axis=1)
                p, q = p[new], q[new]
            np.add.at(counts, p, copies[q])
            np.add.at(counts, q, copies[p])
            for u, w in zip(p.tolist(), q.tolist()):
                ru, rw = find(u), find(w)
                if ru != rw:
                    root[ru] = rw
                    edges.append((u, w))
        some = np.flatnonzero(counts)
        return pa.Table.from_pydict({
            "a": [cls[i] for i in some] + [cls[u] for u, _ in edges], "b": [None] * len(some) + [cls[w] for _, w in edges],
            "n": counts[some].tolist() + [None] * len(edges)}, pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())]))

    found = placed.groupBy("tab", "dim", "code", "b0", "b1").applyInArrow(compare, "a string, b string, n long")
    found = store(found, "found")
    counts = found.filter("n is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    comp = connected_components(found.filter("b is not null").select("a", "b")).select(F.col("id").alias("cls"), "root")
    own = (classes.select("cls", "copies", "low").join(counts, "cls", "left").join(comp, "cls", "left")
           .select("cls", "low", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root")))
    own = store(own, "own")
    low = store(own.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    own = own.join(small(low), "root").select("cls", "n_links", "component_id")
    out = rows.select("vec_id", "cls").join(own, "cls", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                     F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
                     WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id),
k AS (SELECT id, min(c) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, k.component_id, e.vec_id = k.component_id AS kept
FROM embeddings e JOIN k ON k.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
