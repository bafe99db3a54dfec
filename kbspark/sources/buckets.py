"""A stored table whose writes rewrite only the partitions they touch (W1, W5, R3, F2 in place).

    <root>/_log/00000003                                   the commit log (``sources.log``)
    <root>/data/v=<unique>/bucket=17/created_date=2024-01-05/part-....parquet

Rows lie in buckets by a hash of their key (or by a column, as an index does by cell) and, within a bucket, by creation
day. A commit writes the new contents of the partitions it touches to a folder of its own and then adds a log
entry that names these partitions and the ones they replace. The current table is, per partition, the
folders of the last entry that replaced it and of those that added to it since. So:

* an upsert reads and writes the buckets of its keys, whatever else the table holds; one of new keys alone only adds
  to their partitions (up to ``MOST_FOLDERS`` each, then the buckets are written anew);
* retention drops whole expired days by a log entry and rewrites just the boundary day;
* a lookup of some keys reads only their buckets, files sorted by key and with a Bloom filter on it;
* a write never touches what is being read, and what a crashed write left behind is never read;
* several writers may commit at once: log entries are created atomically, and the writer that comes second
  plans its commit again on the new state; a replayed batch (same key) is a no-op.

The surrogate ids go on from the log (``high``), so no commit scans the table for the largest one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.schema import KB
from kbspark.session import delete_folder, shuffles_deleted
from kbspark.sources.log import VersionLog, new_folder

DAY = "created_date"
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"
#: Folders that a partition may lie in.
MOST_FOLDERS = 16


@dataclass
class State:
    """The table as of a version: the folders of each partition, the batches, the high-water marks."""
    version: int = 0
    parts: dict[tuple[int, str], tuple[str, ...]] = field(default_factory=dict)
    keys: set[str] = field(default_factory=set)
    high: dict[str, int] = field(default_factory=dict)


class BucketStore:
    """``key`` is the column that names a row; ``bucket_by`` a column that holds the bucket itself
    (default: a hash of the key over ``n_buckets``, fixed for a store)."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType = KB, key: str = "doc_id",
                 n_buckets: int = 64, bucket_by: str | None = None, dated: bool = True):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key
        self.n_buckets, self.bucket_by, self.dated = n_buckets, bucket_by, dated
        self.columns = [f.name for f in schema.fields]
        self.log = VersionLog(spark, self.root)
        entries = self.log.entries()
        if entries and entries[0].get("n_buckets") != n_buckets:
            raise ValueError(f"the store has {entries[0].get('n_buckets')} buckets")

    # -- state ------------------------------------------------------------------
    def state(self) -> State:
        s = State()
        for e in self.log.entries():
            gone = e["drop"]
            if gone == "all":
                s.parts.clear()
            elif "before" in gone:                 # days up to the boundary day; what is left of that day is written again
                s.parts = {p: d for p, d in s.parts.items() if p[1] == _NO_DAY or p[1] > gone["before"]}
            else:
                touched = set(gone["buckets"])
                s.parts = {p: d for p, d in s.parts.items() if p[0] not in touched}
            s.parts.update({(b, day): (*s.parts.get((b, day), ()), e["data"]) for b, day in e["parts"]})
            s.version = e["version"]
            s.keys.add(e["key"])
            s.high.update({k: max(v, s.high.get(k, v)) for k, v in e["high"].items()})
        return s

    def versions(self) -> list[tuple[int, str | None]]:
        return [(e["version"], e["key"]) for e in self.log.entries()]

    def has_batch(self, batch_id) -> bool:
        return any(e["key"] == str(batch_id) for e in self.log.entries())

    def bucket(self) -> Column:
        if self.bucket_by:
            return F.col(self.bucket_by).cast("int")
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.n_buckets)).cast("int")

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets of some rows: at most as many numbers as the store has buckets."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    # -- read -------------------------------------------------------------------
    def _path(self, data: str, part: tuple[int, str] | None = None) -> str:
        folder = f"{self.root}/data/{data}"
        return folder if part is None else f"{folder}/bucket={part[0]}" + (f"/{DAY}={part[1]}" if self.dated else "")

    def _scan(self, parts: dict[tuple[int, str], tuple[str, ...]]) -> DataFrame:
        fields = [*[T.StructField(f.name, f.dataType) for f in self.schema.fields if f.name != self.bucket_by],
                  T.StructField("v", T.StringType()), T.StructField("bucket", T.IntegerType())]
        schema = T.StructType(fields + [T.StructField(DAY, T.DateType())] * self.dated)
        if not parts:
            df = self.spark.createDataFrame([], schema)
        else:
            df = self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*sorted(self._path(d, p) for p, folders in parts.items() for d in folders))
        return df.withColumn(self.bucket_by, F.col("bucket").cast(self.schema[self.bucket_by].dataType)) if self.bucket_by else df

    def read(self, buckets: list[int] | None = None, state: State | None = None, with_day: bool = False) -> DataFrame:
        """The current rows (of some buckets). ``with_day`` adds the partition columns ``bucket``
        and, in a dated store, ``created_date``, by which filters prune partitions."""
        s = state or self.state()
        wanted = None if buckets is None else set(buckets)
        df = self._scan({p: d for p, d in s.parts.items() if wanted is None or p[0] in wanted})
        return df.select(*self.columns, *(["bucket"] + [DAY] * self.dated if with_day else []))

    def lookup(self, ids: DataFrame, key: str = "doc_id") -> DataFrame:
        """the rows of the given keys, as ``get_documents``; only their buckets are read."""
        from kbspark.operators.store import get_documents
        return get_documents(self.read(self.buckets_of(ids.select(F.col(key).alias(self.key)))), ids, key)

    # -- write ------------------------------------------------------------------
    def _high(self, rows: DataFrame) -> dict[str, int]:
        """High-water marks of new rows: the largest id, the latest time stamp in the ids."""
        if self.schema != KB:
            return {}
        from kbspark.operators.store import latest_nanos
        r = rows.agg(F.max("id").alias("id"), latest_nanos().alias("nanos")).first()
        return {k: int(r[k]) for k in ("id", "nanos") if r[k] is not None}

    def _write(self, df: DataFrame) -> tuple[str, list[tuple[int, str]]]:
        data = new_folder()
        out = df.select(*[c for c in self.columns if c != self.bucket_by], self.bucket().alias("bucket"),
                        *([F.to_date("created_at").alias(DAY)] if self.dated else []))
        by = ["bucket"] + [DAY] * self.dated
        # Few files per partition, split by size; sorted by key and with a Bloom filter, so that a lookup skips row groups.
        with shuffles_deleted(df.sparkSession):
            (out.hint("rebalance", *by).sortWithinPartitions(*by, self.key).write.partitionBy(*by).option("compression", "zstd")
             .option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(self._path(data)))
        pattern = self.log._Path(f"{self._path(data)}/bucket=*" + f"/{DAY}=*" * self.dated)
        found = []
        for st in self.log.fs.globStatus(pattern) or []:
            p = st.getPath()
            names = (p.getParent().getName(), p.getName()) if self.dated else (p.getName(), f"{DAY}={_NO_DAY}")
            found.append((int(names[0].split("=", 1)[1]), names[1].split("=", 1)[1]))
        return data, sorted(found)

    def update(self, plan: Callable[[State], tuple[DataFrame | None, object]], batch_id=None) -> bool:
        """Commit ``plan(state)`` = (new rows or None, what they replace: "all", {"buckets": [..]} or
        {"before": day}); planned again for as long as other writers come first. False (and no
        write) if ``batch_id`` is committed already."""
        while True:
            s = self.state()
            if batch_id is not None and str(batch_id) in s.keys:
                return False
            rows, drop = plan(s)
            data, parts = self._write(rows) if rows is not None else (None, [])
            high = self._high(self._scan({p: (data,) for p in parts})) if parts else {}
            if self.log.claim(s.version + 1, {"key": None if batch_id is None else str(batch_id), "data": data, "parts": parts,
                                              "drop": drop, "high": high, "n_buckets": self.n_buckets}):
                return True
            if data is not None:
                delete_folder(self.spark, self._path(data))

    def replace(self, rows: DataFrame, batch_id=None) -> bool:
        """The whole table anew."""
        return self.update(lambda s: (rows, "all"), batch_id)

    def upsert(self, batch, now: Column | None = None, batch_id=None, dim: int | None = None) -> bool:
        """W1 in place: only the buckets of the batch's keys are read and rewritten.

        ``batch`` is a DataFrame (doc_id, content, embedding, seq) or, if its ids go on from the
        table, a function of the latest time stamp in the table's ids (None if there is none),
        which is called again if another writer comes first."""
        from kbspark.operators.store import latest_rows, merge_documents, new_documents
        if batch_id is not None and self.has_batch(batch_id):
            return False
        ready: list = [None, None, None]           # time stamp, rows, buckets

        def plan(s: State):
            past = s.high.get("nanos")
            if ready[1] is None or callable(batch) and ready[0] != past:
                rows = latest_rows(batch(past) if callable(batch) else batch, dim=dim)
                ready[:] = past, rows, self.buckets_of(rows)
            _, rows, touched = ready
            if not touched:
                return None, {"buckets": []}
            start = s.high.get("id", 0) + 1
            if self._only_new(rows, touched, s):
                return new_documents(rows, now, start), {"buckets": []}
            return merge_documents(self.read(touched, s), rows, now, start=start), {"buckets": touched}
        return self.update(plan, batch_id)

    def _only_new(self, rows: DataFrame, touched: list[int], s: State) -> bool:
        """Whether none of the keys of ``rows`` is in the table and its partitions take another folder."""
        wanted = set(touched)
        folders = [d for p, d in s.parts.items() if p[0] in wanted]
        if any(len(d) >= MOST_FOLDERS for d in folders):
            return False
        if not folders:
            return True
        with shuffles_deleted(rows.sparkSession):
            return rows.select(self.key).join(self.read(touched, s).select(self.key), self.key, "left_semi").isEmpty()

    def retain(self, now: Column, days: int, batch_id=None) -> int:
        """W5 in place: expired days go by a log entry, the boundary day is rewritten; the number of
        deleted rows (0 for a batch that is committed already)."""
        from kbspark.operators.store import retention_predicate, retention_survivors
        boundary = now - F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days))
        day = str(self.spark.range(1).select(F.to_date(boundary)).first()[0])
        deleted = 0

        def plan(s: State):
            nonlocal deleted
            old = {p: d for p, d in s.parts.items() if p[1] != _NO_DAY and p[1] < day}
            edge = {p: d for p, d in s.parts.items() if p[1] == day}
            deleted = (self._scan(old).count() if old else 0)        # row counts from the footers
            rows = self._scan(edge).select(*self.columns)
            deleted += rows.filter(retention_predicate(F.col("created_at"), now, days)).count()
            return (retention_survivors(rows, now, days) if edge else None), {"before": day}
        return deleted if self.update(plan, batch_id) else 0
