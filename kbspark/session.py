"""Session helpers: UTC, AQE, ANSI, Arrow, and the shared scratch folder.

On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS, S3, ...);
we read it from the session and only fall back to a fresh local temp folder
when it is unset (local tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

_DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Sizing: AQE coalesces shuffle output to ~128 MB partitions; scans split at 256 MB;
    # Arrow batches of 4096 rows bound the scorer's (rows x 512 queries) float64 block
    # to 16 MB and the embedder's count matrix at 1536 dims to 48 MB.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "kbspark", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    # Session-level settings apply even when getOrCreate returned an existing session.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``kbspark`` importable in Python workers (UDFs pickle by module reference):
    zip the package once per SparkContext and ``addPyFile`` it, as ``--py-files`` would."""
    sc = spark.sparkContext
    if getattr(sc, "_kbspark_shipped", False):
        return
    # On a cluster that installs the package on executors (or passes it with --py-files),
    # set spark.kbspark.shipPackage=false.
    if sc.getConf().get("spark.kbspark.shipPackage", "true").lower() == "false":
        sc._kbspark_shipped = True
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="kbspark-pkg-"), "kbspark.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    sc._kbspark_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a local one only if unset, in local mode."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="kbspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_dir(spark: SparkSession, name: str = "tmp") -> str:
    """A fresh sub-folder of the shared checkpoint folder (never machine-local on a cluster)."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    made = _SCOPE.get()
    if made is not None:
        made.append(path)
    return path


#: The scratch folders of the innermost ``scratch_scope`` of this thread.
_SCOPE: ContextVar[list[str] | None] = ContextVar("kbspark_scratch", default=None)


@contextmanager
def scratch_scope(spark: SparkSession):
    """The scratch folders made within (by this thread) are deleted at the end: for work whose results are
    committed elsewhere by then."""
    made: list[str] = []
    before = _SCOPE.set(made)
    try:
        yield
    finally:
        _SCOPE.reset(before)
        for path in made:
            delete_folder(spark, path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning: dict[int, list] = {}                    # session -> [users, value before]
_lock = Lock()


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """The shuffle files of a query that runs within are deleted as soon as it ends, not when the driver happens to
    collect its garbage. For queries that run once, such as writes."""
    session = spark._jsparkSession.hashCode()
    with _lock:
        users = _cleaning.setdefault(session, [0, spark.conf.get(_CLEANUP, None)])
        users[0] += 1
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            users[0] -= 1
            if not users[0]:
                del _cleaning[session]
                spark.conf.unset(_CLEANUP) if users[1] is None else spark.conf.set(_CLEANUP, users[1])


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written once to ``path`` (a scratch folder) and read from there; its shuffle files are deleted."""
    with shuffles_deleted(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete one of our own scratch folders, on whatever file system it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
