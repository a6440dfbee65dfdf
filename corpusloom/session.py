"""Session helpers: building a session, the shared checkpoint folder and scratch table paths.

The checkpoint folder is whatever the cluster names in ``spark.checkpoint.dir``. Only when that is
unset *and* the master is local (tests, the bench) do we pick a fresh folder under /tmp.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "corpusloom", extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Session with the settings this library is tuned for (AQE, skew join, Arrow, UI off)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra_conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting it from ``spark.checkpoint.dir`` if needed."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-ckpt-", dir="/tmp"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused folder for a written table, inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


class Scope:
    """Owner of written tables. ``with Scope(spark) as owned:`` owns what the same thread (or task of an event loop)
    writes by ``materialize`` inside, unless an inner scope does. At the end all of it is deleted, but for
    what was released to another owner; what other threads write meanwhile is never touched."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[str, str | None]] = []  # folder, catalog table

    def __enter__(self) -> Scope:
        self._outer = _SCOPE.set(self)
        return self

    def __exit__(self, *failure) -> None:
        _SCOPE.reset(self._outer)
        self.drop()

    def release(self) -> tuple[str, str | None]:
        """Hands out the table that was written last: it is the caller's from now on."""
        return self.tables.pop()

    def adopt(self, table: tuple[str, str | None]) -> None:
        self.tables.append(table)

    def drop(self) -> None:
        """Deletes the scope's tables: files and catalog entries."""
        while self.tables:
            path, table = self.tables.pop()
            if table:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


_SCOPE: ContextVar[Scope | None] = ContextVar("corpusloom_scope", default=None)


def _own(path: str, table: str | None) -> None:
    scope = _SCOPE.get()
    if scope is not None:
        scope.adopt((path, table))


#: Name and physical plan of every table written by ``materialize``: what the plan tests look at.
WRITTEN_PLANS: list[tuple[str, str]] = []


#: Of the bucketed tables, which hold the texts. Not of others: Spark sizes what it may broadcast by the bytes of its files.
COMPRESSION = "zstd"


def materialize(df: DataFrame, name: str, bucket_by: str | None = None, buckets: int | None = None, placed: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` and survives executor loss, and unlike a checkpointed
    RDD the stage keeps column pruning, predicate pushdown and file-size statistics for the
    optimizer's broadcast decisions. With ``bucket_by`` the table is hash-bucketed on that column
    (one file per bucket) and registered as an external table, so later joins and aggregations on
    the column read it already partitioned; ``bucket_count`` sizes ``buckets`` from the input. ``placed`` says that
    a task's rows are of few buckets (they were read from a table with the same ones): they are not shuffled again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    WRITTEN_PLANS.append((name, df._jdf.queryExecution().executedPlan().toString()))
    del WRITTEN_PLANS[:-2000]
    if bucket_by is None:
        df.write.mode("error").parquet(path)
        _own(path, None)
        return spark.read.parquet(path)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = "corpusloom_" + path.rstrip("/").rsplit("/", 1)[-1].replace("-", "_")
    ((df if placed else df.repartition(buckets, bucket_by)).write.mode("error").option("path", path)
       .option("compression", COMPRESSION).bucketBy(buckets, bucket_by).sortBy(bucket_by).saveAsTable(table))
    _own(path, table)
    return spark.table(table)


def materialize_observed(df: DataFrame, name: str, metrics: dict[str, Column], bucket_by: str | None = None,
                         buckets: int | None = None) -> tuple[DataFrame, dict[str, object]]:
    """``materialize``, and ``metrics`` (aggregates of the rows) observed by the same job that writes them. Of a
    table that Spark knows to be empty before it runs there is nothing to observe: counts are 0, the rest is null."""
    seen = Observation()
    names = list(metrics)
    written = materialize(df.observe(seen, *[metrics[n].alias(n) for n in names]), name, bucket_by, buckets)
    got = seen.get
    return written, {n: got.get(n) for n in names}


def bucket_count(df: DataFrame, target_mb: int = 256) -> int:
    """Buckets of about ``target_mb`` of input, by the optimizer's size of the tables that ``df`` reads (file
    sizes); at least as many as the session's shuffle partitions, so small inputs still use every core."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    # Spark gives a source of unknown size (such as rows from Python) the session's default, an enormous number
    unknown = int(str(df.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes()))
    known = sum(x for x in sizes if x < unknown)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(least, -(-known // (target_mb << 20))), 100_000)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors' Python workers (once per application), so that they
    need no installation. Only operators that run Python on the executors use them."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="corpusloom-ship-"), "corpusloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(x for x in names if x.endswith(".py")):
                full = os.path.join(folder, n)
                z.write(full, os.path.join("corpusloom", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
