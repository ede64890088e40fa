"""Session defaults and lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "datasheaf", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE with skew handling)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; one of our own only where none is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="datasheaf-checkpoint-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


_work_roots: dict[str, str] = {}


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the folder that driver and executors share.

    Each application has one folder there for all its intermediate tables, removed when Python ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _work_roots:
        _work_roots[app] = root = f"{checkpoint_dir(spark).rstrip('/')}/datasheaf-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root)
    return f"{_work_roots[app]}/{name}-{uuid.uuid4().hex}"


def _remove(jvm, conf, folder: str) -> None:
    """Best effort: at the end of Python the JVM may be gone already."""
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    except Exception:  # noqa: BLE001
        pass


# Spark's setting to delete the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside are deleted with their end, and not when the driver happens to
    collect its garbage. For queries whose plan is not run again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """`df` as a table in the shared folder: computed once, read by column, safe when executors are lost."""
    folder = work_folder(df.sparkSession, name)
    with cleaned(df.sparkSession):
        df.write.parquet(folder, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so an iteration survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores when the input has fewer splits than cores.

    For CPU-heavy row work on a few small files. Inputs of a real size have more splits than the
    cluster has cores, and are left as they are: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
