"""Session factory and the lineage cut that survives the loss of executors."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "seamline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans here assume. On a cluster pass no master."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


_OWN: list[str] = []
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where set; else, in local mode only, a temporary one."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="seamline-shared-"))
        atexit.register(shutil.rmtree, _OWN[0].removeprefix("file://"), ignore_errors=True)
    return _OWN[0]


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, compressed
    on disk, and no executor's loss can take it away. The table lives until release(), or the end of
    the block of tables() it was written in."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables that cut() has written, from number `since` on; returns how many there were. What still reads them must be done."""
    gone = _WRITTEN[since:]
    del _WRITTEN[since:]
    for p in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


@contextlib.contextmanager
def tables(spark: SparkSession) -> Iterator[None]:
    """with tables(spark): run a query and write its result; the tables it cut are deleted at the end of the block, whatever happens."""
    since = len(_WRITTEN)
    try:
        yield
    finally:
        release(spark, since)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, dealt out before row-wise Python work; any other scan as it is.
    For scans only: their splits are known without running anything."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
