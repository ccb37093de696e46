"""Session helpers: a reliable place to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "termweave", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs rely on; cluster defaults win where they are set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a scratch folder only for a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="termweave-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame, path: str | None = None) -> DataFrame:
    """As ``cut``, in Parquet files: for long tables, whose repeated values take little room there. The order of rows holds within a file."""
    path = path or f"{ensure_checkpoint_dir(df.sparkSession)}/termweave-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def keeper(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function like ``keep``, whose tables are deleted in the end."""
    folder, number = f"{ensure_checkpoint_dir(spark)}/termweave-{uuid.uuid4().hex}", count()
    try:
        yield lambda df: keep(df, f"{folder}/{next(number)}")
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


SMALL = 128 << 20  # bytes of text of a table that is sent to all tasks


def is_small(df: DataFrame) -> bool:
    """Whether the measured size of ``df`` allows to send it to all tasks; read once for that."""
    sizes = [F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) + F.lit(16) for c in df.columns]
    return df.agg(F.coalesce(F.sum(sum(sizes[1:], sizes[0]).cast("long")), F.lit(0))).first()[0] <= SMALL


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its measured size allows, so that what it is joined with is not shuffled; read once for that."""
    return F.broadcast(df) if is_small(df) else df


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores on a table of few splits before costly per-row work; a table of many splits is left as it is.

    For plain scans: asking a scan for its splits starts no job.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
