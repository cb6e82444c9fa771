"""Session helpers: building a session for tests, tables cut off from their lineage in the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "siltstone") -> SparkSession:
    """A local session for tests and the bench. On a cluster the caller's session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("SILTSTONE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", os.environ.get("SILTSTONE_SHARED_FOLDER", "/tmp/siltstone-shared"))
        .getOrCreate()
    )


_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This run's own folder below the one the cluster names in spark.checkpoint.dir (or by setCheckpointDir). It is
    removed when the driver ends. A session that names none is refused: a folder of the driver alone would not do."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        named = spark.conf.get("spark.checkpoint.dir", None)
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = named or (held.get() if held.isDefined() else None)
        if not base:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _folders[app] = f"{base.rstrip('/')}/siltstone-{uuid.uuid4().hex}"
        atexit.register(remove, spark, _folders[app])
    return _folders[app]


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder that the session can reach."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: nothing can be removed through it any more
        pass


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage, statistics and constraints start anew, and the
    loss of an executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held._held_at = path
    return held


def cut_counting(df: DataFrame, **counts) -> tuple[DataFrame, dict[str, int]]:
    """cut(df), and sums of the given columns over it, taken in the same job."""
    seen = Observation()
    held = cut(df.observe(seen, *[F.sum(c.cast("long")).alias(k) for k, c in counts.items()]))
    return held, {k: v or 0 for k, v in seen.get.items()}


def cut_in_parts(parts: Iterable[DataFrame]) -> DataFrame:
    """The rows of all parts (at least one) as cut would hold them. Each part is written before the next begins, and the
    shuffle files it needed go, so the disk holds those of one part only."""
    path = None
    for df in parts:
        if path is None:
            spark, schema = df.sparkSession, df.schema
            path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        df.write.mode("append").parquet(path)
        del df  # what is held here isn't garbage
        release(spark)
    held = spark.read.schema(schema).parquet(path)
    held._held_at = path
    return held


def release(spark: SparkSession) -> None:
    """Shuffle files and broadcasts of plans that nobody holds stay until the driver happens to collect its garbage;
    this has it do so now."""
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Remove a table made by cut that no later plan reads."""
    if path := getattr(df, "_held_at", None):
        remove(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
