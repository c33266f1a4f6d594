"""Session, table loading and lineage helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import pathlib
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "quillspark", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects; on a cluster use the cluster's own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUILL_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, so that functions running on executors can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="quill-ship-")) / "quillspark.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Read one table of a data directory; Catalyst prunes columns and pushes filters into the scan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a table comes in fewer scan partitions than there are cores.

    Only inputs below one scan partition a core are shuffled, so what moves is bounded; larger tables stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_OWN_DIRS: dict[str, str] = {}
_TABLES: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Where it is unset a local session gets a folder of its own; any other master is refused, since its executors would
    write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIRS:
            _OWN_DIRS[app] = tempfile.mkdtemp(prefix="quill-")
        found = _OWN_DIRS[app]
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing a table into the shared folder and reading it back.

    The written files are Parquet on storage every executor sees, so a lost executor costs only its running tasks. They
    stay as long as the driver lives, since a result may still read them; release() or its end deletes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _TABLES:
        atexit.register(release)
    _TABLES.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete the tables that materialise() wrote; results that still read them must be complete."""
    while _TABLES:
        spark, path = _TABLES.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is gone: its own local folder can still be emptied
            shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)
    for folder in _OWN_DIRS.values():
        shutil.rmtree(folder, ignore_errors=True)
    _OWN_DIRS.clear()


def table_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan in bytes; used to decide whether a side may be broadcast."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_if_small(df: DataFrame, limit: int = 8 << 20, like: DataFrame | None = None) -> DataFrame:
    """Mark a side for broadcast only when its estimated size is known to be under the limit; otherwise leave it to a shuffle join.

    like: a table that bounds df, where df has at most one row for each of its rows and Catalyst cannot see that.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if table_bytes(df if like is None else like) <= limit else df
