"""Sessions for local work, and tables kept in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session on this machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a folder of this process on a local master, else an error.

    A folder of one machine would be another one to each executor, and what is read back only a part.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir has to name a folder that all executors of {master} share")
    folder = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: What this process has written and not yet deleted.
_STEPS: set[str] = set()


def keep(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs no recomputation of what came before and ids that
    were given out once stay as they are.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STEPS.add(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    _STEPS.discard(path)


def release(*kept: DataFrame) -> None:
    """Delete what ``keep`` wrote for these; for steps that nothing reads any more."""
    for df in kept:
        path = getattr(df, "_kept_at", None)
        if path in _STEPS:
            _delete(df.sparkSession, path)


def release_all(spark: SparkSession) -> None:
    """Delete all that ``keep`` wrote in this process, once the results that were made of it are written."""
    for path in list(_STEPS):
        _delete(spark, path)


def tasks(spark: SparkSession) -> int:
    """Partitions for a stage whose cost is by row: as many as shuffles have, and not fewer because its rows are short."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
