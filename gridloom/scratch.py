"""Tables that are computed once and read more than once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: File system and path of each, as they can be deleted after the session has stopped.
_written: list[tuple] = []


def _folder(spark: SparkSession) -> str | None:
    """The folder in spark.checkpoint.dir, which all executors share; where it is unset and Spark runs in one process,
    a temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not (sc.master == "local" or sc.master.startswith("local[")):
                return None
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="scratch-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found


def saved(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Writes df to the shared scratch folder and reads it back, so that it is computed once however often it is used.
    Scratch tables go when the driver ends. On a cluster without such a folder df comes back as it is, and each use
    computes it again."""
    spark = df.sparkSession
    folder = _folder(spark)
    if folder is None:
        return df
    path = f"{folder}/scratch-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    if not _written:
        atexit.register(_drop)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _written.append((at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at))
    return spark.read.schema(df.schema).parquet(path)


def _drop() -> None:
    for system, path in _written:
        try:
            system.delete(path, True)
        except Exception:  # noqa: BLE001  the JVM may be gone already; the folder is scratch space
            return
