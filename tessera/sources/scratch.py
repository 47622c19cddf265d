"""Tables written between two steps, in the folder that the cluster shares.

``spark.checkpoint.dir`` names that folder; a folder of our own is made only
where the setting is absent in local mode (tests, notebooks), where one machine
runs everything.  On a cluster its absence is an error.  A written table cuts the
lineage and survives the loss of any executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
    return _own[0]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a path, whichever file system holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            discard(spark, path)
        except Exception:  # the session has ended before the program: nothing is left to ask
            return
