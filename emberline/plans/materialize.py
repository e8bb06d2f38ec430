"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs in this process.

    On a cluster each machine has a temporary folder of its own, and what one
    writes there no other can read: without the setting that is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir is unset: on {master} it must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="emberline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session is over; the folder's owner cleans it
            return


atexit.register(_clean)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and return it as a scan.

    Unlike a cached table this outlives executors, and unlike a checkpoint it
    is columnar, compressed and can be pruned and filtered.  The tables are
    deleted when the driver ends, or by ``release`` once nothing reads them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(schema).parquet(path)
    out._emberline_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table behind what ``materialize`` returned; nothing may read it any more."""
    path = getattr(df, "_emberline_path", None)
    if path in _written:
        _delete(_written.pop(path), path)
