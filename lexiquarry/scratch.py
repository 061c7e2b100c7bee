"""Written tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, which goes when the driver process ends.

    Where that setting is absent, a local session gets a temporary folder; on a cluster executors
    would not see one, so that is an error.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _ROOTS:
        shared = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
        if not shared:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            shared = "file://" + tempfile.mkdtemp(prefix="lexiquarry-")
            context.setCheckpointDir(shared)
        _ROOTS[app] = f"{shared.rstrip('/')}/lexiquarry-{app}"
        atexit.register(_drop, spark, _ROOTS[app])
    return _ROOTS[app]


def _drop(spark: SparkSession, root: str) -> None:
    try:
        remove(spark, root)
    except Exception:  # the session may already be gone
        pass


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage: shuffle files of finished steps stay until then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: computed once, and lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
