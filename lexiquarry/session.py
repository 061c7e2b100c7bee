"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()

#: Rows and bytes of a batch that goes to Python: documents may be long, and each task holds a few.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def bound_batches(spark: SparkSession) -> None:
    """Bounds the batches that go to Python, unless the session has settings of its own for that."""
    for key, value in BATCHES.items():
        if spark.conf.get(key) == default(spark, key):
            spark.conf.set(key, value)


def default(spark: SparkSession, key: str) -> str:
    """What Spark takes where nobody has set the key."""
    entry = spark._jvm.org.apache.spark.sql.internal.SQLConf().getConfString(key)
    return str(entry)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, for the functions that run there in Python."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "lexiquarry.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(target)
