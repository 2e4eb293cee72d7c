"""Sessions, and the package on executors."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once for each application, so that Python functions of it load there."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default, made for narrow rows; texts are long
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(), "foliant_package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(here):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("foliant", os.path.relpath(full, here)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def scratch(spark: SparkSession, root: str | None = None) -> str:
    """A name for a new folder under `root`, else under the cluster's `spark.checkpoint.dir`. A session without that setting gets a folder of this
    machine if it runs on this machine alone, and an error otherwise."""
    root = root or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _local_folder()
    return f"{root.rstrip('/')}/foliant-{uuid.uuid4().hex}"


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="foliant-")


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: lineage and plan end there, and a lost executor costs no recomputation of it.

    A table that was written stays until the folder is emptied, since lazily returned results still read it.
    """
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
