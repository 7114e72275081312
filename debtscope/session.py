"""Session helpers: a local builder for tests and bench, and the shared folder."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(app: str = "debtscope", cores: str | int = "*", partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """Session for tests and the bench.  Clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _own_folder() -> str:
    """One folder of this machine for a local process, removed when it ends."""
    folder = tempfile.mkdtemp(prefix="debtscope-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def qualified(spark: SparkSession, folder: str) -> str:
    """A path with its scheme, as the cluster's default file system has it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` under the folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session that
    leaves the setting out gets a temporary folder of this machine.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        root = _own_folder()
    return os.path.join(root.rstrip("/"), f"{name}-{uuid.uuid4().hex}")
