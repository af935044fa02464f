"""Where jobs put the tables they write on the way (ledgers, deltas, stream checkpoints)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


@lru_cache(maxsize=1)
def _local_root() -> str:
    """One temporary folder for this process, removed at its end."""
    root = tempfile.mkdtemp(prefix="quayline-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    When the setting is missing, a temporary folder serves local masters only; on a cluster a
    machine-local folder would lose data with its executor, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_root()


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that a job has written and no longer needs."""
    files, where = _at(spark, path)
    files.delete(where, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path``, none if it does not exist."""
    files, where = _at(spark, path)
    if not files.exists(where):
        return []
    return sorted(f.getPath().getName() for f in files.listStatus(where) if f.isDirectory())


def is_folder(spark: SparkSession, path: str) -> bool:
    files, where = _at(spark, path)
    return files.exists(where) and files.getFileStatus(where).isDirectory()


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files below a folder; 0 if it does not exist."""
    files, where = _at(spark, path)
    return files.getContentSummary(where).getLength() if files.exists(where) else 0
