"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local_scratch: str | None = None
#: Paths given out by ``scratch_path``, by application.
_given: dict[str, list[str]] = {}


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    ``master`` is left to spark-submit unless given.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables, visible to every executor.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, whose
    executors share one machine, may fall back to a temporary folder.
    """
    global _local_scratch
    set_by_code = spark.sparkContext.getCheckpointDir()
    if set_by_code is not None:
        return set_by_code
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        if _local_scratch is None:
            _local_scratch = tempfile.mkdtemp(prefix="topicloom-")
        folder = _local_scratch
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; never reused between runs."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _given.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables of this session, and tell how many there were.

    Results are read from some of them, so they must have been written or collected.
    """
    removed = 0
    for path in _given.pop(spark.sparkContext.applicationId, []):
        here = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        removed += bool(files.delete(here, True))
    return removed
