"""Session settings and lineage cutting shared by the library."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

SCALE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "cohortloom", **settings: str) -> SparkSession:
    """A session with adaptive execution on; ``settings`` use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SCALE_SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session (one machine) gets a folder of its own where none is set, removed when the driver
    ends; on a cluster an unset folder is an error, because executors could not read each other's data.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
        shared = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    context.setCheckpointDir(shared)
    return shared


_shared: set[str] = set()


def share_code(spark: SparkSession) -> None:
    """Let Python workers find the package: on a cluster it travels as an archive with the job, in a local session by its path."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    if not context.master.startswith("local[") and context.applicationId not in _shared:
        _shared.add(context.applicationId)
        folder = tempfile.mkdtemp(prefix="code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = os.path.join(folder, f"{__package__}.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for place, _, names in os.walk(os.path.join(root, __package__)):
                for name in sorted(n for n in names if n.endswith(".py")):
                    full = os.path.join(place, name)
                    z.write(full, os.path.relpath(full, root))
        context.addPyFile(archive)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
