"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app_name: str = "tallyframe", master: str | None = None, **settings) -> SparkSession:
    """A session with the settings the operators are written for.

    Partition counts are left to adaptive execution: it merges small shuffle
    partitions and splits the skewed sides of joins on the measured sizes.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for name, value in {**defaults, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


#: Folders of local sessions that name none, by application.
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of its own, which goes when this process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
    if context.applicationId not in _own_folders:
        folder = tempfile.mkdtemp(prefix="tallyframe-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_folders[context.applicationId] = folder
    return _own_folders[context.applicationId]


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nobody else uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def ready_for_checkpoints(spark: SparkSession) -> None:
    """Give the context a checkpoint folder when it has none yet."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


#: Applications whose workers have this package.
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application: they may have no copy of their own."""
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    if context.applicationId in _shipped or not package.is_dir():
        return
    _shipped.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="tallyframe-")  # the driver's; Spark hands the file out from there
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/{package.name}.zip", "w") as file:
        for module in sorted(package.rglob("*.py")):
            file.write(module, module.relative_to(package.parent))
    context.addPyFile(f"{folder}/{package.name}.zip")
