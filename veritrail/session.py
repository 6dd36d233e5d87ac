"""Session helpers: building a local session, reading tables, cutting lineage."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "veritrail", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested under.

    On a cluster the session comes from the caller; no operator needs more than the settings
    named here, and none of them sets its own.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("VERITRAIL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, unless they find it by PYTHONPATH or the working folder."""
    context = spark.sparkContext
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if context.applicationId in _shipped or str(_ROOT) in map(os.path.realpath, filter(None, found)):
        return
    _shipped.add(context.applicationId)
    context.addPyFile(shutil.make_archive(tempfile.mkdtemp() + "/veritrail", "zip", _ROOT, "veritrail"))


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``directory``; columns are pruned by what is selected later."""
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all runs in one
    process, as in tests, is a folder of this machine used; a cluster without one is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if not folder and current.isDefined():
        folder = current.get()
    elif not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("a cluster needs a folder that all executors share: set spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="veritrail-")
    if not current.isDefined():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint, which survives the loss of executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
