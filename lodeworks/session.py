"""Session factory and the few runtime rules every operator shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lodeworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session pinned to UTC with adaptive execution; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory in which lineage is cut.

    A cluster names a shared folder in ``spark.checkpoint.dir``; only where that is unset
    (tests, a laptop) a private local folder is made.
    """
    context = spark.sparkContext
    present = context.getCheckpointDir()
    if present:
        return present
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="lodeworks-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table written to the shared checkpoint folder.

    They survive the loss of any executor, and the next plan starts from a scan with true
    sizes. (A plan that starts from ``checkpoint()`` inherits estimates; in iterations that
    join a result with itself these square every round until planning takes minutes.)
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lodeworks-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._lodeworks_path = path
    return written


def discard(*frames: DataFrame) -> None:
    """Delete tables written by ``cut_lineage`` that no later plan reads."""
    for frame in frames:
        path = getattr(frame, "_lodeworks_path", None)
        if path:
            context = frame.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per context, wherever they run."""
    import io
    import zipfile

    context = spark.sparkContext
    if getattr(context, "_lodeworks_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder_of_package = tempfile.mkdtemp(prefix="lodeworks-ship-")
    atexit.register(shutil.rmtree, folder_of_package, ignore_errors=True)
    packed = os.path.join(folder_of_package, "lodeworks.zip")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("lodeworks", os.path.relpath(full, here)))
    with open(packed, "wb") as target:
        target.write(buffer.getvalue())
    context.addPyFile(packed)
    context._lodeworks_shipped = True
