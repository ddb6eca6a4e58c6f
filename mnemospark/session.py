"""Session factory and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "mnemospark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for; a cluster's own settings win.

    Adaptive execution re-plans joins and splits skewed partitions at run time; UTC keeps
    text times without a zone and timestamps comparable on every machine.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that all executors share, deleted when the driver ends.

    It lies under ``spark.checkpoint.dir``. Only a local session may leave that unset; then a
    machine-local folder is chosen and set, so that ``checkpoint()`` uses it too. On a
    cluster a missing setting is an error, for executors would write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(root)
    folder = f"{root.rstrip('/')}/mnemospark-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def materialized(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: what follows reads them and does not repeat
    the work, and a lost executor takes nothing with it. What was shuffled to make them is of
    no more use; the driver's garbage is collected so that Spark deletes those files now."""
    path = f"{shared_dir(df.sparkSession)}/rows"
    df.write.parquet(path, compression="zstd")
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable for the Python workers of the session's application.

    The driver packs its own copy and hands it to Spark, which serves it to the executors;
    they need no installation and no common path. Done once per application.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)
