"""Session factory and shipping of this package to the executors."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("quernel")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once for each Spark context.

    Workers import the functions by name, so they find the package wherever the driver was started.
    """
    context = spark.sparkContext
    if getattr(context, "_quernel_shipped", False):
        return spark
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for path in sorted(ROOT.rglob("*.py")):
            archive.write(path, path.relative_to(ROOT.parent).as_posix())
    folder = tempfile.mkdtemp(prefix="quernel-")
    target = os.path.join(folder, "quernel_package.zip")
    Path(target).write_bytes(buffer.getvalue())
    context.addPyFile(target)
    context._quernel_shipped = True
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all machines see: ``spark.checkpoint.dir``, or a temporary one on one machine alone."""
    key = "spark.checkpoint.dir"
    where = spark.sparkContext.getConf().get(key) or spark.conf.get(key, None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise RuntimeError(f"set {key} to a folder that all machines see")
        where = "file://" + tempfile.mkdtemp(prefix="quernel-shared-")
        spark.conf.set(key, where)
    return f"{where.rstrip('/')}/quernel/{name}-{uuid.uuid4().hex}"
