"""Spark session with the settings the library is tested under."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quire", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``master`` only outside spark-submit."""
    cores = os.environ.get("BENCH_CPUS", "8")
    b = SparkSession.builder.appName(app)
    if master or "MASTER" not in os.environ:
        b = b.master(master or f"local[{cores}]")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": cores,
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def checkpoint_dir(spark: SparkSession) -> None:
    """Makes sure that checkpoint() has a folder: the cluster's own (spark.checkpoint.dir), else, in local mode only, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="quire-"))


def kept(df: DataFrame) -> DataFrame:
    """The rows as a table written to the checkpoint folder: lineage is cut as by checkpoint(), compressed and by columns, so later steps read what they need."""
    checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors' Python, once a context, so that their workers needn't have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_quire_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quire-")) / "quire.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._quire_shipped = True
