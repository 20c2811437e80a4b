"""Where a session keeps what outlives a job: the shared folder and tables written into it."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a local session gets one of its own; a cluster has to name it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="synthframe-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df into the shared folder and read it back: later jobs start from the files, also after executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the job's shuffle files go when it ends, not when the driver collects garbage
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found._cut_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Remove tables that `cut` has written and that nothing reads any more. Other frames are left alone."""
    for df in tables:
        if path := getattr(df, "_cut_path", None):
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Hand this package's source to the executors, once a context, so that Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_synthframe_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="synthframe-")) / "synthframe_source.zip"  # the driver serves it from there
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(target))
    sc._synthframe_shipped = True
