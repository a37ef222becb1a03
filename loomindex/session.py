"""Session building and the shared folder that long jobs cut their lineage with."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folders: list[str] = []
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "loomindex", cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter's session is used as it is."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, bench) gets a folder of its own; a cluster
    session without it is an error, because a machine-local folder would not be seen by executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folders:
        _own_folders.append(tempfile.mkdtemp(prefix="spark-loomindex-"))
    return f"file://{_own_folders[0]}"


def materialize(df: DataFrame, label: str, tidy: bool = False, **options: str | int) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back. ``options``: of the writer.

    Cuts the lineage for plans that use an expensive frame several times. A lost executor costs
    nothing, since the files are in shared storage. The table is removed when the driver ends. With
    ``tidy`` the shuffle files of the write are removed after it, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomindex/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true" if tidy else before)
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    _remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove a table of ``materialize`` that nothing reads any more."""
    jvm, files = getattr(table.sparkSession, "_jvm", None), table.inputFiles()
    if jvm is not None and files:
        place = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def _remove_at_end(spark: SparkSession, path: str) -> None:
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:  # a remote session has none; its folder is cleaned by whoever owns it
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


@atexit.register
def _clear_own_folders() -> None:
    for folder in _own_folders:
        if os.path.isdir(folder):
            shutil.rmtree(folder, ignore_errors=True)
