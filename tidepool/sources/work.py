"""Tables written once to the shared work folder, and read from there."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset on one machine a folder of this run."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidepool-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{folder(spark)}/tidepool/{label}-{uuid.uuid4().hex}"


_KEPT: list[tuple[SparkSession, str]] = []


@atexit.register
def drop_all() -> None:
    """Deletes what was kept at the driver's end, if its session still runs: until then results may read it."""
    for spark, path in _KEPT:
        if SparkContext._active_spark_context is spark.sparkContext and spark.sparkContext._jsc is not None:
            fs, at = hadoop(spark, path)
            fs.delete(at, True)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run meanwhile go as soon as it ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept(df: DataFrame, label: str) -> DataFrame:
    """The table, computed now and read from files from here on: later failures cost a re-read, and plans stay short."""
    path = new_path(df.sparkSession, label)
    _KEPT.append((df.sparkSession, path))
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path, of the JVM."""
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), made


def stamp(df: DataFrame) -> str:
    """What tells whether a table's files have changed: their names, and the sizes and times of up to 100 files, or of the
    folders of more (Spark gives new files new names)."""
    names = sorted(df.inputFiles())
    out = list(names)
    for name in names if len(names) <= 100 else sorted({n.rsplit("/", 1)[0] for n in names}):
        fs, path = hadoop(df.sparkSession, name)
        status = fs.getFileStatus(path)
        out.append(f"{status.getLen()}:{status.getModificationTime()}")
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


def exists(df: DataFrame) -> bool:
    """Whether a written table's files are still there."""
    names = df.inputFiles()
    if not names:
        return False
    fs, path = hadoop(df.sparkSession, names[0])
    return fs.exists(path)
