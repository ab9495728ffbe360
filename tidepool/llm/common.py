"""What the operators share: the shared work folder, written tables and Arrow batches of plain rows."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that a Python worker holds as objects at once.
SLICE_ROWS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset on one machine (tests) a folder of this run.

    On a cluster it must be set: what executors write to their own disks others can't read.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidepool-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


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


class Written:
    """A table written once to the shared folder, so that lost executors cost no recomputation of what led to it.

    Whoever needs it no more drops it; those that a result reads go when the driver ends.
    """

    kept: dict[str, Written] = {}

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/tidepool/{label}-{uuid.uuid4().hex}"
        self.kept[self.path] = self
        with shuffles_dropped(self.spark):
            df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        if self.kept.pop(self.path, None) is not None:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def drop_all() -> None:
    """Drops what is left at the driver's end, if its session still runs."""
    for written in list(Written.kept.values()):
        if SparkContext._active_spark_context is written.spark.sparkContext and written.spark.sparkContext._jsc is not None:
            written.drop()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drawn_by_hash(id_col: str, rows: int, wanted: int) -> Column:
    """Whether a row is in a sample of about ``wanted`` of ``rows`` rows, decided by its id alone; all rows if they are no more."""
    if rows <= wanted:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 52)) < int((1 << 52) * wanted / rows)


def any_names(keeps_columns: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions that give back the columns of their first argument: columns may have names that Spark would parse."""

    @functools.wraps(keeps_columns)
    def run(docs: DataFrame, *args, **named) -> DataFrame:
        names = docs.columns
        odd = [i for i, n in enumerate(names) if "." in n or "`" in n]
        if not odd:
            return keeps_columns(docs, *args, **named)
        stem = "_" * (1 + max(map(len, names)))  # longer than any name, so none has it
        plain = [f"{stem}{i}" if i in odd else n for i, n in enumerate(names)]
        return keeps_columns(docs.toDF(*plain), *args, **named).toDF(*names)

    return run


def map_columns(df: DataFrame, schema: str, make: Callable[[], Callable[..., dict]]) -> DataFrame:
    """Runs ``make()`` once a task and the function it gives once for each slice of SLICE_ROWS rows.

    That function takes the columns as lists, by name, and gives the new columns as lists or arrays. Rows of any number
    may come back; nothing outlives a slice but what the function itself keeps.
    """
    names = df.columns
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                got = work(**{n: c.to_pylist() for n, c in zip(names, part.columns, strict=True)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
