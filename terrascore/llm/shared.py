"""Folders that driver and executors share, and the cutting of lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()
#: Rows and bytes of an Arrow batch.
MOST_ROWS, MOST_BYTES = 2000, 4_000_000
#: Spark's setting for it.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors of the application, once, so that tasks can import them."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        to = Path(tempfile.mkdtemp(prefix="modules-")) / f"{package.name}-modules.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(to))
        _SHIPPED.add(app)
    bound_batches(spark)


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python stages by bytes, so that rows of long texts make small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", MOST_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", MOST_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one is set in local mode; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = have.get() if have.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: lost executors don't lose it, and later plans start from it."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions within go when the action ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again; columns can be pruned at later reads, unlike after cut().
    What df shuffled for it is freed."""
    path = new_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table that stored() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    folder = shared_folder(spark).rstrip("/")
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.toString().replace("file:///", "file:/").startswith(folder.replace("file:///", "file:/") + "/"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            return
