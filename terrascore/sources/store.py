"""Tables kept by key in a shared folder, so that the same work is done once."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


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
    return folder.rstrip("/")


def fingerprint(df: DataFrame) -> str:
    """A version of what df would give: its plan with the names, lengths and times of the files it reads.

    For tables of very many files a version of the caller's own (see publish()) is cheaper: this looks at each file once."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().analyzed().canonicalized()
    said = [str(plan.semanticHash()), df.schema.json()]
    conf = spark._jsc.hadoopConfiguration()
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        said.append(f"{name}:{status.getLen()}:{status.getModificationTime()}")
    return hashlib.sha256("\n".join(said).encode()).hexdigest()


def key_of(parts: dict) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:32]


@dataclass
class Store:
    """Tables under path/name/key. A table is there whole or not at all: it is written under another name and renamed.

    made and found list the (name, key) of tables that were written and of those that were there already."""

    spark: SparkSession
    path: str
    made: list[tuple[str, str]] = field(default_factory=list)
    found: list[tuple[str, str]] = field(default_factory=list)

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, name: str, key: str) -> bool:
        path, files = self._at(f"{name}/{key}")
        return files.exists(path)

    def read(self, name: str, key: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/{key}")

    def keep(self, name: str, key: str, compute: Callable[[], DataFrame]) -> DataFrame:
        """The table of a key; compute() is called, and its result written, only where there is none."""
        if self.has(name, key):
            self.found.append((name, key))
            return self.read(name, key)
        to, files = self._at(f"{name}/{key}")
        temp, _ = self._at(f"{name}/_{key}-{uuid.uuid4().hex}")
        compute().write.parquet(temp.toString())
        if not files.rename(temp, to) or files.exists(self._at(f"{name}/{key}/{temp.getName()}")[0]):
            # another run was first: the tables are equal, ours goes (a rename may put it inside the other)
            for left in (temp, self._at(f"{name}/{key}/{temp.getName()}")[0]):
                files.delete(left, True)
        self.made.append((name, key))
        return self.read(name, key)

    def drop_others(self, name: str, keys: set[str]) -> None:
        """Delete the tables of a name whose keys aren't among those given."""
        top, files = self._at(name)
        if files.exists(top):
            for status in files.listStatus(top):
                if status.getPath().getName() not in keys:
                    files.delete(status.getPath(), True)


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """df written to the shared folder and read again: later plans start from it, and lost executors don't lose it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that cut() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    folder = shared_folder(spark).replace("file:///", "file:/")
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        if path.toString().replace("file:///", "file:/").startswith(f"{folder}/"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
