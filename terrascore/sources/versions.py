"""Published tables: numbered versions, of which readers may keep to one, and writers that notice each other.

path/v-<name> holds the files of one version, path/_versions/<number>.json says which folder a version is, what it was made
from, and the writer's notes. A version is there once its number is: the small file is written under another name and
renamed to the next number, which fails if another writer was first. Readers take the largest number, or the one they ask for.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Versions that stay when a new one is published.
KEPT = 10
LOG = "_versions"


class Conflict(RuntimeError):
    """Another writer has published since the version that this one was made from."""


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    base: int
    notes: dict = field(default_factory=dict)


class _Files:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf, self.path = spark._jvm, spark._jsc.hadoopConfiguration(), path
        self.files = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        top = self.at(name)
        return [s.getPath().getName() for s in self.files.listStatus(top)] if self.files.exists(top) else []

    def text(self, name: str) -> str:
        stream = self.files.open(self.at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Write a file that isn't there yet, whole or not at all; False if it is there."""
        temp = f"{LOG}/_{uuid.uuid4().hex}"
        out = self.files.create(self.at(temp), True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at(name).toUri(), self.conf)
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self.at(temp), self.at(name), none)
        except Exception as error:
            self.files.delete(self.at(temp), False)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.files.delete(self.at(name), True)


def _numbers(files: _Files) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in files.names(LOG) if n.endswith(".json") and n[0] not in "._")


def _version(files: _Files, number: int) -> Version:
    return Version(**json.loads(files.text(f"{LOG}/{number:010d}.json")))


def versions(spark: SparkSession, path: str) -> list[Version]:
    """The versions that a published table still has, oldest first."""
    files = _Files(spark, path)
    return [_version(files, n) for n in _numbers(files)]


def latest(spark: SparkSession, path: str) -> Version | None:
    files = _Files(spark, path)
    return _version(files, n[-1]) if (n := _numbers(files)) else None


def published(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """A published table as it is now, or one version of it. A version can be read until as many newer ones as are kept follow it."""
    files = _Files(spark, path)
    numbers = _numbers(files)
    if not numbers or number is not None and number not in numbers:
        raise ValueError(f"{path} has no version" + (f" {number}; it has {numbers}" if numbers else ""))
    return spark.read.parquet(f"{path}/{_version(files, number or numbers[-1]).folder}")


def publish(df: DataFrame, path: str, expect: int | None = None, keep: int | None = KEPT, notes: dict | None = None) -> bool:
    """Write df as the next version under path; an empty one keeps what is there. Returns whether it was written.

    expect: the number of the version that df was made from (0 for none), by default the latest when this is called. If another
    version has come since, this one's files are deleted and Conflict is raised. df may read the table that it follows. keep: how many
    versions stay, None for all. notes are added to those of the version before."""
    if df.isEmpty():
        return False
    spark = df.sparkSession
    files = _Files(spark, path)
    before = _numbers(files)
    base = (before[-1] if before else 0) if expect is None else expect
    folder = f"v-{uuid.uuid4().hex}"
    if base != (before[-1] if before else 0):
        raise Conflict(f"version {before[-1] if before else 0} of {path} has come since {base}")
    old = _version(files, base).notes if base else {}
    df.write.parquet(f"{path}/{folder}")
    said = json.dumps({"number": base + 1, "folder": folder, "base": base, "notes": {**old, **(notes or {})}})
    if not files.write_new(f"{LOG}/{base + 1:010d}.json", said):
        files.delete(folder)
        raise Conflict(f"version {base + 1} of {path} was published by another writer")
    if keep is not None:
        for n in _numbers(files)[: -max(1, keep)]:
            gone = _version(files, n).folder
            files.delete(f"{LOG}/{n:010d}.json")
            files.delete(gone)
    return True
