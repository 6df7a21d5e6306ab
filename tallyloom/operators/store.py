"""Tables as versioned Parquet folders: create, insert, update, delete, drop.

A version is a small file that lists the data folders it is made of. An append
writes one more folder and a version that names it too; a change of old rows
writes the table into one new folder. Readers see the highest version, which
appears by a rename, so a job that dies half-way changes nothing. One writer at
a time per table.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as S

from tallyloom.operators import filters, keyed
from tallyloom.schema import TABLES


class MissingKeys(LookupError):
    """An update named keys that the table doesn't hold."""


class Store:
    def __init__(self, spark: SparkSession, root: str, keep_versions: int = 2) -> None:
        self.spark, self.root, self.keep = spark, root.rstrip("/"), max(1, keep_versions)
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _versions(self, name: str) -> list[int]:
        """The versions there are, rising."""
        if not self._fs.exists(self._path(name)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(name)) if not s.isDirectory()]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def _folders(self, name: str, version: int) -> list[str]:
        stream = self._fs.open(self._path(f"{name}/v{version}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()

    def tables(self) -> list[str]:
        if not self._fs.exists(self._path("")):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("")) if s.isDirectory() and self._versions(s.getPath().getName()))

    def create(self, name: str, schema: S.StructType | str | None = None) -> None:
        """Idempotent: a table that is there stays as it is. Without a schema the one of that name is taken."""
        if not self._versions(name):
            self._write(name, self.spark.createDataFrame([], schema or TABLES[name]))

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def drop_all(self) -> None:
        for name in self.tables():
            self.drop(name)

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            raise LookupError(f"no table {name}")
        return self.spark.read.parquet(*[f"{self.root}/{name}/{f}" for f in self._folders(name, versions[-1])])

    def _write(self, name: str, df: DataFrame, append: bool = False) -> None:
        versions = self._versions(name)
        new = (versions[-1] if versions else 0) + 1
        folder = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{folder}")
        folders = [*(self._folders(name, versions[-1]) if append and versions else []), folder]
        draft = self._path(f"{name}/draft-{folder}")
        out = self._fs.create(draft, True)
        out.write(bytearray("\n".join(folders).encode()))
        out.close()
        if not self._fs.rename(draft, self._path(f"{name}/v{new}")):
            raise OSError(f"version {new} of {name} is there already")
        kept = [v for v in [*versions, new] if v > new - self.keep]
        used = {f for v in kept for f in self._folders(name, v)}
        for status in self._fs.listStatus(self._path(name)):
            each = status.getPath().getName()
            if each not in used and each not in {f"v{v}" for v in kept}:
                self._fs.delete(status.getPath(), True)

    def max_key(self, name: str, key: str, default: int = 0) -> int:
        return filters.max_key(self.read(name), key, default).first().max_key

    def insert(self, name: str, rows: DataFrame, keys: Sequence[str] = (), order: Sequence[Column] = (), ignore_duplicates: bool = False) -> None:
        """Appends without touching what is there; with ignore_duplicates the first row of a key wins, also over what comes later."""
        old = self.read(name)
        self._write(name, keyed.unseen(old, rows, keys, order) if ignore_duplicates else rows.select(*old.columns), append=True)

    def update(self, name: str, rows: DataFrame, keys: Sequence[str]) -> None:
        """Whole rows replaced by key; a key that is not there is an error and changes nothing."""
        old = self.read(name)
        missing = keyed.unknown_keys(old, rows, keys).limit(1).collect()
        if missing:
            raise MissingKeys(f"{name} has no row {missing[0].asDict()}")
        self._write(name, keyed.update_by_key(old, rows, keys))

    def delete(self, name: str, rows: DataFrame | None = None, keys: Sequence[str] = (), where: Column | None = None) -> None:
        """Rows of the given keys, or those the condition is true for."""
        old = self.read(name)
        self._write(name, keyed.delete_where(old, where) if where is not None else keyed.delete_by_key(old, rows, keys))
