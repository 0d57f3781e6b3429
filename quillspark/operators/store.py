"""Tables kept as versions in a folder. A version is a list of data folders: adding rows writes these rows alone and a new
list, other changes write the table anew. A list appears by a rename, so readers never see a half-written version, a
table may be computed from itself, and of two writers of one version the second fails."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .paragraphs import numbered


class Store:
    """Parquet tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self._jvm = spark, root.rstrip("/"), spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *[p for p in parts if p]]))

    def _versions(self, name: str) -> list[int]:
        folder = self._path(name)
        if not self._fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".list"))

    def _folders(self, name: str, version: int) -> list[str]:
        stream = self._fs.open(self._path(name, f"v{version}.list"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()

    def __contains__(self, name: str) -> bool:
        return bool(self._versions(name))

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            raise KeyError(name)
        return self.spark.read.parquet(*[f"{self.root}/{name}/{f}" for f in self._folders(name, versions[-1])])

    def _commit(self, name: str, folders: list[str], keep: int) -> None:
        versions = self._versions(name)
        new = (versions or [0])[-1] + 1
        draft = self._path(name, f"_{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.writeBytes("\n".join(folders))
        out.close()
        if not self._fs.rename(draft, self._path(name, f"v{new}.list")):
            raise RuntimeError(f"another writer has made version {new} of {name}")
        held = [*versions, new]
        used = {f for v in held[-keep:] for f in self._folders(name, v)}
        for old in held[:-keep]:
            for f in set(self._folders(name, old)) - used:
                self._fs.delete(self._path(name, f), True)
            self._fs.delete(self._path(name, f"v{old}.list"), False)

    def _data(self, name: str, rows: DataFrame) -> str:
        folder = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}/{folder}")
        return folder

    def write(self, name: str, rows: DataFrame, keep: int = 2) -> DataFrame:
        """Make ``rows`` the table; the newest ``keep`` versions stay for those who read them."""
        self._commit(name, [self._data(name, rows)], keep)
        return self.read(name)

    def append(self, name: str, rows: DataFrame, key: str = "id", order: list[Column] | None = None, keep: int = 2) -> DataFrame:
        """Add rows, numbered on from the highest ``key`` in ``order`` (of all columns) if they have no such column."""
        versions = self._versions(name)
        if not versions:
            return self.write(name, rows, keep)
        old = self.read(name)
        if key in old.columns and key not in rows.columns:
            top = old.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
            rows = numbered(rows, order or [F.col(c) for c in rows.columns], key).withColumn(key, F.col(key) + top)
        held = {f.name: f.dataType for f in old.schema.fields}
        rows = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in held.items()])
        self._commit(name, [*self._folders(name, versions[-1]), self._data(name, rows)], keep)
        return self.read(name)

    def upsert(self, name: str, rows: DataFrame, key: str) -> DataFrame:
        """Replace the rows of equal keys and add the others."""
        old = self.read(name)
        return self.write(name, old.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True))

    def clear(self, name: str) -> DataFrame:
        return self.write(name, self.read(name).limit(0))
