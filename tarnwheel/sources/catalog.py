"""A catalogue of immutable datasets: write once, provenance, small variables, freezing, and a chain of databases.

A database is a folder on the shared file system. Each dataset has a folder of its own, each dataset, variable and
link a small file that is created once and never overwritten, so of two writers at once one wins and nothing is lost.
A dataset counts from the moment its file is there; freezing writes down which are there, so what a slow writer adds
later does not count. Everything goes through Hadoop's file system; the store must refuse to create a file twice, as
HDFS and local disks do.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections import deque
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..functions.schema import check_name
from ..session import shared_dir


class FrozenError(RuntimeError):
    """A write to a frozen database."""


class Files:
    """The few file operations the catalogue needs."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._path = lambda p: self._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, p: str) -> bool:
        return self._fs.exists(self._path(p))

    def create(self, p: str, text: str) -> bool:
        """A new file; False if there is one already."""
        try:
            out = self._fs.create(self._path(p), False)
        except Py4JJavaError as e:
            if self.exists(p):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, p: str) -> str:
        """The text of a file; one that is being written is waited for."""
        for _ in range(50):
            s = self._fs.open(self._path(p))
            try:
                text = bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(s)).decode()
            finally:
                s.close()
            if text:
                break
            time.sleep(0.1)
        return text

    def delete(self, p: str) -> bool:
        return self._fs.delete(self._path(p), True)

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(p))) if self.exists(p) else []

    def fingerprint(self, *paths: str) -> str:
        """12 hexadecimal digits that change with the names, sizes and times of the files at the paths."""
        seen = []
        for p in paths:
            for s in self._fs.listStatus(self._path(p)):
                seen.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        return provenance(*sorted(seen))

    def size(self, p: str) -> int:
        return int(self._fs.getContentSummary(self._path(p)).getLength())


def stored(spark: SparkSession, name: str, paths: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, written once to the shared folder for the files at the paths as they are now, and read from there afterwards."""
    root = f"{shared_dir(spark)}/stored"
    mark = f"{root}/{name}-{Files(spark, paths[0]).fingerprint(*paths)}.json"
    files = Files(spark, root)
    if not files.exists(mark):
        folder = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
        make().write.parquet(folder)
        if not files.create(mark, json.dumps(folder)):
            files.delete(folder)
    return spark.read.parquet(json.loads(files.read(mark)))


def provenance(*parts: Any) -> str:
    """12 hexadecimal digits that stand for the code and inputs a dataset was made from."""
    return hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest()[:12]


class Database:
    """One database of a catalogue."""

    def __init__(self, catalog: Catalog, name: str):
        self.catalog, self.name = catalog, name
        self.path = f"{catalog.root}/{name}"
        self._temp: dict[str, DataFrame] = {}

    def _read(self, kind: str, name: str) -> Any:
        """The value of a small file, None without it."""
        p = f"{self.path}/{kind}/{name}.json"
        return json.loads(self.catalog.files.read(p)) if self.catalog.files.exists(p) else None

    def _listed(self, kind: str) -> list[str]:
        return [n[:-5] for n in self.catalog.files.names(f"{self.path}/{kind}") if n.endswith(".json")]

    def _new(self, kind: str, name: str, value: Any) -> bool:
        return self.catalog.files.create(f"{self.path}/{kind}/{name}.json", json.dumps(value, sort_keys=True))

    @property
    def info(self) -> dict:
        """name, role, attrs and uid."""
        return json.loads(self.catalog.files.read(f"{self.path}/_db.json"))

    @property
    def frozen(self) -> bool:
        return self._read("_state", "frozen") is not None

    def _datasets(self) -> list[str]:
        kept = self._read("_state", "frozen")
        return self._listed("_sets") if kept is None else kept

    def links(self, forward: bool = False) -> list[str]:
        """Names of the databases before this one (after it, if forward), in order of declaration."""
        kind = "_next" if forward else "_prev"
        return [self._read(kind, n) for n in self._listed(kind)]

    def _open(self) -> None:
        if self.frozen:
            raise FrozenError(f"{self.name} is frozen")

    def _taken(self, name: str, made_by: str) -> bool:
        """Whether the dataset is there; ValueError if another provenance made it."""
        old = self._read("_sets", name)
        if old is None:
            return False
        if made_by and old["by"] == made_by:
            return True
        raise ValueError(f"{name} is there already, made by {old['by'] or 'something unnamed'}")

    def write(self, name: str, df: DataFrame, made_by: str = "", partition_by: list[str] | None = None, codec: str = "zstd") -> bool:
        """Writes a dataset once. The same provenance again is passed over (False); another raises ValueError.

        Of two writers at once the one whose file is created first wins; the other is treated as if it had come later.
        """
        check_name(name)
        self._open()
        if self._taken(name, made_by):
            return False
        files, folder = self.catalog.files, f"{name}-{uuid.uuid4().hex[:12]}"
        w = df.write.mode("overwrite").option("compression", codec)
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.path}/{folder}")
        won = not self.frozen and self._new("_sets", name, {"by": made_by, "folder": folder})
        if won and name in self._datasets():
            return True
        files.delete(f"{self.path}/{folder}")
        if won:  # frozen in between
            files.delete(f"{self.path}/_sets/{name}.json")
        self._open()
        return not self._taken(name, made_by)

    def write_temp(self, name: str, df: DataFrame) -> DataFrame:
        """A dataset that lives with this session and is gone when the database freezes."""
        self._open()
        if name in self._temp:
            raise ValueError(f"{name} is there already")
        self._temp[name] = df.persist()
        return self._temp[name]

    def read(self, name: str, where: str | None = None) -> DataFrame:
        """A dataset, pruned to partitions by `where`; KeyError without it."""
        if name in self._temp:
            df = self._temp[name]
        elif name in self._datasets():
            df = self.catalog.spark.read.parquet(f"{self.path}/{self._read('_sets', name)['folder']}")
        else:
            raise KeyError(name)
        return df.where(where) if where else df

    def remove(self, name: str, missing_ok: bool = False) -> None:
        self._open()
        if self._temp.pop(name, None) is not None:
            return
        old = self._read("_sets", name)
        if old is None or not self.catalog.files.delete(f"{self.path}/_sets/{name}.json"):
            if missing_ok:
                return
            raise KeyError(name)
        self.catalog.files.delete(f"{self.path}/{old['folder']}")

    def set_var(self, name: str, value: Any) -> None:
        """A small immutable value."""
        self._open()
        if not self._new("_vars", name, value):
            raise ValueError(f"{name} is set already")

    def get_var(self, name: str) -> Any:
        return self._read("_vars", name)

    def freeze(self) -> None:
        """Drops temporary datasets; from here on the database is read-only, with the datasets that are there now."""
        for df in self._temp.values():
            df.unpersist()
        self._temp.clear()
        self._new("_state", "frozen", self._listed("_sets"))

    def made_by(self, name: str) -> str:
        """The provenance of a dataset; KeyError without it."""
        old = self._read("_sets", name)
        if old is None:
            raise KeyError(name)
        return old["by"]

    def names(self) -> list[str]:
        return sorted([*self._datasets(), *self._temp])

    def after(self, other: Database) -> Database:
        """Links this database behind another in the chain."""
        for a, b, kind in ((self, other, "_prev"), (other, self, "_next")):
            n = len(a._listed(kind))
            while b.name not in a.links(kind == "_next") and not a._new(kind, f"{n:06d}", b.name):
                n += 1
        return self


class Catalog:
    """Databases below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    def create(self, name: str, role: str = "", **attrs: str) -> Database:
        """A new database; an existing name gets the next suffix, name.1, name.2 and so on."""
        check_name(name)
        n, free = 0, name
        while not self.files.create(f"{self.root}/{free}/_db.json", json.dumps({"name": free, "role": role, "attrs": attrs, "uid": provenance(self.root, free)}, sort_keys=True)):
            n += 1
            free = f"{name}.{n}"
        return Database(self, free)

    def open(self, name: str) -> Database:
        if not self.files.exists(f"{self.root}/{name}/_db.json"):
            raise KeyError(name)
        return Database(self, name)

    def list(self) -> list[str]:
        return [n for n in self.files.names(self.root) if self.files.exists(f"{self.root}/{n}/_db.json")]

    def status(self) -> DataFrame:
        """(name, role, frozen, n_datasets, bytes) of every database."""
        rows = []
        for n in self.list():
            x = Database(self, n)
            rows.append((n, x.info["role"], x.frozen, len(x._datasets()), self.files.size(f"{self.root}/{n}")))
        return self.spark.createDataFrame(rows, "name string, role string, frozen boolean, n_datasets int, bytes bigint")

    def edges(self) -> DataFrame:
        """(a, b, ord): each database and those before it, in order of declaration."""
        rows = [(n, p, i) for n in self.list() for i, p in enumerate(Database(self, n).links())]
        return self.spark.createDataFrame(rows, "a string, b string, ord int")

    def find(self, start: Database, role: str | None = None, name: str | None = None, uid: str | None = None, forward: bool = False) -> list[Database]:
        """Databases before start (after it, if forward) that meet all criteria given: fewest steps first, then order of declaration."""
        seen, queue, out = {start.name}, deque([start.name]), []
        while queue:
            for n in Database(self, queue.popleft()).links(forward):
                if n in seen:
                    continue
                seen.add(n)
                queue.append(n)
                x = Database(self, n).info
                if role in (None, x["role"]) and name in (None, x["name"].split(".")[0], x["name"]) and uid in (None, x["uid"]):
                    out.append(Database(self, n))
        return out

    def merge(self, name: str, shards: list[Database]) -> Database:
        """A new database with each dataset of the shards put together; of datasets with one name all rows are kept."""
        db = self.create(name)
        for ds in sorted({n for s in shards for n in s.names()}):
            parts = [s.read(ds) for s in shards if ds in s.names()]
            df = parts[0]
            for p in parts[1:]:
                df = df.unionByName(p, allowMissingColumns=True)
            db.write(ds, df, provenance(ds, *(s.name for s in shards)))
        return db

    def migrate(self, db: Database, to: Catalog) -> Database:
        """A copy of a frozen database in another catalogue."""
        if not db.frozen:
            raise ValueError("only a frozen database can move")
        out = to.create(db.name)
        for ds in db._datasets():
            out.write(ds, db.read(ds), db._read("_sets", ds)["by"])
        for k in db._listed("_vars"):
            out.set_var(k, db.get_var(k))
        out.freeze()
        return out
