"""Sessions, table loading and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Defaults for a session of our own; a session that exists already keeps its settings.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def session(app: str = "tarnwheel", master: str | None = None, **conf: str) -> SparkSession:
    """The active session, or a new one with CONF and conf."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table, with only the named columns where some are named."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset.

    Only a local session may fall back to a folder of this machine.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tarnwheel-")
    sc.setCheckpointDir(named)
    return named


def file_at(uri: str):
    """(file system, path) of a file in the shared folder, for tasks that keep something of their own there."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def one_row(df: DataFrame) -> DataFrame:
    """The single row of an aggregate without keys, under a broadcast hint."""
    return F.broadcast(df.limit(1))


#: Bytes of values up to which a side may be broadcast.
BROADCAST_BYTES = 64 << 20


def value_bytes(df: DataFrame) -> Column:
    """About how many bytes the values of a row take."""
    parts = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        text = c if kind in ("string", "binary") else F.to_json(F.struct(c)) if kind in ("array", "map", "struct") else None
        parts.append(F.lit(16) if text is None else F.lit(16) + F.coalesce(F.octet_length(text), F.lit(0)))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total.cast("bigint")


def broadcast_if_small(df: DataFrame, max_rows: int, written: bool = False, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """(df, whether it may be broadcast): df is written once (unless it is `written` already), its rows and their bytes are counted.

    Up to max_rows rows and max_bytes bytes it comes back under a broadcast hint; beyond, as it is, and
    the caller's join shuffles (with AQE's split of skewed partitions).
    """
    df = df if written else cut(df)
    n, size = df.agg(F.count(F.lit(1)), F.sum(value_bytes(df))).first()
    if n <= max_rows and (size or 0) <= max_bytes:
        return F.broadcast(df), True
    return df, False


def cpus(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism or os.cpu_count() or 1)
