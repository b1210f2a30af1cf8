"""Partition, process, merge and finalize with functions of any kind; the results travel as pickled values.

Partitions are made once, and the processor runs once for each: what it gives is written to the shared folder. The merge
is a left fold in order of the partitions (of existing datasets: by dataset, then by batch), in groups of FAN_IN until
one value is left, so it may be any associative function; `full` folds all in one task. Where the function is a sum or the
like, groupBy().agg() on a DataFrame is the better way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .ordered import dense_ids

FAN_IN = 8
PARTS = "part bigint, value binary"
BATCH = "frame int, task int, batch int, value binary"


class MapReduce:
    """MapReduce(spark).set_partitioner(f).set_processor(g).set_merger(h).run(data).get()"""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._partition = self._process = self._merge = self._final = None
        self._parts: DataFrame | None = None
        self._kind = "summary"
        self._out: DataFrame | None = None

    def _callable(self, f: Callable) -> Callable:
        if not callable(f):
            raise TypeError("a function is needed")
        return f

    def set_partitioner(self, f: Callable[[Any], list]) -> MapReduce:
        """f(data) -> list of partitions; called once."""
        self._partition = self._callable(f)
        return self

    def set_pre_partitioned(self, *frames: DataFrame) -> MapReduce:
        """Existing datasets as partitions: the processor gets each one's rows as a list of dicts, batch by batch."""
        self._parts = None
        for i, df in enumerate(frames):
            p = df.mapInPandas(_rows(i), BATCH)
            self._parts = p if self._parts is None else self._parts.unionByName(p)
        return self

    def set_processor(self, f: Callable[[Any], Any]) -> MapReduce:
        self._process = self._callable(f)
        return self

    def set_merger(self, f: Callable[[Any, Any], Any], kind: str = "summary") -> MapReduce:
        if kind not in ("summary", "full"):
            raise ValueError("kind is summary or full")
        self._merge, self._kind = self._callable(f), kind
        return self

    def set_finalizer(self, f: Callable[[Any], Any]) -> MapReduce:
        self._final = self._callable(f)
        return self

    def run(self, data: Any = None) -> MapReduce:
        if self._merge is None or self._process is None:
            raise ValueError("a processor and a merger are needed")
        if self._parts is not None:
            done = cut(self._parts.mapInPandas(_each(self._process, ["frame", "task", "batch"]), BATCH))
            done = dense_ids(done, ["frame", "task", "batch"], "part").select("part", "value")
            n = done.count()
        else:
            if self._partition is None or data is None:
                raise ValueError("a partitioner and data are needed, or existing partitions")
            made = list(self._partition(data))
            n = len(made)
            parts = self.spark.createDataFrame([(i, bytearray(cloudpickle.dumps(p))) for i, p in enumerate(made)], PARTS).repartitionByRange(max(1, n), "part")
            done = cut(parts.mapInPandas(_each(self._process, ["part"]), PARTS))
        merge = _fold(self._merge)
        if self._kind == "full":
            done = done.groupBy(F.col("part") * 0).applyInPandas(merge, PARTS)
        else:
            first = True
            while first or n > 1:
                n, first = -(-n // FAN_IN), False
                done = done.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(merge, PARTS).select(F.floor(F.col("part") / FAN_IN).alias("part"), "value")
        self._out = done
        return self

    def get(self) -> Any:
        """The merged value; None if there were no partitions."""
        if self._out is None:
            raise ValueError("run first")
        rows = self._out.collect()
        if not rows:
            return None
        value = cloudpickle.loads(bytes(rows[0]["value"]))
        return self._final(value) if self._final else value


def _rows(i: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        for k, f in enumerate(frames):
            yield pd.DataFrame({"frame": [i], "task": [task], "batch": [k], "value": [cloudpickle.dumps(f.to_dict("records"))]})

    return run


def _each(process: Callable, keys: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[keys].assign(value=[cloudpickle.dumps(process(cloudpickle.loads(v))) for v in f["value"]])

    return run


def _fold(merge: Callable):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("part", kind="stable")
        out = reduce(merge, (cloudpickle.loads(v) for v in f["value"]))
        return pd.DataFrame({"part": [f["part"].iloc[0]], "value": [cloudpickle.dumps(out)]})

    return run


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, n): lower-case words between white space, the map and merge of word counting as one aggregate."""
    return df.select(F.explode(F.split(F.lower(text), r"\s+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
