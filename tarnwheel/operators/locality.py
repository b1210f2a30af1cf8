"""How many bytes of what a task reads each worker holds.

Tasks and workers meet in a grid of cells: a block of tasks by a block of workers, both by hash. A cell gets the reads
of its tasks and the holdings of its workers and adds up in numpy, block by block, so the pairs of a task and a worker, which grow with
the square of the tables, are neither shuffled nor sorted; an object that everybody reads or holds is spread over all cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import cpus, cut
from .ordered import dense_ids

#: Pairs that a cell makes.
PAIRS = 1 << 25
#: Pairs that a cell adds up at a time.
PAIRS_AT_ONCE = 1 << 20
#: Reads or holdings that a cell takes in.
CELL_ROWS = 1 << 20

#: task, worker (both as codes), bytes, n_objects
Sums = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _numpy(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False)


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(codes, values in order, null first): null is a value like others."""
    d = pc.dictionary_encode(column.combine_chunks(), null_encoding="encode")
    order = pc.array_sort_indices(d.dictionary, null_placement="at_start")
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[d.indices.to_numpy()], d.dictionary.take(order)


def _added(task: np.ndarray, size: np.ndarray, worker: np.ndarray, held: np.ndarray, width: int) -> Sums:
    """Sums by (task, worker) of reads in order of task; size: pairs of each read; worker and held: of each pair."""
    at = np.repeat(task - task[0], size) * width + worker
    n = int(task[-1] - task[0] + 1) * width
    keys = None
    if n > 16 * len(at):  # few of the products of tasks and workers are pairs
        keys, at = np.unique(at, return_inverse=True)
        n = len(keys)
    count = np.bincount(at, minlength=n)
    total = np.zeros(n, held.dtype)
    np.add.at(total, at, held)
    hit = np.flatnonzero(count)
    key = hit if keys is None else keys[hit]
    return key // width + task[0], key % width, total[hit], count[hit]


def sums(reads: pa.Table, held: pa.Table) -> tuple[pa.Array, pa.Array, Iterator[Sums]]:
    """(tasks, workers, sums in blocks of whole tasks, in order of task and worker) of a cell. reads: task, unit; held: of (the unit), worker, bytes."""
    task, tasks = _codes(reads["task"])
    worker, workers = _codes(held["worker"])
    unit = _numpy(held["of"])
    order = np.lexsort((worker, unit))
    unit, worker, size = unit[order], worker[order], _numpy(held["bytes"])[order]
    wanted = _numpy(reads["unit"])
    lo, hi = np.searchsorted(unit, wanted, "left"), np.searchsorted(unit, wanted, "right")
    found = np.flatnonzero(hi > lo)
    found = found[np.argsort(task[found], kind="stable")]
    task, lo, n = task[found], lo[found], (hi - lo)[found]
    if len(task) and float(np.abs(size.astype(float)).max()) * np.bincount(task).max() >= 2.0**62:
        size = size.astype(object)  # sums may not fit into 64 bits; those that come out must

    def blocks() -> Iterator[Sums]:
        edges = np.flatnonzero(np.r_[True, task[1:] != task[:-1], True]) if len(task) else np.zeros(1, int)
        ends = np.r_[0, np.cumsum(n)][edges]  # pairs before each task
        a = 0
        while a < len(edges) - 1:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + PAIRS_AT_ONCE, "right")) - 1)
            part = slice(edges[a], edges[b])
            alone = np.repeat(np.diff(edges[a : b + 1]) == 1, np.diff(edges[a : b + 1]))
            for single in (True, False):
                of = np.flatnonzero(alone == single) + part.start
                if not len(of):
                    continue
                pair = np.repeat(lo[of] - np.r_[0, np.cumsum(n[of])[:-1]], n[of]) + np.arange(n[of].sum())
                if single:
                    yield np.repeat(task[of], n[of]), worker[pair], size[pair], np.ones(len(pair), np.int64)
                    continue
                # as many tasks at a time as make a table of this many cells, if it is dense
                codes = np.unique(task[of])
                of_task = np.searchsorted(codes, task[of])
                starts = np.r_[0, np.cumsum(n[of])]
                step = max(1, 4 * PAIRS_AT_ONCE // max(1, len(workers)))
                for t in range(0, len(codes), step):
                    x, y = np.searchsorted(of_task, [t, t + step])
                    p = pair[starts[x] : starts[y]]
                    k, *rest = _added(of_task[x:y], n[of[x:y]], worker[p], size[p], len(workers))
                    yield codes[k], *rest
            a = b

    return tasks, workers, blocks()


#: What comes out of a cell's sums, batch by batch.
Made = Callable[[pa.Array, pa.Array, Iterator[Sums]], Iterator[pa.RecordBatch]]
#: Rows of a batch that comes out.
BATCH = 1 << 16


def _all(kinds: pa.Schema) -> Made:
    def made(tasks: pa.Array, workers: pa.Array, blocks: Iterator[Sums]) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            for i in range(0, len(block[0]), BATCH):
                t, w, b, n = (x[i : i + BATCH] for x in block)
                yield pa.record_batch([tasks.take(pa.array(t)), workers.take(pa.array(w)), pa.array(b, pa.int64()), pa.array(n, pa.int64())], kinds)

    return made


def _best(kinds: pa.Schema) -> Made:
    def made(tasks: pa.Array, workers: pa.Array, blocks: Iterator[Sums]) -> Iterator[pa.RecordBatch]:
        for t, w, b, _ in blocks:  # whole tasks, in order of task and worker
            starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            top = np.repeat(np.maximum.reduceat(b, starts), np.diff(np.r_[starts, len(t)]))
            at = np.flatnonzero((b == top) & (top > 0))
            at = at[np.flatnonzero(np.r_[True, t[at][1:] != t[at][:-1]])] if len(at) else at
            yield pa.record_batch([tasks.take(pa.array(t[at])), workers.take(pa.array(w[at])), pa.array(b[at], pa.int64())], kinds)

    return made


def _celled(made: Made) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The work of a partition, which is a cell."""

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        both = pa.Table.from_batches(got)
        side = both["reads"]
        reads, held = both.filter(side).select(["task", "unit"]), both.filter(pc.invert(side)).select(["unit", "worker", "bytes"])
        if reads.num_rows and held.num_rows:
            yield from made(*sums(reads, held.rename_columns(["of", "worker", "bytes"])))

    return cell


def in_cells(reads: DataFrame, held: DataFrame, most: int, made: Made, schema: str) -> DataFrame:
    """What is made of the sums of reads (task, unit) and holdings (unit, worker, bytes) in each cell of about `most` pairs; both are used twice."""
    met = reads.groupBy("unit").agg(F.count(F.lit(1)).alias("r")).join(held.groupBy("unit").agg(F.count(F.lit(1)).alias("w")), "unit")
    pairs, r, w = met.agg(F.sum(F.col("r").cast("double") * F.col("w")), F.sum("r"), F.sum("w")).first()
    if not pairs:
        return reads.sparkSession.createDataFrame([], schema)
    n = max(math.ceil(pairs / most), min(4 * cpus(reads.sparkSession), math.ceil(pairs / 50_000)))
    # rows that travel are r * across + w * down
    down = max(1, min(n, round(math.sqrt(n * r / w))), math.ceil(r / CELL_ROWS))
    across = max(math.ceil(n / down), math.ceil(w / CELL_ROWS))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = reads.select("task", "unit", block("task", down).alias("i"), every(across).alias("j")).withColumns({"worker": F.lit(None).cast(dict(held.dtypes)["worker"]), "bytes": F.lit(None).cast("bigint"), "reads": F.lit(True)})
    right = held.select("unit", "worker", "bytes", block("worker", across).alias("j"), every(down).alias("i")).withColumns({"task": F.lit(None).cast(dict(reads.dtypes)["task"]), "reads": F.lit(False)})
    cell = (F.col("i") * across + F.col("j")).alias("cell")
    both = left.select(cell, "reads", "task", "unit", "worker", "bytes").unionByName(right.select(cell, "reads", "task", "unit", "worker", "bytes"))
    return both.repartitionById(down * across, "cell").mapInArrow(_celled(made), schema)


def local_bytes(reads: DataFrame, holders: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(task, worker, bytes, n_objects): what each worker holds of the objects that each task reads; no row without any.

    reads: (task, object), distinct; holders: (object, worker, bytes), one row for each object and worker.
    """
    holders = cut(holders.where("object is not null").select("object", "worker", F.col("bytes").cast("bigint").alias("bytes")))
    ids = dense_ids(holders.select("object").distinct(), ["object"], "unit").select("object", F.col("unit").cast("bigint").alias("unit"))
    schema = f"task {dict(reads.dtypes)['task']}, worker {dict(holders.dtypes)['worker']}, bytes bigint, n_objects bigint"
    r, h = reads.join(ids, "object").select("task", "unit"), holders.join(ids, "object").select("unit", "worker", "bytes")
    return in_cells(cut(r), cut(h), pairs, _all(to_arrow_schema(StructType.fromDDL(schema))), schema)


def most_local(tasks: DataFrame, fit: Callable[[DataFrame], DataFrame], reads: DataFrame, holders: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(task, near: b, worker): the worker that holds most bytes (more than none) of what the task reads, of those that `fit` leaves; b is minus these bytes.

    tasks: task, needs, distinct; fit: a function from (needs, object, worker, bytes) to those rows whose worker fits the needs; reads and
    holders as for local_bytes. Ties go to the smaller worker. Tasks that read one object share its answer; only the others meet in cells.
    """
    wanted = cut(tasks.join(reads, "task").where("object is not null").select("task", "needs", "object"))
    ids = dense_ids(wanted.select("needs", "object").distinct(), ["needs", "object"], "unit")
    ids = cut(ids.select("needs", "object", F.col("unit").cast("bigint").alias("unit")))
    held = cut(fit(ids.join(holders.select("object", "worker", F.col("bytes").cast("bigint").alias("bytes")), "object")).select("unit", "worker", "bytes"))
    near = F.min(F.struct((-F.col("bytes")).alias("b"), "worker")).alias("near")
    alone = wanted.groupBy("task").agg(F.count(F.lit(1)).alias("_n"), F.any_value("needs").alias("needs"), F.any_value("object").alias("object")).where("_n = 1")
    one = alone.join(ids, ["needs", "object"]).join(held.where("bytes > 0").groupBy("unit").agg(near), "unit").select("task", "near")
    many = cut(wanted.join(alone, "task", "left_anti").join(ids, ["needs", "object"]).select("task", "unit"))
    met = held.join(many.select("unit").distinct(), "unit", "left_semi")
    schema = f"task {dict(tasks.dtypes)['task']}, worker {dict(holders.dtypes)['worker']}, bytes bigint"
    found = in_cells(many, met, pairs, _best(to_arrow_schema(StructType.fromDDL(schema))), schema)
    return one.unionByName(found.groupBy("task").agg(near))
