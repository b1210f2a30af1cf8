"""Sparse systems by overlapping domain decomposition (restricted additive Schwarz), with an optional coarse level.

Matrices and vectors are tables (i, j, v) and (i, v). Unknowns are split into blocks; each block is widened along the
matrix graph and solved by a sparse Cholesky factorisation: unknowns are put in order of their distance from a corner
of the block, which makes its matrix block-tridiagonal. Factors are made once and lie in a file per block in the shared
folder, read by the block's task and kept by its worker; they are never shuffled. What a step shuffles is one message
for each pair of neighbouring blocks, with the values that one needs of the other. Residuals are summed where the
values have just arrived, so they take no pass of their own.
"""

from __future__ import annotations

import io
import math
import pickle
import sys
import types
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, file_at, shared_dir

#: Numbers of a block's factor (256 MB). A larger block is solved by conjugate gradients.
MAX_FACTOR = 1 << 25
#: Bytes of blocks that a worker keeps.
KEPT = 256 << 20
#: Unknowns that the driver solves densely: the coarse level, and direct solutions for comparison.
MAX_BLOCK = 4000


def poisson(spark: SparkSession, n: int) -> DataFrame:
    """(i, j, v): the five-point matrix of an n by n grid, 4 on the diagonal and -1 to each neighbour."""
    c = spark.range(n * n).select(F.col("id").alias("i"), F.call_function("div", "id", F.lit(n)).alias("r"), (F.col("id") % n).alias("c"))
    near = F.array(*(F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c"), F.lit(v).alias("v")) for a, b, v in ((0, 0, 4.0), (-1, 0, -1.0), (1, 0, -1.0), (0, -1, -1.0), (0, 1, -1.0))))
    x = c.select("i", F.explode(near).alias("p")).where(f"p.r >= 0 and p.r < {n} and p.c >= 0 and p.c < {n}")
    return x.select("i", (F.col("p.r") * n + F.col("p.c")).alias("j"), F.col("p.v").alias("v"))


def stored_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v): a matrix in an .npz file, as triplets (row, col, data), compressed rows (indptr, indices, data) or dense (matrix).

    The file is read by the driver, as such files come from one machine; larger matrices are tables.
    """
    system, at = file_at(path)
    with system.open_input_file(at) as f, np.load(io.BytesIO(f.read())) as z:
        return matrix_of(spark, {k: z[k] for k in z.files})


def matrix_of(spark: SparkSession, arrays: dict[str, np.ndarray]) -> DataFrame:
    """(i, j, v): a matrix held by the driver, in one of the forms of stored_matrix; zeros are left out."""
    if "matrix" in arrays:
        i, j = np.nonzero(arrays["matrix"])
        v = arrays["matrix"][i, j]
    elif "indptr" in arrays:
        i, j, v = np.repeat(np.arange(len(arrays["indptr"]) - 1), np.diff(arrays["indptr"])), arrays["indices"], arrays["data"]
    elif "row" in arrays:
        i, j, v = arrays["row"], arrays["col"], arrays["data"]
    else:
        raise ValueError("a matrix is needed: matrix, or indptr, indices and data, or row, col and data")
    some = np.asarray(v) != 0
    rows = pa.table([pa.array(np.asarray(x)[some].astype(t)) for x, t in ((i, np.int64), (j, np.int64), (v, np.float64))], names=["i", "j", "v"])
    return spark.createDataFrame(rows)


def factor(nsd: int) -> tuple[int, int]:
    """(rows, columns) of blocks: the factorisation closest to a square, rows the smaller."""
    r = next(k for k in range(math.isqrt(nsd), 0, -1) if nsd % k == 0)
    return r, nsd // r


def bounds(n: int, parts: int) -> list[int]:
    """Cuts of n into parts; the first ones get one more."""
    size, extra = divmod(n, parts)
    out = [0]
    for k in range(parts):
        out.append(out[-1] + size + (k < extra))
    return out


def grid_blocks(spark: SparkSession, n: int, nsd: int) -> DataFrame:
    """(i, sd): the block of each unknown of an n by n grid."""
    pr, pc = factor(nsd)

    def part(c, b: list[int]):
        out = F.lit(len(b) - 2)
        for k in range(len(b) - 3, -1, -1):
            out = F.when(c < b[k + 1], k).otherwise(out)
        return out

    x = spark.range(n * n).select(F.col("id").alias("i"), F.call_function("div", "id", F.lit(n)).alias("r"), (F.col("id") % n).alias("c"))
    return x.select("i", (part(F.col("r"), bounds(n, pr)) * pc + part(F.col("c"), bounds(n, pc))).cast("int").alias("sd"))


def widened(a: DataFrame, blocks: DataFrame, hops: int, overlap: float = 0.0) -> DataFrame:
    """(sd, i, own): each block with all unknowns at most so many steps away in the matrix graph.

    A block that has grown by less than the share `overlap` of its own unknowns is widened by as many steps again.
    """
    e = a.where("i <> j").select(F.col("i").alias("a0"), F.col("j").alias("b0"))

    def grow(rings: list[DataFrame]) -> list[DataFrame]:
        for _ in range(hops):  # the matrix is symmetric, so a ring's neighbours lie in the rings beside it
            near = rings[-1] if len(rings) == 1 else rings[-1].unionByName(rings[-2])
            nxt = rings[-1].join(e, rings[-1].i == e.a0).select("sd", F.col("b0").alias("i")).distinct()
            rings.append(cut(nxt.join(near, ["sd", "i"], "left_anti")))
        return rings

    rings = grow([cut(blocks.select("sd", "i"))])
    out = rings[0].withColumn("own", F.lit(True))
    for r in rings[1:]:
        out = out.unionByName(r.withColumn("own", F.lit(False)))
    if overlap and hops:
        short = cut(out.groupBy("sd").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("o")).where(F.col("n") < (1 + overlap) * F.col("o")).select("sd"))
        for r in grow([x.join(short, "sd", "left_semi") for x in rings[-2:]])[2:]:
            out = out.unionByName(r.withColumn("own", F.lit(False)))
    return out


def sub_systems(a: DataFrame, blocks: DataFrame, hops: int) -> DataFrame:
    """(sd, i, j, v, inside): each widened block's rows; entries not inside lead to a ghost value."""
    w = widened(a, blocks, hops).select("sd", "i")
    return a.join(w, "i").join(w.select("sd", F.col("i").alias("j"), F.lit(True).alias("_in")), ["sd", "j"], "left").select("sd", "i", "j", "v", F.col("_in").isNotNull().alias("inside"))


def multiply(a: DataFrame, x: DataFrame) -> DataFrame:
    """(i, v): the product of a matrix and a vector."""
    xx = x.select(F.col("i").alias("j"), F.col("v").alias("_x"))
    return a.join(xx, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("_x")).alias("v"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v): the product of two matrices."""
    bb = b.select(F.col("i").alias("j"), F.col("j").alias("_j"), F.col("v").alias("_v"))
    return a.join(bb, "j").groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("v") * F.col("_v")).alias("v"))


def transposed(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def bilinear(spark: SparkSession, n: int, m: int) -> DataFrame:
    """(i, j, v): interpolation from an m by m grid to an n by n one, both spread over the same square without its border."""
    c = spark.range(n * n).select(F.col("id").alias("i"), F.call_function("div", "id", F.lit(n)).alias("r"), (F.col("id") % n).alias("c"))
    at = lambda x: (F.col(x) + 1) * float(m + 1) / float(n + 1) - 1
    c = c.withColumn("fr", at("r")).withColumn("fc", at("c")).withColumn("r0", F.floor("fr")).withColumn("c0", F.floor("fc"))
    w = lambda f, z, k: F.when(F.lit(k == 1), F.col(f) - F.col(z)).otherwise(1 - (F.col(f) - F.col(z)))
    corners = F.array(*(F.struct((F.col("r0") + a).alias("r"), (F.col("c0") + b).alias("c"), (w("fr", "r0", a) * w("fc", "c0", b)).alias("v")) for a in (0, 1) for b in (0, 1)))
    x = c.select("i", F.explode(corners).alias("p")).where(f"p.v > 0 and p.r >= 0 and p.r < {m} and p.c >= 0 and p.c < {m}")
    return x.select("i", (F.col("p.r") * m + F.col("p.c")).alias("j"), F.col("p.v").alias("v"))


def norms(a: DataFrame, x: DataFrame, b: DataFrame) -> tuple[float, float, DataFrame]:
    """(residual norm, relative to b, residual vector)."""
    ax = multiply(a, x).withColumnRenamed("v", "_ax")
    r = cut(b.join(ax, "i", "left").select("i", (F.col("v") - F.coalesce("_ax", F.lit(0.0))).alias("v")))
    rr = r.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0] or 0.0
    bb = b.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0] or 0.0
    return rr, rr / bb if bb else rr, r


def levels_of(n: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distance of each of n unknowns, in steps along the entries (r, c), from a far end of its part of the graph; parts follow each other."""
    order = np.argsort(r, kind="stable")
    to, start = c[order], np.searchsorted(r[order], np.arange(n + 1))

    def walk(level: np.ndarray, first: int, base: int) -> tuple[int, int]:
        front, k = np.array([first]), base
        level[front] = k
        while True:
            size = start[front + 1] - start[front]
            at = np.repeat(start[front], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            nxt = np.unique(to[at])
            nxt = nxt[level[nxt] < 0]
            if not len(nxt):
                return int(front[0]), k
            k += 1
            level[nxt] = k
            front = nxt

    level, base = np.full(n, -1), 0
    while (level < 0).any():
        first = int(np.argmax(level < 0))
        end, _ = walk(level.copy(), first, base)
        _, top = walk(level, end, base)
        base = top + 1
    return level


class Factor:
    """Cholesky factor of a sparse symmetric positive definite matrix, block by block along its levels."""

    def __init__(self, n: int, r: np.ndarray, c: np.ndarray, v: np.ndarray):
        level = levels_of(n, r, c)
        self.order = np.argsort(level, kind="stable")
        size = np.bincount(level)
        self.cut = np.r_[0, np.cumsum(size)]
        self.n, self.entries = n, None
        if int((size * size).sum() + (size[1:] * size[:-1]).sum()) > MAX_FACTOR:
            self.entries = r, c, v
            return
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n) - self.cut[level[self.order]]
        by = np.argsort(level[r], kind="stable")
        lr, lc, pr, pc, v = level[r][by], level[c][by], place[r][by], place[c][by], v[by]
        at = np.searchsorted(lr, np.arange(len(size) + 1))
        self.inv: list[np.ndarray] = []
        self.low: list[np.ndarray] = []
        for k, m in enumerate(size):
            s = slice(at[k], at[k + 1])
            d, here = np.zeros((m, m)), lc[s] == k
            d[pr[s][here], pc[s][here]] = v[s][here]
            w = np.zeros((m, size[k - 1] if k else 0))
            if k:
                back = lc[s] == k - 1
                w[pr[s][back], pc[s][back]] = v[s][back]
                w = w @ self.inv[-1].T
                d -= w @ w.T
            self.low.append(w)
            self.inv.append(np.linalg.inv(np.linalg.cholesky(d)))

    def _gradients(self, b: np.ndarray) -> np.ndarray:
        """Conjugate gradients, scaled by the diagonal, to 1e-14 of b."""
        r, c, v = self.entries
        times = lambda x: np.bincount(r, v * x[c], self.n)
        scale = 1 / np.bincount(r[r == c], v[r == c], self.n)
        x, left = np.zeros(self.n), b.copy()
        z = scale * left
        p, rz, stop = z.copy(), left @ z, 1e-14 * np.linalg.norm(b)
        for _ in range(20 * self.n):
            if np.linalg.norm(left) <= stop:
                break
            ap = times(p)
            step = rz / (p @ ap)
            x += step * p
            left -= step * ap
            z = scale * left
            new = left @ z
            p, rz = z + new / rz * p, new
        return x

    def solve(self, b: np.ndarray) -> np.ndarray:
        if self.entries is not None:
            return self._gradients(b)
        r, y, x = b[self.order], [], np.empty(len(b))
        for k, inv in enumerate(self.inv):
            p = r[self.cut[k] : self.cut[k + 1]]
            y.append(inv @ (p - self.low[k] @ y[-1] if k else p))
        for k in range(len(y) - 1, -1, -1):
            last = k == len(y) - 1
            z = y[k] if last else y[k] - self.low[k + 1].T @ z
            z = self.inv[k].T @ z
            x[self.order[self.cut[k] : self.cut[k + 1]]] = z
        return x


def _write(path: str, value) -> None:
    """A file that is there whole or not at all; a task that runs twice writes the same again."""
    system, at = file_at(path)
    part = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(cloudpickle.dumps(value, protocol=5))
    system.move(part, at)


def _read(path: str):
    """The value in a file; a worker keeps what it read last, up to KEPT bytes."""
    kept = sys.modules.setdefault("_solver_blocks", types.ModuleType("_solver_blocks")).__dict__.setdefault("kept", {})
    if path in kept:
        kept[path] = kept.pop(path)
        return kept[path][0]
    system, at = file_at(path)
    with system.open_input_stream(at) as f:
        raw = f.read()
    value = pickle.loads(raw)
    kept[path] = value, len(raw)
    while len(kept) > 1 and sum(n for _, n in kept.values()) > KEPT:
        del kept[next(iter(kept))]
    return value


def _setup(folder: str):
    """Writes a block's factor, its couplings and its part of the coarse level; gives the ids it needs of each owner."""

    def run(t: pa.Table) -> pa.Table:
        sd = t.column("sd")[0].as_py()
        col = {c: np.asarray(t.column(c).combine_chunks().fill_null(0)) for c in ("i", "j", "v", "owner")}
        own, into, coarse = (np.asarray(t.column(c).combine_chunks().fill_null(False)) for c in ("own", "into", "coarse"))
        rows = ~coarse
        r, c, v, o = (col[k][rows] for k in ("i", "j", "v", "owner"))
        own, into = own[rows], into[rows]
        inner = np.unique(r)
        ids, first = np.unique(c, return_index=True)
        owner = o[first]
        ri = np.searchsorted(inner, r)
        mine = np.zeros(len(inner), bool)
        mine[ri] = own
        pi, pj, pv = (col[k][coarse] for k in ("i", "j", "v"))
        state = {
            "inner": inner, "ids": ids, "owner": owner, "at": np.searchsorted(ids, inner), "own": mine,
            "factor": Factor(len(inner), ri[into], np.searchsorted(inner, c[into]), v[into]),
            "ghost": (ri[~into], np.searchsorted(ids, c[~into]), v[~into]), "row": (ri[own], np.searchsorted(ids, c[own]), v[own]),
            "p": (np.searchsorted(ids, pi), pj, pv),
        }
        _write(f"{folder}/block-{sd}", state)
        owners = np.unique(owner)
        part = _coarse_part(state)
        return pa.table(
            [pa.array(np.full(len(owners), sd, np.int32)), pa.array(owners.astype(np.int32)), pa.array([ids[owner == k].astype("<i8").tobytes() for k in owners], pa.binary()), pa.array([part if k == sd else None for k in owners], pa.binary())],
            names=["to", "frm", "ids", "coarse"],
        )

    return run


def _coarse_part(state: dict) -> bytes:
    """What a block's own rows give to the coarse matrix: entries (i, j, v), summed."""
    i, j, v = state["p"]
    if not len(i):
        return b""
    order = np.argsort(i, kind="stable")
    i, j, v = i[order], j[order], v[order]
    r, c, a = state["row"]
    r = state["at"][r]
    cuts = np.searchsorted(i, np.arange(len(state["ids"]) + 1))
    width = np.diff(cuts)

    def spread(of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `of`, place among the entries of P) for each pair of a row in `of` and its entries."""
        n = width[of]
        k = np.repeat(np.arange(len(of)), n)
        return at[k], cuts[of][k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)

    e, p = spread(r, np.arange(len(r)))  # entry of A, entry of P in its row
    k, q = spread(c[e], np.arange(len(e)))  # and entry of P in its column
    e, p = e[k], p[k]
    top = int(j.max()) + 1
    code, inv = np.unique(j[p] * top + j[q], return_inverse=True)
    total = np.bincount(inv, v[p] * a[e] * v[q])
    return np.stack([(code // top).astype("<f8"), (code % top).astype("<f8"), total]).tobytes()


def _senders(folder: str):
    """Writes which of its own values a block sends to whom."""

    def run(t: pa.Table) -> pa.Table:
        frm = t.column("frm")[0].as_py()
        ids = {to.as_py(): np.frombuffer(x.as_buffer(), "<i8") for to, x in zip(t.column("to"), t.column("ids"))}
        mine = ids[frm]
        _write(f"{folder}/send-{frm}", {to: np.searchsorted(mine, x) for to, x in sorted(ids.items())})
        return pa.table({"frm": pa.array([frm], pa.int32())})

    return run


def _rhs(folder: str, name: str):
    """Writes a block's part of a right-hand side; gives the square of its own part."""

    def run(t: pa.Table) -> pa.Table:
        sd = t.column("sd")[0].as_py()
        i, v, own = (np.asarray(t.column(c).combine_chunks()) for c in ("i", "v", "own"))
        order = np.argsort(i)
        _write(f"{folder}/{name}-{sd}", v[order])
        return pa.table({"sd": pa.array([sd], pa.int32()), "square": pa.array([float(v[own] @ v[own])])})

    return run


def _values(state: dict, t: pa.Table, e: np.ndarray | None) -> np.ndarray:
    """A block's unknowns and those around it, from the messages of their owners, with the coarse answer e added."""
    x = np.zeros(len(state["ids"]))
    for frm, vals in zip(t.column("frm").to_pylist(), t.column("vals")):
        x[state["owner"] == frm] = np.frombuffer(vals.as_buffer(), "<f8")
    if e is not None:
        i, j, v = state["p"]
        np.add.at(x, i, v * e[j])
    return x


def _residual(state: dict, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """b - Ax on the block's own rows, 0 on the others."""
    r, c, v = state["row"]
    return np.where(state["own"], b - np.bincount(r, v * x[c], len(b)), 0.0)


MESSAGES = "to int, frm int, vals binary, square double"


def _step(folder: str, rhs: str, e: np.ndarray | None):
    """Solves a block with the outside held fixed; only the owners' values go on. `square`: of the residual that came in."""

    def run(t: pa.Table) -> pa.Table:
        sd = t.column("to")[0].as_py()
        state, send, b = (_read(f"{folder}/{k}-{sd}") for k in ("block", "send", rhs))
        x = _values(state, t, e)
        r, c, v = state["ghost"]
        left = b - np.bincount(r, v * x[c], len(b))
        mine = state["factor"].solve(left)[state["own"]]
        res = _residual(state, b, x)
        to = list(send)
        return pa.table([pa.array(to, pa.int32()), pa.array([sd] * len(to), pa.int32()), pa.array([mine[p].astype("<f8").tobytes() for p in send.values()], pa.binary()), pa.array([float(res @ res) if k == sd else 0.0 for k in to])], names=["to", "frm", "vals", "square"])

    return run


def _reduce(folder: str, rhs: str, m: int):
    """The square of a block's residual and its part of the coarse right-hand side."""

    def run(t: pa.Table) -> pa.Table:
        sd = t.column("to")[0].as_py()
        state, b = (_read(f"{folder}/{k}-{sd}") for k in ("block", rhs))
        res = _residual(state, b, _values(state, t, None))
        full = np.zeros(len(state["ids"]))
        full[state["at"]] = res
        i, j, v = state["p"]
        return pa.table({"square": pa.array([float(res @ res)]), "coarse": pa.array([np.bincount(j, v * full[i], m).astype("<f8").tobytes()], pa.binary())})

    return run


def _own_values(folder: str, e: np.ndarray | None):
    def run(t: pa.Table) -> pa.Table:
        state = _read(f"{folder}/block-{t.column('to')[0].as_py()}")
        x = _values(state, t, e)[state["at"]][state["own"]]
        return pa.table([pa.array(state["inner"][state["own"]]), pa.array(x)], names=["i", "v"])

    return run


def _sent(t: pa.Table) -> pa.Table:
    """Values (to, frm, i, v) as messages, one for each pair of blocks in a group."""
    to, frm, i, v = (np.asarray(t.column(c).combine_chunks()) for c in ("to", "frm", "i", "v"))
    order = np.lexsort((i, frm, to))
    to, frm, v = to[order], frm[order], v[order]
    cuts = np.flatnonzero(np.r_[True, (to[1:] != to[:-1]) | (frm[1:] != frm[:-1])])
    return pa.table([pa.array(to[cuts]), pa.array(frm[cuts]), pa.array([x.astype("<f8").tobytes() for x in np.split(v, cuts[1:])], pa.binary()), pa.array(np.zeros(len(cuts)))], names=["to", "frm", "vals", "square"])


def _listed(batches):
    """The ids that blocks need, one a row."""
    for b in batches:
        ids = [np.frombuffer(x.as_buffer(), "<i8") for x in b.column(2)]
        n = [len(x) for x in ids]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column(0)), n)), pa.array(np.repeat(np.asarray(b.column(1)), n)), pa.array(np.concatenate(ids))], names=["to", "frm", "i"])


class Schwarz:
    """Schwarz(a, blocks, hops).solve(b): blocks are set up once and serve any number of right-hand sides."""

    def __init__(self, a: DataFrame, blocks: DataFrame, hops: int, coarse: DataFrame | None = None, overlap: float = 0.0):
        spark = a.sparkSession
        self.spark, self.a = spark, cut(a)
        self.folder = f"{shared_dir(spark)}/solver-{uuid.uuid4().hex[:12]}"
        system, at = file_at(self.folder)
        system.create_dir(at)
        blocks = cut(blocks.select("i", F.col("sd").cast("int").alias("sd")))
        self.w = cut(widened(self.a, blocks, hops, overlap))
        # one partition for each block, as far as their hashes allow: what they shuffle is small, so AQE would put all in one task
        hashes = [r["h"] for r in blocks.select("sd").distinct().select(F.hash("sd").alias("h")).collect()]
        self.parts = min(range(len(hashes), 2 * len(hashes) + 1), key=lambda n: (np.bincount(np.array(hashes) % n).max(), n))
        owner = blocks.select(F.col("i").alias("j"), F.col("sd").alias("owner"))
        inside = self.w.select("sd", F.col("i").alias("j"), F.lit(True).alias("into"))
        rows = self.a.join(self.w, "i").join(owner, "j").join(inside, ["sd", "j"], "left").select("sd", "i", "j", "v", "own", "into", "owner", F.lit(False).alias("coarse"))
        self.ghosts = rows.where("into is null").select("sd", F.col("j").alias("i")).distinct()
        self.p = None
        if coarse is not None:
            self.p = cut(coarse)
            m = int(self.p.agg(F.max("j")).first()[0]) + 1
            if m > MAX_BLOCK:
                raise ValueError(f"the coarse level has more than {MAX_BLOCK} unknowns")
            near = self.w.select("sd", "i").unionByName(self.ghosts)
            no = F.lit(None).cast("boolean")
            rows = rows.unionByName(self.p.join(near, "i").select("sd", "i", "j", "v", no.alias("own"), no.alias("into"), F.lit(None).cast("int").alias("owner"), F.lit(True).alias("coarse")))
        self.needs = cut(self._by(rows, "sd").applyInArrow(_setup(self.folder), "to int, frm int, ids binary, coarse binary"))
        if coarse is not None:  # each block brings its part; together they are the coarse matrix, of m by m at most
            self.ac = np.zeros((m, m))
            for r in self.needs.where("to = frm").select("coarse").toLocalIterator():
                i, j, v = np.frombuffer(r["coarse"], "<f8").reshape(3, -1)
                np.add.at(self.ac, (i.astype(int), j.astype(int)), v)
        self._by(self.needs, "frm").applyInArrow(_senders(self.folder), "frm int").count()

    def _by(self, df: DataFrame, key: str):
        return df.repartition(self.parts, key).groupBy(key)

    def _right_hand_side(self, b: DataFrame) -> tuple[str, float]:
        """(name of its files, norm)."""
        name = f"rhs{uuid.uuid4().hex[:8]}"
        rows = self.w.join(b, "i", "left").select("sd", "i", F.coalesce("v", F.lit(0.0)).alias("v"), "own")
        squares = self._by(rows, "sd").applyInArrow(_rhs(self.folder, name), "sd int, square double")
        return name, math.sqrt(squares.agg(F.sum("square")).first()[0] or 0.0)

    def _start(self, x: DataFrame | None) -> DataFrame:
        """The first messages."""
        if x is None:
            zeros = F.expr("unhex(repeat('00', length(ids)))")
            return self.needs.select("to", "frm", zeros.alias("vals"), F.lit(0.0).alias("square"))
        ids = self.needs.mapInArrow(_listed, "to int, frm int, i bigint")
        return cut(self._by(ids.join(x, "i", "left").select("to", "frm", "i", F.coalesce("v", F.lit(0.0)).alias("v")), "to").applyInArrow(_sent, MESSAGES))

    def _next(self, messages: DataFrame, rhs: str, e: np.ndarray | None = None) -> DataFrame:
        return cut(self._by(messages, "to").applyInArrow(_step(self.folder, rhs, e), MESSAGES))

    def _result(self, messages: DataFrame, e: np.ndarray | None = None) -> DataFrame:
        return cut(self._by(messages, "to").applyInArrow(_own_values(self.folder, e), "i bigint, v double"))

    def step(self, x: DataFrame, b: DataFrame) -> DataFrame:
        """x after all blocks have been solved once."""
        return self._result(self._next(self._start(x), self._right_hand_side(b)[0]))

    def corrected(self, x: DataFrame, r: DataFrame) -> DataFrame:
        """x plus the coarse level's answer to the residual."""
        spark = x.sparkSession
        rc = multiply(transposed(self.p), r).toPandas()
        rhs = np.zeros(len(self.ac))
        rhs[rc["i"]] = rc["v"]
        e = pd.DataFrame({"i": np.arange(len(rhs)), "v": np.linalg.solve(self.ac, rhs)})
        up = multiply(self.p, spark.createDataFrame(e, "i bigint, v double")).withColumnRenamed("v", "_e")
        return cut(x.join(up, "i", "left").select("i", (F.col("v") + F.coalesce("_e", F.lit(0.0))).alias("v")))

    def solve(self, b: DataFrame, tol: float = 1e-8, max_steps: int = 200, min_steps: int = 1, start: DataFrame | None = None) -> tuple[DataFrame, int, float]:
        """(x, steps, relative residual); RuntimeError if max_steps do not reach tol."""
        rhs, norm = self._right_hand_side(b)
        messages, e = self._start(start), None
        relative = lambda squares: math.sqrt(sum(squares)) / (norm or 1.0)
        for k in range(1, max_steps + 2):
            after = self._next(messages, rhs, e)
            if self.p is None:  # the residual of the values that came in
                rel = relative(r["square"] for r in after.where("to = frm").select("square").collect())
                if rel <= tol and k > min_steps:
                    return self._result(messages), k - 1, rel
            messages, e = after, None
            if self.p is not None:
                got = self._by(messages, "to").applyInArrow(_reduce(self.folder, rhs, len(self.ac)), "square double, coarse binary").collect()
                rel = relative(r["square"] for r in got)
                if rel <= tol and k >= min_steps:
                    return self._result(messages), k, rel
                e = np.linalg.solve(self.ac, sum(np.frombuffer(r["coarse"], "<f8") for r in got))
        raise RuntimeError(f"no convergence in {max_steps} steps: relative residual {rel}")

    def march(self, b: DataFrame, update: Callable[[DataFrame, int], DataFrame | None], **kw) -> list[tuple[DataFrame, int, float]]:
        """Solves for b, then for update(x, t) at each further time until it gives None; every solve starts from the last."""
        out = [self.solve(b, **kw)]
        t = 1
        while (nxt := update(out[-1][0], t)) is not None:
            out.append(self.solve(nxt, start=out[-1][0], **kw))
            t += 1
        return out


def exact(a: DataFrame, b: DataFrame, n: int) -> np.ndarray:
    """Direct solution of a system of n unknowns on the driver, for comparison."""
    if n > MAX_BLOCK:
        raise ValueError(f"more than {MAX_BLOCK} unknowns")
    m, rhs = np.zeros((n, n)), np.zeros(n)
    p, q = a.toPandas(), b.toPandas()
    m[p["i"], p["j"]] = p["v"]
    rhs[q["i"]] = q["v"]
    return np.linalg.solve(m, rhs)

