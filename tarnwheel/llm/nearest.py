"""Each record of one table with the nearest record in time of another, for the same entity.

Both sides are counted per (entity, half hour). A half hour with more than GROUP_ROWS rows is cut into narrower cells
(minutes, seconds, milliseconds, as far as needed), and left records of one cell that are still more are dealt out by hash, each part with the right
records of the cell; so an entity with a third of all rows is spread and no group grows with the data. The counts also
carry the first and last right time of each cell, from which every cell learns the nearest right time before and after
it: these two go into its group besides its own records, so a tolerance of any length needs no more. Cells are hashed
into Arrow groups. In a group, DuckDB makes a backward and a forward as-of join and the nearer of the two candidates
within the tolerance is taken.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Widths of cells, each a multiple of the next.
WIDTHS_MS = (1_800_000, 60_000, 1_000, 1)
#: Rows of both sides that a group holds on average.
GROUP_ROWS = 100_000

NEAREST = """
with l as (select distinct * exclude (g) from lt), r as (select distinct e, t from rt),
b as (select l.*, r.t as back from l asof left join r on l.e = r.e and l.t >= r.t),
f as (select b.*, r.t as ahead from b asof left join r on b.e = r.e and b.t <= r.t)
select * exclude (back, ahead), case when ahead is null or t::hugeint - back <= ahead::hugeint - t then back else ahead end as hit
from f where least(t::hugeint - back, ahead::hugeint - t) <= {tolerance}
"""


def _match(tolerance: int, columns: list[str]):
    def run(lt: pa.Table, rt: pa.Table) -> pa.Table:
        with duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""}) as con:
            con.register("lt", lt)
            con.register("rt", rt)
            res = con.sql(NEAREST.format(tolerance=tolerance)).to_arrow_table()
        return res.select(columns).cast(pa.schema([(c, lt.schema.field(c).type if c in lt.schema.names else pa.int64()) for c in columns]))

    return run


CELL = ["e", "cell"]


def _cell(width: int) -> Column:
    """Start of the cell; near the least number the time itself, as the start would lie beyond it."""
    return F.coalesce(F.try_subtract("t", F.pmod("t", F.lit(width))), F.col("t"))


def _stats(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records of both sides in each cell, and the first and last right time."""
    no = F.lit(None).cast("bigint")
    both = left.select(*CELL, F.lit(1).alias("l"), F.lit(0).alias("r"), no.alias("t")).unionByName(right.select(*CELL, F.lit(0).alias("l"), F.lit(1).alias("r"), "t"))
    return both.groupBy(*CELL).agg(F.sum("l").alias("l"), F.sum("r").alias("r"), F.min("t").alias("lo"), F.max("t").alias("hi"))


def _cells(left: DataFrame, right: DataFrame, group_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(left, right, statistics of cells): both sides with their cells; more than group_rows rows are left in cells of a millisecond only."""
    left, right = (df.withColumn("cell", _cell(WIDTHS_MS[0])) for df in (left, right))
    full = F.col("l") + F.col("r") > group_rows
    stats = cut(_stats(left, right))
    for width in WIDTHS_MS[1:]:
        dense = stats.where(full).select(*CELL, F.lit(True).alias("dense"))
        if not dense.limit(1).count():
            break
        narrow = lambda df: df.join(dense, CELL, "left").withColumn("cell", F.when(F.col("dense"), _cell(width)).otherwise(F.col("cell")))  # noqa: B023, E731
        left, right = narrow(left), narrow(right.distinct())
        stats = cut(stats.where(~full).unionByName(_stats(left.where("dense"), right.where("dense"))))
        left, right = left.drop("dense"), right.drop("dense")
    return left, right, stats


def nearest_in_time(
    left: DataFrame, right: DataFrame, entity: str, left_time: str, right_time: str, tolerance_ms: int, carry: list[str], matched: str, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """(carry..., entity, left_time, matched): for every distinct left record, the time of the nearest right record.

    Of two equally near ones the earlier. Left records without a right record within tolerance_ms give no row;
    nor do rows with a null entity or time on either side. Repeated rows on either side change nothing; an empty
    side gives an empty result. The tolerance may be of any length. Columns other than those named are not read, so their names cannot clash.
    """
    names = [f"c{i}" for i in range(len(carry))]
    lt = left.select(F.col(entity).cast("bigint").alias("e"), F.col(left_time).cast("bigint").alias("t"), *(F.col(c).alias(n) for c, n in zip(carry, names))).where("e is not null and t is not null")
    rt = right.select(F.col(entity).cast("bigint").alias("e"), F.col(right_time).cast("bigint").alias("t")).where("e is not null and t is not null")
    lt, rt, stats = _cells(lt, rt, group_rows)
    groups = max(1, (stats.agg(F.sum(F.col("l") + F.col("r"))).first()[0] or 0) // group_rows)
    w = Window.partitionBy("e")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    beside = (
        stats.withColumn("before", F.last("hi", True).over(upto(w.orderBy("cell")))).withColumn("after", F.last("lo", True).over(upto(w.orderBy(F.desc("cell")))))
        .where("l > 0").select(*CELL, F.explode(F.array("before", "after")).alias("t")).where("t is not null")
    )
    a, z = lt, rt.select(*CELL, "t").unionByName(beside)
    hot = stats.where(F.col("l") > group_rows).select(*CELL, F.ceil(F.col("l") / group_rows).alias("salts"))
    salt = F.lit(0)
    if hot.limit(1).count():  # more left records than a group holds in the narrowest cell
        salts = F.coalesce("salts", F.lit(1))
        a = a.join(hot, CELL, "left").withColumn("salt", F.pmod(F.xxhash64("t", *names), salts))
        z = z.join(hot, CELL, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))
        salt = F.col("salt")
    g = F.pmod(F.xxhash64(*CELL, salt), F.lit(groups)).alias("g")
    a, z = a.select("e", "t", *names, g), z.select("e", "t", g)
    kinds = dict(lt.dtypes)
    columns = [*names, "e", "t", "hit"]
    schema = ", ".join(f"{n} {kinds.get(n, 'bigint')}" for n in columns)
    res = a.groupBy("g").cogroup(z.groupBy("g")).applyInArrow(_match(tolerance_ms, columns), schema)
    return res.select(*(F.col(n).alias(c) for n, c in zip(names, carry)), F.col("e").alias(entity), F.col("t").alias(left_time), F.col("hit").alias(matched))
