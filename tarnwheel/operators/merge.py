"""Joins that keep account of what does not match, and merges with rules for what meets twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import dense_ids


def linked(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): every key of either side, `both`, `left` or `right`. Keys are reduced to distinct ones first; null keys match nothing and are left out."""
    a = left.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "both").when(F.col("_l").isNotNull(), "left").otherwise("right")
    return a.join(b, key, "full_outer").select(key, side.alias("side"))


def set_differences(left: DataFrame, right: DataFrame, group: str, item: str) -> DataFrame:
    """(group, item, only): items of a group that only one side has."""
    a, b = left.select(group, item).distinct(), right.select(group, item).distinct()
    return a.exceptAll(b).withColumn("only", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only", F.lit("right")))


def with_fallback(rows: DataFrame, lookup: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """rows with the lookup's columns; where the key is missing the defaults, and `fallback` true. lookup has a key once."""
    found = lookup.select(key, *(F.col(c).alias("_" + c) for c in defaults), F.lit(True).alias("_hit"))
    j = rows.join(found, key, "left")
    hit = F.col("_hit").isNotNull()
    return j.select(*rows.columns, *(F.when(hit, F.col("_" + c)).otherwise(v).alias(c) for c, v in defaults.items()), (~hit).alias("fallback"))


def classified(df: DataFrame, rules: Sequence[tuple[Column, str]], ok: str = "ok", name: str = "reason") -> DataFrame:
    """df with the name of the first rule that holds, else ok."""
    reason = F.lit(ok)
    for cond, word in reversed(rules):
        reason = F.when(cond, word).otherwise(reason)
    return df.withColumn(name, reason)


def split_by_reason(df: DataFrame, ok: str = "ok", name: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(rows that passed, rejected rows per reason)."""
    return df.where(F.col(name) == ok).drop(name), df.where(F.col(name) != ok).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def first_of(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in order (ties by the whole row), with `n_dropped`. An aggregate: a hot key is combined where it is read."""
    rest = [c for c in df.columns if c not in key]
    row = F.struct(*order, *(c for c in rest if c not in order))
    g = df.groupBy(*key).agg(F.min(row).alias("_r"), (F.count(F.lit(1)) - 1).alias("n_dropped"))
    return g.select(*key, *(F.col(f"_r.`{c}`").alias(c) for c in rest), "n_dropped")


def range_union(df: DataFrame, key: Sequence[str], lows: Sequence[str], highs: Sequence[str], flags: Sequence[str], source: str, order: Sequence[str]) -> DataFrame:
    """One row per key: least lows, greatest highs, flags or-ed; the first source in order that there is, and `multi_source`."""
    src = F.min(F.when(F.col(source).isNotNull(), F.struct(*order, F.col(source).alias("_s"))))
    return df.groupBy(*key).agg(
        *(F.min(c).alias(c) for c in lows), *(F.max(c).alias(c) for c in highs), *(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags),
        src.getField("_s").alias(source), (F.min(source) < F.max(source)).alias("multi_source"),
    ).withColumn("multi_source", F.coalesce("multi_source", F.lit(False)))


def first_by_file(df: DataFrame, key: Sequence[str], file: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key by (file, order), with `n_conflicts`: rows of other files that lost. Repeats in one file are silent."""
    first = first_of(df, key, [file, *order])
    per = df.groupBy(*key, file).agg(F.count(F.lit(1)).alias("_n")).groupBy(*key).agg((F.sum("_n") - F.min(F.struct(file, "_n")).getField("_n")).alias("n_conflicts"))
    return first.drop("n_dropped").join(per, list(key))


def priority_merge(df: DataFrame, key: str, priority: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The first row of each key by (priority, order), with `n_conflicts`: others in which any of the values differs."""
    row = F.struct(priority, *order, *values)
    first = df.groupBy(key).agg(F.min(row).alias("_f"))
    j = df.join(first, key)
    differs = ~F.struct(*values).eqNullSafe(F.struct(*(F.col(f"_f.{v}").alias(v) for v in values)))
    return j.groupBy(key).agg(*(F.first(f"_f.{v}").alias(v) for v in values), F.count_if(differs).alias("n_conflicts"))


def role_counts(df: DataFrame, key: str, driver: Column, receiver: Column, others: dict[str, Column]) -> DataFrame:
    """Per key: hybrid, driver and receiver exclude each other, the others are counted on their own."""
    return df.groupBy(key).agg(
        F.count_if(driver & receiver).alias("hybrid"), F.count_if(driver & ~receiver).alias("driver"), F.count_if(receiver & ~driver).alias("receiver"), *(F.count_if(c).alias(n) for n, c in others.items())
    )


def renumbered(names: DataFrame, key: str, given: str, order: list[str]) -> DataFrame:
    """(key, id, kept): one id for each name. The id that a name's first row was given is kept if no name before it in order
    claims the same; all other names get the free ids above the largest one given, in order. Names without an id too.
    """
    first = names.groupBy(key).agg(F.min(F.struct(*order, given)).alias("_f")).select(key, *(F.col(f"_f.`{c}`").alias(c) for c in order), F.col(f"_f.`{given}`").alias("_g"))
    claims = first.where("_g is not null").groupBy("_g").agg(F.min(F.struct(*order, key)).getField(key).alias("_owner"))
    j = first.join(claims, "_g", "left").withColumn("kept", F.coalesce(F.col("_owner") == F.col(key), F.lit(False)))
    top = j.agg(F.max("_g")).first()[0]
    new = dense_ids(j.where(~F.col("kept")).select(key, *order), [*order, key], "id", 0 if top is None else top + 1).select(key, F.col("id").cast("bigint").alias("id"), F.lit(False).alias("kept"))
    return j.where("kept").select(key, F.col("_g").cast("bigint").alias("id"), "kept").unionByName(new)


def rewritten(references: DataFrame, column: str, ids: DataFrame, key: str) -> DataFrame:
    """references with the names in a column replaced by their ids; null where a name has none."""
    m = ids.select(F.col(key).alias("_n"), F.col("id").alias("_i"))
    return references.join(m, references[column] == m["_n"], "left").withColumn(column, F.col("_i")).drop("_n", "_i")
