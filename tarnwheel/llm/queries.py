"""The pN_ queries of this subpackage, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, one_row, table
from .leakage import leaks, without_leaks
from .nearest import nearest_in_time
from .packing import CAPACITY, MAX_DOCS, fill, pack
from .quantiles import PRECISION, combine, daily_summaries, percentiles, subtract
from .sentences import sentences

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TOLERANCE_MS = 5_000


@query(f"""
with l as (select distinct task_id, worker_id, exec_start_ms from tasks where worker_id > 0 and exec_start_ms > 0),
s as (select distinct worker_id w, epoch_ms t from worker_samples where worker_id is not null and epoch_ms is not null),
b as (select l.*, s.t as back from l asof left join s on l.worker_id = s.w and l.exec_start_ms >= s.t),
f as (select b.*, s.t as ahead from b asof left join s on b.worker_id = s.w and b.exec_start_ms <= s.t)
select task_id, worker_id, exec_start_ms, case when ahead is null or exec_start_ms - back <= ahead - exec_start_ms then back else ahead end as epoch_ms
from f where least(exec_start_ms - back, ahead - exec_start_ms) <= {TOLERANCE_MS}""")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "tasks", "task_id", "worker_id", "exec_start_ms").where("worker_id > 0 and exec_start_ms > 0")
    samples = table(spark, d, "worker_samples", "worker_id", "epoch_ms")
    return nearest_in_time(tasks, samples, "worker_id", "exec_start_ms", "epoch_ms", TOLERANCE_MS, ["task_id"], "epoch_ms")


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    return daily_summaries(table(spark, d, "tasks", "task_id", "module", "name", "started_ms", "cpu_time_ms"), "module", "name", "started_ms", "cpu_time_ms", "task_id")


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("k1", "module").withColumnRenamed("k2", "name")


@query()
def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _named(percentiles(combine(_summaries(spark, d))))


@query()
def p5_weekly(spark: SparkSession, d: str) -> DataFrame:
    return _named(percentiles(combine(_summaries(spark, d), 7)))


@query("""
with t as (select distinct task_id, module, name, started_ms, cpu_time_ms from tasks where started_ms is not null and cpu_time_ms is not null)
select module, name, started_ms // 86400000 as day, count(*) as n from t group by all""")
def p5_days(spark: SparkSession, d: str) -> DataFrame:
    return _named(_summaries(spark, d)).select("module", "name", "day", "n")


TASKS_SQL = "with t as (select distinct task_id, module, name, started_ms, cpu_time_ms from tasks where started_ms is not null and cpu_time_ms is not null)"


@query(f"""{TASKS_SQL}
select module, name, count(*) as n from t where started_ms // 86400000 < (select max(started_ms // 86400000) from t) group by all""")
def p5_without_last_day(spark: SparkSession, d: str) -> DataFrame:
    days = cut(_summaries(spark, d))
    last = days.agg(F.max("day")).first()[0]
    return _named(subtract(combine(days), combine(days.where(F.col("day") == last)))).select("module", "name", "n")


@query(f"""{TASKS_SQL}
select count(*) as n_groups, 4 * count(*) as n_percentiles, 0::bigint as n_over from (select distinct module, name from t)""")
def p5_rank_error(spark: SparkSession, d: str) -> DataFrame:
    """Groups, percentiles, and how many of these are further from their rank than 1 % of the group."""
    found = percentiles(combine(_summaries(spark, d))).groupBy("k1", "k2", "n").agg(F.collect_list(F.struct("q", "value")).alias("p"))  # four to a group
    t = table(spark, d, "tasks", "task_id", "module", "name", "started_ms", "cpu_time_ms").where("started_ms is not null and cpu_time_ms is not null").distinct()
    counts = t.groupBy(F.col("module").alias("m"), F.col("name").alias("x"), F.col("cpu_time_ms").alias("v")).agg(F.count(F.lit(1)).alias("w"))
    j = counts.join(found, F.col("m").eqNullSafe(F.col("k1")) & F.col("x").eqNullSafe(F.col("k2"))).select("k1", "k2", "n", "v", "w", F.explode("p").alias("p"))
    reach = F.col("p.value") + F.abs(F.col("p.value")) * 2.0 ** (1 - PRECISION)  # values of one code
    ranks = j.groupBy("k1", "k2", "n", "p.q").agg(F.sum(F.when(F.col("v") < F.col("p.value"), F.col("w")).otherwise(0)).alias("lo"), F.sum(F.when(F.col("v") <= reach, F.col("w")).otherwise(0)).alias("hi"))
    off = F.greatest(F.col("lo") / F.col("n") - F.col("q"), F.col("q") - F.col("hi") / F.col("n"))
    return ranks.agg(F.count_distinct(F.struct("k1", "k2")).alias("n_groups"), F.count(F.lit(1)).alias("n_percentiles"), F.count_if(off > 0.01).alias("n_over"))


#: An attention cost that binds: a container full of documents of a quarter of its tokens each.
ATTENTION = CAPACITY * CAPACITY // 4


def _packed(spark: SparkSession, d: str, max_cost: float | None = None) -> DataFrame:
    return pack(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", max_cost=max_cost)


@query()
def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


@query()
def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill(_packed(spark, d)).agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n_docs").alias("n_items"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("fullest"),
        F.sum(F.lit(CAPACITY) - F.col("n_tokens")).alias("unused"),
    )


@query()
def p7_attention(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, ATTENTION)


@query()
def p7_attention_fill(spark: SparkSession, d: str) -> DataFrame:
    over = F.col("cost") > ATTENTION
    return fill(p7_attention(spark, d)).agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n_docs").alias("n_items"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.lit(CAPACITY) - F.col("n_tokens")).alias("unused"),
        F.max(F.when(~over, F.col("cost"))).alias("costliest"), F.count_if(over).alias("n_alone_over"), F.count_if(over & (F.col("n_docs") > 1)).alias("n_over"),
    )


@query("select count(*) as n_docs, 0::bigint as n_split, 0::bigint as n_over_tokens, 0::bigint as n_over_docs, 0::bigint as n_over_cost from documents")
def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Documents packed, and how often the packing under the attention cost breaks a rule: a document that would fit is split, or a container holds too much."""
    packed = cut(p7_attention(spark, d))
    docs = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n_tokens").alias("n"), F.count_if(F.col("piece") == 0).alias("whole"))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n") / CAPACITY))
    d_row = docs.agg(F.sum("whole").alias("n_docs"), F.count_if(F.col("k") != F.col("whole") * pieces).alias("n_split"))
    over = F.col("cost") > ATTENTION
    c_row = fill(packed).agg(F.count_if(F.col("n_tokens") > CAPACITY).alias("n_over_tokens"), F.count_if(F.col("n_docs") > MAX_DOCS).alias("n_over_docs"), F.count_if(over & (F.col("n_docs") > 1)).alias("n_over_cost"))
    return d_row.crossJoin(one_row(c_row))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", table(spark, d, "eval_items", "item_id", "text", "lang"), "item_id", "text", "lang")


@query()
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


@query()
def p8_longest(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


@query()
def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return without_leaks(table(spark, d, "documents", "doc_id", "lang", "source"), "doc_id", _leaks(spark, d))


@query()
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id", "sent_start", "sent_end")


@query()
def p9_lengths(spark: SparkSession, d: str) -> DataFrame:
    s = p9_found(spark, d).withColumn("n", F.col("sent_end") - F.col("sent_start"))
    docs = table(spark, d, "documents", "doc_id", "lang", "source")
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.max("n").alias("longest"), F.sum("n").alias("n_chars")).join(docs, "doc_id")
