"""Scalar functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# tasks


def queue_ms() -> Column:
    """From ready to started; 0 stands for not yet, and then creation does."""
    return F.coalesce(F.nullif("started_ms", F.lit(0)), "created_ms") - F.coalesce(F.nullif("ready_ms", F.lit(0)), "created_ms")


def duration_ms() -> Column:
    """Execution time; 0 while the end is open, null before the start."""
    start = F.nullif("exec_start_ms", F.lit(0))
    return F.coalesce(F.nullif("exec_end_ms", F.lit(0)), start) - start


def load_shares(df: DataFrame, exec_ms: Column) -> DataFrame:
    """df with x (execution time, at least 1), cpu, io and wait as shares of it; wait is not below 0."""
    c, io = F.coalesce("cpu_time_ms", F.lit(0)), F.coalesce("read_time_ms", F.lit(0)) + F.coalesce("write_time_ms", F.lit(0))
    d = df.withColumn("x", exec_ms).withColumn("c", c).withColumn("o", io)
    return d.withColumn("cpu", F.col("c") / F.col("x")).withColumn("io", F.col("o") / F.col("x")).withColumn("wait", F.greatest(F.col("x") - F.col("c") - F.col("o"), F.lit(0)) / F.col("x"))


def tier(share: str) -> Column:
    return F.when(F.col(share) >= 0.5, "high").when(F.col(share) >= 0.1, "mid").otherwise("low")


def percent_split(df: DataFrame) -> DataFrame:
    """df (of load_shares) with cpu_pct and io_pct, halves rounded up; io has at most what cpu leaves of 100."""
    pct = lambda a: F.floor(100.0 * F.col(a) / F.col("x") + 0.5)
    return df.withColumn("cpu_pct", F.least(pct("c"), F.lit(100).cast("bigint"))).withColumn("io_pct", F.least(pct("o"), 100 - F.col("cpu_pct")))


def over_baseline(peak: str, base: str) -> Column:
    return F.greatest(F.col(peak) - F.col(base), F.lit(0))


# text


def before_last(c: Column | str, sep: str) -> Column:
    """The text before the last separator; all of it without one."""
    return F.regexp_replace(col(c), f"{_quoted(sep)}[^{_quoted(sep)}]*$", "")


def _quoted(sep: str) -> str:
    return "\\" + sep if sep in r"\^$.|?*+()[]{}-" else sep


def last_segment(c: Column | str, sep: str = "/") -> Column:
    return F.substring_index(col(c), sep, -1)


def int_after_last(c: Column | str, sep: str) -> Column:
    """The whole number after the last separator; null where it is none."""
    return F.substring_index(col(c), sep, -1).try_cast("bigint")


def segments(c: Column | str, sep: str = "/") -> Column:
    """All segments, empty ones too."""
    return F.split(col(c), _quoted(sep), -1)


def joined(parts: Column, sep: str = "/") -> Column:
    """Segments put together; empty ones ahead of the first text leave no separator."""
    return F.aggregate(parts, F.lit(""), lambda a, x: F.when(a == "", x).otherwise(F.concat(a, F.lit(sep), x)))


def strip_prefix(c: Column | str, prefix: list[str], sep: str = "/") -> Column:
    """The path without the leading segments; null where they differ or nothing would be left."""
    s = segments(c, sep)
    n = len(prefix)
    head = F.slice(s, 1, n) == F.array(*(F.lit(p) for p in prefix)) if n else F.lit(True)
    rest = joined(F.slice(s, n + 1, F.greatest(F.size(s) - n, F.lit(0))))
    return F.when((F.size(s) > n) & head & (rest != ""), rest)


def domain(c: Column | str) -> Column:
    """The text before the first `::`; empty without one."""
    return F.when(F.contains(col(c), F.lit("::")), F.split_part(col(c), F.lit("::"), F.lit(1))).otherwise(F.lit(""))


def number_range(c: Column | str) -> Column:
    """struct(min, max, present) of `a:b`, `a` or `*` (absent); null where it is malformed."""
    p = F.split(col(c), ":", -1)
    lo, hi = p.getItem(0).try_cast("double"), F.get(p, F.size(p) - 1).try_cast("double")
    pair = F.struct(lo.alias("min"), hi.alias("max"), F.lit(True).alias("present"))
    none = F.struct(F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"), F.lit(False).alias("present"))
    return F.when(col(c) == "*", none).when((F.size(p) <= 2) & lo.isNotNull() & hi.isNotNull(), pair)


def unescaped(c: Column | str) -> Column:
    """Quoted names without the backslashes that escape."""
    return F.regexp_replace(col(c), r"\\(.)", "$1")


def grid_spec(c: Column | str) -> Column:
    """struct(x, y) of `XxY` with both at least 1; null otherwise."""
    g = lambda i: F.nullif(F.regexp_extract(col(c), r"^([0-9]+)x([0-9]+)$", i), F.lit("")).try_cast("int")
    return F.when((g(1) >= 1) & (g(2) >= 1), F.struct(g(1).alias("x"), g(2).alias("y")))


def uid(c: Column | str) -> Column:
    """12 hexadecimal digits of the text's SHA-256."""
    return F.substring(F.sha2(col(c), 256), 1, 12)


def size_text(c: Column | str) -> Column:
    """Bytes as whole KB or MB, or GB with one decimal."""
    b = col(c)
    mb = lambda k: F.floor(b / k).cast("string")
    return F.when(b < 1 << 20, F.concat(mb(1 << 10), F.lit("KB"))).when(b < 1 << 30, F.concat(mb(1 << 20), F.lit("MB"))).otherwise(F.concat(F.format_string("%.1f", b / float(1 << 30)), F.lit("GB")))


def fnv1a(c: Column | str, mod: int = 65536) -> Column:
    """FNV-1a hash of 32 bits over the bytes of an ASCII text, mod a power of two at most 2**32."""
    codes = F.transform(F.split(col(c), ""), lambda x: F.ascii(x).cast("bigint"))
    h = F.aggregate(F.filter(codes, lambda x: x > 0), F.lit(2166136261).cast("bigint"), lambda a, x: F.pmod((a.bitwiseXOR(x)) * F.lit(16777619).cast("bigint"), F.lit(1 << 32).cast("bigint")))
    return F.pmod(h, F.lit(mod).cast("bigint"))


# numbers


def to_units(c: Column | str, per: float = 1000.0) -> Column:
    """Lengths as whole database units, halves away from zero."""
    return F.round(col(c) * per, 0).cast("bigint")


def floor_div(a: Column, b: Column | int) -> Column:
    """Whole division that rounds down, for negatives too."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", (a - F.pmod(a, b)).cast("bigint"), b.cast("bigint"))


def second(c: Column | str) -> Column:
    return F.floor(col(c) / 1000)
