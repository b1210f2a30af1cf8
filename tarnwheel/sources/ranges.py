"""Large files of the text formats, read in byte ranges; no file is ever loaded whole.

Files are cut into ranges of bytes by their size alone. A first pass looks through each range by itself for the first
place at which a construct begins, and for section heads; windows over one small row a range make the plan: a chunk
goes from the first construct of its range to the first one of the next range that has any. A second pass reads each
chunk, puts the file's head (and in DEF the section it lies in) in front, and parses it. DEF is cut between
statements, so one section of any length is many chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, file_at
from .catalog import Files
from .formats import PARSERS, ROWS, TAIL, repeated, sniff

#: Where a construct begins. DEF statements begin with a dash; one inside a string or a comment is as in the plan of whole texts.
STARTS = {"twf": rb"\(CAUSED_BY\b", "liberty": rb"\bcell\s*\([^)]*\)\s*\{", "lef": rb"(?<=\n)[ \t]*MACRO\s", "def": rb"(?<=\n)[ \t]*-\s"}
SECTION = re.compile(rb"(?:^|(?<=\n))[ \t]*(COMPONENTS|PINS|NETS|SPECIALNETS|VIAS|BLOCKAGES)\s+\d+\s*;|(?<=\n)[ \t]*END[ \t]+(COMPONENTS|PINS|NETS|SPECIALNETS|VIAS|BLOCKAGES)\b")
#: Bytes beyond a range in which what begins in it is still seen.
BEYOND = 4096
FOUND = "file string, no int, first bigint, section string, last string, data bigint"


def byte_ranges(spark: SparkSession, paths: list[str], chunk: int) -> DataFrame:
    """(file, no, start, stop): ranges of `chunk` bytes of every file, from the sizes alone."""
    sizes = [(p, Files(spark, p).size(p)) for p in paths]
    df = spark.createDataFrame(sizes, "file string, size bigint")
    df = df.select("file", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("size") / chunk) - 1, F.lit(0)))).alias("no"))
    return df.select("file", F.col("no").cast("int").alias("no"), (F.col("no") * chunk).alias("start"), F.least((F.col("no") + 1) * chunk, "size").alias("stop"))


def _look(form: str):
    start = re.compile(STARTS[form])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for file, no, a, z in zip(f["file"], f["no"], f["start"], f["stop"]):
                system, at = file_at(file)
                with system.open_input_file(at) as src:
                    back = min(int(a), 2)
                    src.seek(int(a) - back)
                    raw = src.read(int(z - a) + back + BEYOND)
                inside = int(z - a) + back
                hit = next((m.start() for m in start.finditer(raw) if back <= m.start() < inside), None)
                section = last = data = None
                if form == "def":
                    for m in SECTION.finditer(raw):
                        if not back <= m.start() < inside:
                            continue
                        last = (m.group(1) or b"").decode()
                        if hit is None or m.start() < hit:
                            section = last
                        if m.group(1) and data is None:
                            data = int(a) - back + m.start()
                elif hit is not None:
                    data = int(a) - back + hit
                out.append((file, no, None if hit is None else int(a) - back + hit, section, last, data))
            yield pd.DataFrame(out, columns=["file", "no", "first", "section", "last", "data"]).astype({"first": "Int64", "data": "Int64"})

    return run


def plan(spark: SparkSession, paths: list[str], form: str, chunk: int) -> DataFrame:
    """(file, chunk, start, stop, head, section, whole): the chunks of every file; `head` bytes go in front of all but the first."""
    ranges = byte_ranges(spark, paths, chunk)
    seen = cut(ranges.repartition("file", "no").mapInPandas(_look(form), FOUND))
    by = Window.partitionBy("file")
    before = by.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    size = ranges.groupBy("file").agg(F.max("stop").alias("size"))
    p = seen.withColumn("head", F.min("data").over(by)).withColumn("section", F.coalesce("section", F.last("last", True).over(before), F.lit("")))
    p = p.withColumn("start", F.when(F.col("no") == 0, F.lit(0).cast("bigint")).when(F.col("first") > F.col("head"), F.col("first"))).where("start is not null").join(size, "file")
    stop = F.lead("start").over(by.orderBy("no"))
    return p.select("file", F.col("no").alias("chunk"), "start", F.coalesce(stop, "size").alias("stop"), F.coalesce("head", "size").alias("head"), "section", stop.isNull().alias("ends"))


def _parse(form: str):
    once = repeated(form)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for file, no, a, z, head, section, ends in zip(*(f[c] for c in ("file", "chunk", "start", "stop", "head", "section", "ends"))):
                system, at = file_at(file)
                with system.open_input_file(at) as src:
                    front = src.read(int(min(head, 1 << 30))) if a else b""
                    src.seek(int(a))
                    body = src.read(int(z - a))
                text = front.decode() + (f"\n{section} 1 ;\n" if a and section else "") + body.decode() + ("" if ends else TAIL[form])
                sniff(text, form, file)
                yield pd.DataFrame([(file, int(no), *r) for r in PARSERS[form](text) if not a or r[0] not in once], columns=["file", "chunk", "kind", "parent", "name", "attrs", "nums"])

    return run


def read_ranges(spark: SparkSession, paths: list[str], form: str, chunk: int = 64 << 20) -> DataFrame:
    """Construct rows of the files, as formats.parse gives them for each file as a whole."""
    chunks = plan(spark, paths, form, chunk)
    return chunks.repartition("file", "chunk").mapInPandas(_parse(form), ROWS)
