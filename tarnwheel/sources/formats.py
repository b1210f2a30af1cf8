"""Readers of four engineering text formats: LEF, DEF, Liberty and timing windows (TWF).

Each file, or each chunk of a large file, becomes rows of one shape: (file, chunk, kind, parent, name, attrs, nums).
The typed tables are selections from these rows, so they stay in the JVM. Broken records are counted in rows of kind
`bad`; unknown constructs in rows of kind `unknown`; neither stops a file. A file of another type raises at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "file string, chunk int, kind string, parent string, name string, attrs map<string,string>, nums array<double>"
Row = tuple[str, str | None, str | None, dict, list]

# Headers by which a file's type is known, after comments are taken away.
HEADERS = {"lef": r"\s*(VERSION|NAMESCASESENSITIVE|BUSBITCHARS|DIVIDERCHAR|UNITS|MANUFACTURINGGRID|LAYER|VIA|SITE|MACRO|PROPERTYDEFINITIONS)\b", "def": r"\s*(VERSION|DIVIDERCHAR|BUSBITCHARS|DESIGN|NAMESCASESENSITIVE)\b", "liberty": r"\s*library\s*\(", "twf": r"\s*\(\s*TIMING_WINDOWS\b"}


def uncommented(text: str, form: str) -> str:
    if form == "liberty":
        return re.sub(r"/\*.*?(?:\*/|$)|//[^\n]*", " ", text, flags=re.S)
    return re.sub(r"#[^\n]*", " ", text) if form in ("lef", "def") else text


def sniff(text: str, form: str, file: str = "") -> None:
    """Raises ValueError unless the text begins like a file of this type."""
    head = uncommented(text[: 1 << 20], form)
    if not re.match(HEADERS[form], head, re.I if form == "liberty" else 0):
        raise ValueError(f"{file or 'the text'} does not look like {form}: {head.strip()[:60]!r}")


def nm(v: str | float, per: float = 1000.0) -> int:
    """Whole units, halves away from zero."""
    x = float(v) * per
    return int(abs(x) + 0.5) * (1 if x >= 0 else -1)


# LEF


def lef(text: str) -> Iterator[Row]:
    """layer, via, macro, pin, rect (of a pin), obs and via_rect rows; lengths in thousandths of a micron."""
    tok = iter(re.findall(r'"[^"]*"|;|[^\s;]+', uncommented(text, "lef")))

    def statement(first: str) -> list[str]:
        out = [first]
        for t in tok:
            if t == ";":
                break
            out.append(t)
        return out

    for t in tok:
        if t == "LAYER":
            name, attrs, spacing = next(tok), {}, []
            for k in tok:
                if k == "END":
                    next(tok, None)
                    break
                s = statement(k)
                if k == "SPACING":
                    spacing.append(float(nm(s[1])))
                elif k in ("TYPE", "DIRECTION"):
                    attrs[k.lower()] = s[1]
                elif k in ("WIDTH", "PITCH"):
                    attrs[k.lower()] = str(nm(s[1]))
                elif k == "AREA":
                    attrs["area"] = str(nm(s[1], 1e6))
            yield "layer", None, name, attrs, spacing
        elif t == "VIA":
            name, layer = next(tok), None
            yield "via", None, name, {}, []
            for k in tok:
                if k == "DEFAULT":
                    continue
                if k == "END":
                    next(tok, None)
                    break
                s = statement(k)
                if k == "LAYER":
                    layer = s[1]
                elif k == "RECT":
                    yield "via_rect", name, layer, {}, [float(nm(v)) for v in s[1:5]]
        elif t == "MACRO":
            name, attrs, late = next(tok), {}, []
            for k in tok:
                if k == "END":
                    next(tok, None)
                    break
                if k == "PIN":
                    late += _lef_pin(name, next(tok), tok, statement)
                elif k == "OBS":
                    late += [("obs", name, layer, {}, r) for layer, r in _lef_shapes(tok, statement)]
                else:
                    s = statement(k)
                    if k == "SIZE":
                        attrs |= {"width": str(nm(s[1])), "height": str(nm(s[3]))}
                    elif k == "ORIGIN":
                        attrs |= {"origin_x": str(nm(s[1])), "origin_y": str(nm(s[2]))}
                    elif k == "CLASS":
                        attrs["class"] = " ".join(s[1:])
            yield "macro", None, name, attrs, []
            yield from late
        elif t == "UNITS":
            for k in tok:
                if k == "END":
                    next(tok, None)
                    break
        elif t == "END":
            next(tok, None)
        elif t != ";":
            statement(t)


def _lef_shapes(tok: Iterator[str], statement) -> Iterator[tuple[str | None, list[float]]]:
    layer = None
    for k in tok:
        if k == "END":
            return
        s = statement(k)
        if k == "LAYER":
            layer = s[1]
        elif k == "RECT":
            yield layer, [float(nm(v)) for v in s[1:] if re.match(r"[-+.\d]", v)][:4]
        elif k == "POLYGON":
            v = [float(nm(x)) for x in s[1:] if re.match(r"[-+.\d]", x)]
            yield layer, [min(v[::2]), min(v[1::2]), max(v[::2]), max(v[1::2])]


def _lef_pin(macro: str, pin: str, tok: Iterator[str], statement) -> list[Row]:
    attrs, shapes = {}, []
    for k in tok:
        if k == "END":
            next(tok, None)
            break
        if k == "PORT":
            shapes += list(_lef_shapes(tok, statement))
        else:
            s = statement(k)
            if k in ("DIRECTION", "USE"):
                attrs[k.lower()] = s[1]
    return [("pin", macro, pin, attrs, []), *(("rect", f"{macro}/{pin}", layer, {}, r) for layer, r in shapes)]


# DEF


def def_(text: str) -> Iterator[Row]:
    """design, component, port, net, conn, wire, net_rect, net_via, via and blockage rows; lengths in thousandths of a micron."""
    units, section = 1000.0, None
    scale = lambda v: float(nm(v, 1000.0 / units))
    for raw in uncommented(text, "def").split(";"):
        s = re.findall(r'"[^"]*"|[()]|[^\s()]+', raw)
        while s[:1] == ["END"] and len(s) > 1:
            section, s = None, s[2:]
        if not s:
            continue
        if s[0] == "-":
            if section == "COMPONENTS" and len(s) > 2:
                a: dict[str, str] = {"master": s[2], "status": "UNPLACED"}
                at: list[float] = []
                for i, w in enumerate(s):
                    if w in ("PLACED", "FIXED", "COVER") and s[i + 1 : i + 2] == ["("]:
                        a |= {"status": w, "orient": s[i + 5]}
                        at = [scale(s[i + 2]), scale(s[i + 3])]
                yield "component", None, s[1], a, at
            elif section == "PINS":
                a = {k.lower(): s[s.index(k) + 1] for k in ("NET", "DIRECTION", "USE") if k in s}
                yield "port", None, s[1], a, []
            elif section in ("NETS", "SPECIALNETS"):
                yield from _def_net(s, section == "SPECIALNETS", scale)
            elif section == "VIAS":
                yield "via", None, s[1], {}, []
                for i, w in enumerate(s):
                    if w == "RECT":
                        v = [x for x in s[i + 2 : i + 12] if x not in "()"][:4]
                        yield "via_rect", s[1], s[i + 1], {}, [scale(x) for x in v]
            elif section == "BLOCKAGES":
                for i, w in enumerate(s):
                    if w == "RECT":
                        v = [x for x in s[i + 1 : i + 11] if x not in "()"][:4]
                        yield "blockage", None, s[2] if s[1] == "LAYER" else None, {}, [scale(x) for x in v]
            else:
                yield "unknown", section, s[1] if len(s) > 1 else None, {}, []
        elif s[0] in ("COMPONENTS", "PINS", "NETS", "SPECIALNETS", "VIAS", "BLOCKAGES") and len(s) == 2:
            section = s[0]
        elif s[0] == "UNITS":
            units = float(s[-1])
        elif s[0] == "DESIGN":
            yield "design", None, s[1], {}, []
        elif s[0] == "DIEAREA":
            v = [scale(x) for x in s[1:] if x not in "()"]
            yield "diearea", None, None, {}, [min(v[::2]), min(v[1::2]), max(v[::2]), max(v[1::2])]


def _def_net(s: list[str], special: bool, scale) -> Iterator[Row]:
    name, use = s[1], s[s.index("USE") + 1] if "USE" in s else "SIGNAL"
    yield "net", None, name, {"use": use, "special": str(special).lower()}, []
    i = 2
    while s[i : i + 1] == ["("]:
        yield "conn", name, s[i + 2], {"instance": s[i + 1]}, []
        i = s.index(")", i) + 1
    last: list[float] = []
    while i < len(s):
        w = s[i]
        if w in ("ROUTED", "FIXED", "COVER", "NEW") and i + 1 < len(s):
            layer, width, i = s[i + 1], None, i + 2
            if i < len(s) and re.fullmatch(r"[\d.]+", s[i]):
                width, i = scale(s[i]), i + 1
            pts: list[float] = []
            last = []
            while i < len(s) and s[i] not in ("NEW", "+"):
                if s[i] == "(":
                    v, i = s[i + 1 : s.index(")", i)], s.index(")", i) + 1
                    last = [last[0] if v[0] == "*" else scale(v[0]), last[1] if v[1] == "*" else scale(v[1])]
                    pts += last
                else:
                    yield "net_via", name, s[i], {}, list(last)
                    i += 1
            yield "wire", name, layer, {} if width is None else {"width": str(int(width))}, pts
        elif w == "RECT":
            v = [x for x in s[i + 2 : i + 10] if x not in "()"][:4]
            yield "net_rect", name, s[i + 1], {}, [scale(x) for x in v]
            i += 10
        elif w == "VIA":
            v = [x for x in s[i + 2 : i + 6] if x not in "()"][:2]
            yield "net_via", name, s[i + 1], {}, [scale(x) for x in v]
            i += 6
        else:
            i += 1


# Liberty

GROUPS = {"library", "cell", "pin", "timing", "internal_power", "lu_table_template", "power_lut_template", "ff", "latch", "pg_pin", "bus", "bundle", "leakage_power"}


def liberty(text: str) -> Iterator[Row]:
    """A row for each group (kind: its type, parent: the path of names above) with its attributes; tables have their values in nums, axes in attrs. Unknown groups are `unknown` rows."""
    tok = re.findall(r'"(?:[^"\\]|\\.)*"|[{}();:,]|[^\s{}();:,"]+', uncommented(text, "liberty").replace("\\\n", " "))
    i = 0

    def args() -> list[str]:
        nonlocal i
        out = []
        i += 1
        while i < len(tok) and tok[i] != ")":
            if tok[i] != ",":
                out.append(tok[i].strip('"'))
            i += 1
        i += 1
        return out

    def body(kind: str, name: str, parent: str) -> Iterator[Row]:
        nonlocal i
        attrs, nums, late = {}, [], []
        seen: dict[str, int] = {}
        while i < len(tok) and tok[i] != "}":
            k = tok[i]
            if k == ";":
                i += 1
            elif tok[i + 1 : i + 2] == [":"]:
                i += 2
                v = []
                while i < len(tok) and tok[i] not in (";", "}"):
                    v.append(tok[i].strip('"'))
                    i += 1
                attrs[k] = " ".join(v)
            elif tok[i + 1 : i + 2] == ["("]:
                i += 1
                a = args()
                if tok[i : i + 1] == ["{"]:
                    i += 1
                    seen[k] = seen.get(k, 0) + 1
                    here = a[0] if a else f"{k}{seen[k]}"
                    late += list(body(k, here, f"{parent}/{name}" if parent else name))
                    i += 1
                elif k == "values":
                    nums += [float(x) for v in a for x in re.split(r"[,\s]+", v.strip()) if x]
                else:
                    attrs[k] = ", ".join(a)
            else:
                i += 1
        table = bool(nums) or "index_1" in attrs and kind not in GROUPS
        yield (kind if kind in GROUPS else "table" if table else "unknown"), parent, name if kind in GROUPS else kind, attrs | ({} if kind in GROUPS else {"group": name}), nums
        yield from late

    while i < len(tok):
        if tok[i] == "library" and tok[i + 1 : i + 2] == ["("]:
            i += 1
            a = args()
            i += 1
            yield from body("library", a[0] if a else "", "")
        i += 1


# timing windows

FIELD = re.compile(r"\*|[-+]?[\d.]+(?:[eE][-+]?\d+)?(?::[-+]?[\d.]+(?:[eE][-+]?\d+)?)?")
WINDOWS = ("rise_arrival", "rise_slew", "rise_drive", "rise_sink", "fall_arrival", "fall_slew", "fall_drive", "fall_sink")


def twf(text: str) -> Iterator[Row]:
    """waveform and entry rows, times in nanoseconds; records with a wrong number or form of fields are `bad`, unknown kinds `unknown`."""
    m = re.search(r"\(TIME_SCALE\s+([-+.\deE]+)\)", text)
    k = (float(m.group(1)) if m else 1e-9) * 1e9
    clocks = set()
    for w in re.finditer(r'\(WAVEFORM\s+"([^"]*)"\s+([-+.\deE]+)\s+\(POSEDGE\s+([-+.\deE]+)\)\s+\(NEGEDGE\s+([-+.\deE]+)\)', text):
        clocks.add(w.group(1))
        yield "waveform", None, w.group(1), {}, [float(v) * k for v in w.groups()[1:]]
    tok = re.finditer(r'"[^"]*"|[()]|[^\s()"]+', text)
    clock, depth, rec = None, 0, None
    for t in tok:
        w = t.group()
        if w == "(":
            depth += 1
            if depth == 3 and clock is not None:
                rec = []
            elif depth == 2:
                clock, rec = None, None
                head = []
        elif w == ")":
            if depth == 3 and rec is not None:
                yield _twf_record(rec, clock, clocks, k)
                rec = None
            depth -= 1
            if depth == 1:
                clock = None
        elif rec is not None:
            rec.append(w)
        elif depth == 2:
            head.append(w)
            if len(head) == 2 and head[0] == "CAUSED_BY":
                clock = "" if head[1] == "NULL" else head[1].strip('"')


def _twf_record(rec: list[str], clock: str, clocks: set[str], k: float) -> Row:
    kind = rec[0] if rec else ""
    attrs = {"clock": clock} if clock and clock in clocks else {"missing_clock": clock} if clock else {}
    if kind not in ("NET", "PIN", "CONSTANT"):
        return "unknown", None, kind, {}, []
    if "CONSTANT" in rec[:2]:
        name = rec[-1].strip('"')
        return "entry", None, _plain(name), attrs | {"type": "NET" if kind == "CONSTANT" else kind, "constant": "true"}, []
    name, f = _plain(rec[1].strip('"')) if len(rec) > 1 else "", rec[2:]
    if not 8 <= len(f) <= 9 or not all(FIELD.fullmatch(x) for x in f[:8]) or f[8:] and f[8] not in ("C", "D"):
        return "bad", None, name, {}, []
    for n, x in zip(WINDOWS, f):
        if x != "*":
            v = [float(y) * k for y in x.split(":")]
            attrs |= {n + "_min": repr(v[0]), n + "_max": repr(v[-1])}
    return "entry", None, name, attrs | {"type": kind, **({"end": f[8]} if f[8:] else {})}, []


def _plain(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


PARSERS = {"lef": lef, "def": def_, "liberty": liberty, "twf": twf}

# chunks of large files


def plan_chunks(text: str, form: str, size: int) -> tuple[int, list[tuple[int, int]]]:
    """(end of the head, [start, end) of each chunk): cuts lie at ends of top-level constructs, after at least `size` characters.

    The head (all before the first data construct) goes in front of every chunk. TWF is cut between CAUSED_BY
    groups, Liberty between cells, LEF between macros, DEF between statements of its component and net sections.
    """
    if form == "twf":
        starts = [m.start() for m in re.finditer(r"\(CAUSED_BY\b", text)]
        stop = text.rstrip().rfind(")") if starts else len(text)
    elif form == "liberty":
        starts = [m.start() for m in re.finditer(r"\bcell\s*\([^)]*\)\s*\{", text)]
        stop = text.rstrip().rfind("}") if starts else len(text)
    elif form == "lef":
        starts, stop = [m.start() for m in re.finditer(r"^\s*MACRO\s", text, re.M)], len(text)
    else:
        starts, stop = [m.start() for m in re.finditer(r"^\s*(?:COMPONENTS|PINS|NETS|SPECIALNETS|BLOCKAGES)\s+\d+\s*;", text, re.M)], len(text)
    if not starts:
        return len(text), [(len(text), len(text))]
    cuts = [starts[0]]
    for a in starts[1:]:
        if a - cuts[-1] >= size:
            cuts.append(a)
    return starts[0], list(zip(cuts, [*cuts[1:], stop]))


TAIL = {"twf": ")", "liberty": "}", "lef": "", "def": ""}


def split_texts(df: DataFrame, form: str, size: int) -> DataFrame:
    """(file, text) -> (file, chunk, text): each text in chunks that parse on their own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for file, text in zip(f["file"], f["text"]):
                sniff(text, form, file)
                head, parts = plan_chunks(text, form, size)
                out += [(file, i, text[:head] + text[a:z] + (TAIL[form] if z > a else "")) for i, (a, z) in enumerate(parts)]
            yield pd.DataFrame(out, columns=["file", "chunk", "text"])

    return df.select("file", "text").mapInPandas(run, "file string, chunk int, text string")


def repeated(form: str) -> tuple[str, ...]:
    """Kinds of rows that the head of a file makes."""
    return {"twf": ("waveform",), "liberty": ("library", "lu_table_template", "power_lut_template"), "lef": ("layer", "via", "via_rect"), "def": ("design", "diearea", "via", "via_rect")}[form]


def parse(df: DataFrame, form: str) -> DataFrame:
    """(file, [chunk,] text) -> construct rows. Rows that a repeated head makes come from chunk 0 only."""
    heads = repeated(form)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            chunk = f["chunk"] if "chunk" in f else pd.Series(0, f.index)
            out = []
            for file, c, text in zip(f["file"], chunk, f["text"]):
                sniff(text, form, file)
                out += [(file, int(c), *r) for r in PARSERS[form](text) if not c or r[0] not in heads]
            yield pd.DataFrame(out, columns=["file", "chunk", "kind", "parent", "name", "attrs", "nums"])

    return df.mapInPandas(run, ROWS)


def parser(form: str):
    """A Python table function (text) -> (kind, parent, name, attrs, nums), for LATERAL joins with a table of texts."""
    rows = PARSERS[form]

    @F.udtf(returnType="kind string, parent string, name string, attrs map<string,string>, nums array<double>")
    class Parser:
        def eval(self, text: str):
            if text is not None:
                yield from rows(text)

    return Parser


# typed tables


def find(rows: DataFrame, kind: str, name: str) -> DataFrame:
    """The rows of a construct by kind and name: a cell, a table template, a macro."""
    return rows.where((F.col("kind") == kind) & (F.col("name") == name))


def attr(name: str, kind: str = "string"):
    return F.col("attrs")[name].try_cast(kind).alias(name)


def macros(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'macro'").select("file", "name", attr("class"), attr("width", "bigint"), attr("height", "bigint"), attr("origin_x", "bigint"), attr("origin_y", "bigint"))


def pins(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'pin'").select("file", F.col("parent").alias("macro"), "name", attr("direction"), attr("use"), attr("capacitance", "double"))


def boxes(rows: DataFrame, kind: str = "rect") -> DataFrame:
    return rows.where(F.col("kind") == kind).select("file", "parent", F.col("name").alias("layer"), *(F.get("nums", F.lit(i)).cast("bigint").alias(n) for i, n in enumerate(("xl", "yl", "xh", "yh"))))


def components(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'component'").select("file", "name", attr("master"), attr("status"), attr("orient"), F.get("nums", F.lit(0)).cast("bigint").alias("x"), F.get("nums", F.lit(1)).cast("bigint").alias("y"))


def connections(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'conn'").select("file", F.col("parent").alias("net"), attr("instance"), F.col("name").alias("pin"))


def cells(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'cell'").select("file", "name", attr("area", "double"))


def tables(rows: DataFrame) -> DataFrame:
    axis = lambda n: F.transform(F.split(F.trim(F.col("attrs")[n]), r"[,\s]+"), lambda x: x.try_cast("double")).alias(n)
    return rows.where("kind = 'table'").select("file", "parent", "name", F.col("attrs")["group"].alias("template"), axis("index_1"), axis("index_2"), F.col("nums").alias("values"))


def entries(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'entry'").select("file", "name", attr("type"), attr("clock"), attr("missing_clock"), attr("constant", "boolean"), attr("end"), *(attr(f"{w}_{s}", "double") for w in ("rise_arrival", "fall_arrival", "rise_slew", "fall_slew") for s in ("min", "max")))


def waveforms(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'waveform'").select("file", "name", *(F.get("nums", F.lit(i)).alias(n) for i, n in enumerate(("period", "posedge", "negedge"))))
