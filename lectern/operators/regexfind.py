"""Regex find and replace over texts with attributes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrays import running

#: Characters of context on either side of a match.
CONTEXT = 75


def slop_pattern(terms: str, slop: int) -> str:
    """A pattern in which up to slop words may stand between the terms; Unicode word rules."""
    return "(?U)" + (r"\b\W+(?:[\w\"]+\W+){0,%d}" % slop).join(terms.split())


def literal(text: str) -> str:
    """A pattern that matches just this text."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def find_all(texts: DataFrame, pattern: str, id: str = "id", text: str = "text", context: int = CONTEXT) -> DataFrame:
    """(id, start, length, match, snippet): all matches, `^` and `$` at line ends; positions in code points.

    Java's matches lie between the pieces of a split, so positions follow from lengths and no Python runs.
    """
    p = f"(?m){pattern}"
    t = F.col("t")
    rows = texts.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).where(t.rlike(p))
    # A row's matches are placed and cut while they are an array, so the text isn't copied to each of them.
    pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(p), F.lit(0)).alias("m"), F.split(t, p, -1).alias("gap"))

    def step(at: Column, x: Column) -> Column:
        start = at + F.length(x["gap"])
        return F.struct((start + F.length(x["m"])).alias("state"), F.struct(start.alias("start"), F.length(x["m"]).alias("length"), x["m"].alias("match")).alias("out"))

    placed = running(F.filter(pairs, lambda x: x["m"].isNotNull()), 0, step, "struct<start:int,length:int,match:string>")
    rows = rows.select("id", "t", F.filter(placed, lambda x: x["length"] > 0).alias("found"))

    def cut(x: Column) -> Column:
        before = F.substring(t, F.greatest(F.lit(1), x["start"] + 1 - context), F.least(x["start"], F.lit(context)))
        snippet = F.concat(before, F.lit("<b>"), x["match"], F.lit("</b>"), F.substring(t, x["start"] + x["length"] + 1, F.lit(context)))
        return F.struct(x["start"].alias("start"), x["length"].alias("length"), x["match"].alias("match"), snippet.alias("snippet"))

    return rows.select(F.col("id").alias(id), F.inline(F.transform("found", cut)))


def find_offsets(texts: DataFrame, pattern: str, id: str = "id", text: str = "text") -> DataFrame:
    """The same positions from Python's regex rules, for patterns that may match nothing between others."""
    kind = dict(texts.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = re.compile(pattern, re.M)
        for b in batches:
            rows = [(i, m.start(), m.end() - m.start(), m.group()) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in compiled.finditer(t or "")]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            types = (b.schema.field(0).type, pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "start", "length", "match"])

    return texts.select(F.col(id).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, start int, length int, match string").withColumnRenamed("id", id)


def scope(found: DataFrame, mode: str, at: int = 0, until: int | None = None) -> DataFrame:
    """Matches of the whole text, from a position on, up to it, or within a selection."""
    start = F.col("start")
    test = {"all": F.lit(True), "forward": start >= at, "back": start + F.col("length") <= at, "selection": (start >= at) & (start + F.col("length") <= F.lit(until))}[mode]
    return found.where(test)


def neighbour(found: DataFrame, at: int, id: str = "id") -> DataFrame:
    """Per text the next and previous start from a position, wrapping around."""
    s = F.col("start")
    nxt, prev = F.min(F.when(s > at, s)), F.max(F.when(s < at, s))
    return found.groupBy(id).agg(F.coalesce(nxt, F.min("start")).alias("next"), F.coalesce(prev, F.max("start")).alias("previous"))


def replace_all(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, f"(?m){pattern}", replacement)


def replace_first(c: Column, pattern: str, replacement: str) -> Column:
    """Only the first match; in the replacement $0 is the match, $1 to $9 are its groups, and a backslash takes the next character as it is.

    The text before the match is what is left once the match and all after it go, the groups come from the pattern as it
    is, so its own numbers, back-references and looks around hold. An unknown group is an error, as in replace_all.
    """
    p = f"(?m){pattern}"
    before = F.regexp_replace(c, f"(?m)(?:{pattern})(?s:.*)", "")
    match = F.regexp_extract(c, p, 0)
    parts: list[Column] = []
    for escaped, group, plain in re.findall(r"\\(.)|\$(\d)|([^\\$]+)", replacement, re.S):
        parts.append(F.regexp_extract(c, p, int(group)) if group else F.lit(escaped or plain))
    after = F.substring(c, F.length(before) + F.length(match) + 1, F.length(c))
    return F.when(c.rlike(p), F.concat(before, *parts, after)).otherwise(c)


def format_matches(**wanted: object) -> Column:
    """Attributes of a run against wanted ones; None is not tested.

    A flag (bold, italic) is true if either direction's attribute is set and false only if neither is; other flags
    compare as they are; size is within 0.01 and font equal in either direction's; style and colour are equal.
    """
    out = F.lit(True)
    for name, value in wanted.items():
        if value is None:
            continue
        if name in ("bold", "italic"):
            on = (F.col(name) != 0) | (F.col(f"{name}_bi") != 0)
            test = on if value else ~on
        elif name in ("underline", "superscript", "subscript"):
            test = (F.col(name) != 0) == F.lit(bool(value))
        elif name == "size":
            test = (F.abs(F.col("size") - F.lit(value)) < 0.01) | (F.abs(F.col("size_bi") - F.lit(value)) < 0.01)
        elif name == "font":
            test = (F.col("font") == value) | (F.col("font_bi") == value)
        else:
            test = F.col(name) == value
        out = out & F.coalesce(test, F.lit(False))
    return out


def assign_format(runs: DataFrame, **new: object) -> DataFrame:
    """Sets the attributes that are given and leaves the others."""
    return runs.withColumns({k: F.lit(v).cast(runs.schema[k].dataType) for k, v in new.items() if v is not None})
