"""Frontmatter: a small line format between fences, as an ordered list of key and value. Expressions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexer

_ENTRY = "struct<key: string, is_list: boolean, scalar: string, items: array<string>>"


def unquoted(value: Column) -> Column:
    return F.btrim(F.btrim(lexer.stripped(value), F.lit('"')), F.lit("'"))


def entries(raw: Column) -> Column:
    """Entries in order of each key's first line; of a repeated key the last value counts. None for a null.

    A value in brackets is a list, cut at every comma. A key without a value takes the "-" items of the indented lines
    below it; without such items its value is empty. Blank lines, comments and lines without a colon are passed over.
    """
    nothing = F.lit(None).cast("string")

    def step(acc: Column, line: Column) -> Column:
        text, key = lexer.stripped(line), lexer.stripped(F.substring_index(line, ":", 1))
        value = lexer.stripped(F.regexp_extract(line, "(?s)^[^:]*:(.*)$", 1))
        last = F.element_at(acc["out"], -1)
        more = F.struct(last["key"].alias("key"), last["is_list"].alias("is_list"), last["scalar"].alias("scalar"), F.concat(last["items"], F.array(unquoted(F.substring(text, 2, 1 << 30)))).alias("items"))
        bracket = value.startswith("[") & value.endswith("]") & (F.length(value) > 1)
        parts = F.filter(F.split(F.regexp_replace(value, r"^\[|\]$", ""), ",", -1), lambda v: lexer.stripped(v) != "")
        entry = F.struct(key.alias("key"), bracket.alias("is_list"), F.when(bracket, nothing).otherwise(unquoted(value)).alias("scalar"), F.when(bracket, F.transform(parts, unquoted)).otherwise(F.array().cast("array<string>")).alias("items"))
        inside = acc["open"] & line.rlike("^[ \t]")
        with_more = F.when(text.startswith("-"), F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(more))).otherwise(acc["out"])
        reads = (text != "") & ~text.startswith("#") & line.contains(":")
        out = F.when(inside, with_more).when(reads, F.concat(acc["out"], F.array(entry))).otherwise(acc["out"])
        return F.struct(out.alias("out"), (inside | reads & ~bracket & (value == "")).alias("open"))

    def finish(acc: Column) -> Column:
        def final(e: Column) -> Column:
            listed = e["is_list"] | (F.size(e["items"]) > 0)
            return F.struct(e["key"].alias("key"), listed.alias("is_list"), F.when(~listed, e["scalar"]).alias("scalar"), F.when(listed, e["items"]).alias("items"))

        keys = F.array_distinct(F.transform(acc["out"], lambda e: e["key"]))
        return F.transform(keys, lambda k: final(F.element_at(F.filter(acc["out"], lambda e: e["key"] == k), -1)))

    start = F.struct(F.array().cast(f"array<{_ENTRY}>").alias("out"), F.lit(False).alias("open"))
    return F.aggregate(F.coalesce(lexer.lines(raw), F.array().cast("array<string>")), start, step, finish)


def as_list(entry: Column) -> Column:
    """A value as a list: a scalar is cut at commas and white space, a leading # removed."""
    words = F.transform(F.split(entry["scalar"], r"[,\s]+"), lambda w: F.regexp_replace(w, "^#+", ""))
    return F.filter(F.when(entry["is_list"], entry["items"]).otherwise(words), lambda w: w != "")
