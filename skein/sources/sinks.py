"""Results as files in Spark's own formats, or as text for a terminal."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def save(df: DataFrame, path: str, fmt: str = "json") -> None:
    """json, csv, tsv or parquet."""
    out = df.write.mode("overwrite")
    if fmt == "json":
        out.json(path)
    elif fmt in ("csv", "tsv"):
        out.option("sep", "\t" if fmt == "tsv" else ",").option("header", True).csv(path)
    elif fmt == "parquet":
        out.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def text_rows(df: DataFrame, fmt: str = "text"):
    """Lines for a terminal, fetched partition by partition."""
    sep = {"csv": ",", "tsv": "\t"}.get(fmt, "  ")
    for r in df.toLocalIterator():
        yield json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str) if fmt == "json" else sep.join("" if v is None else str(v) for v in r)
