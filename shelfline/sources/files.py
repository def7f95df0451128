"""Order rows from CSV files: a heading row, then a row a line; UTF-8, or Shift_JIS where a file is not UTF-8."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def decoded(raw: bytes) -> str:
    """UTF-8, with or without a mark, else Shift_JIS; bytes that are neither become U+FFFD."""
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("cp932", "replace")


def order_csv(spark: SparkSession, path: str) -> DataFrame:
    """file_id (the file's path), row_idx (from 0, blank lines left out), fields (map of heading to text).

    Quoted cells may hold commas and line breaks. Missing cells are empty, cells without a heading are dropped, and a file
    without rows gives none. One file is one task's work, as a quoted line break can only be told from the file's start.
    """

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                rows = [r for r in csv.reader(io.StringIO(decoded(bytes(raw)))) if any(c.strip() for c in r)]
                heads = [h.strip() for h in rows[0]] if rows else []
                fields = [{h: (r[i] if i < len(r) else "") for i, h in enumerate(heads) if h} for r in rows[1:]]
                yield pd.DataFrame({"file_id": [name] * len(fields), "row_idx": range(len(fields)), "fields": fields})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parsed, "file_id string, row_idx long, fields map<string,string>")
