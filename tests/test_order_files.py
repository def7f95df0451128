"""Maker files: names, byte-order mark, order of lines, and what is left when a task fails."""

from __future__ import annotations

import csv
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfline.operators import exports
from shelfline.sources.order_files import MARK, OrderFiles

CELLS = [f"c{i + 1}" for i in range(20)]


def rows_of(spark, orders):
    rows = [(no, line, *[f'{no} "{line}"\n{i}' for i in range(20)]) for no, n in orders for line in range(n, 0, -1)]
    return spark.createDataFrame(rows, "order_no string, line_no int, " + ", ".join(f"{c} string" for c in CELLS)).repartition(5)


def test_every_order_has_a_file_of_its_own(spark, tmp_path):
    orders = [(f"{k:08d}", 1 + k % 4) for k in range(30)] + [("A/b c", 2)]
    exports.write_maker_files(rows_of(spark, orders), str(tmp_path / "out"))
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert files == sorted([f"{k:08d}.csv" for k in range(30)] + ["A-b-c.csv"])
    for no, n in orders:
        raw = (tmp_path / "out" / (no.replace("/", "-").replace(" ", "-") + ".csv")).read_bytes()
        assert raw.startswith(b"\xef\xbb\xbf") and MARK.encode() == raw[:3]
        read = list(csv.reader(raw.decode("utf-8-sig").splitlines(keepends=True)))
        assert tuple(read[0]) == exports.MAKER_HEADERS and len(read) == n + 1
        assert [r[0] for r in read[1:]] == [f'{no} "{line}"\n0' for line in range(1, n + 1)]


def test_names_that_are_there_are_refused_or_replaced(spark, tmp_path):
    path = str(tmp_path / "out")
    exports.write_maker_files(rows_of(spark, [("1", 1), ("2", 1)]), path)
    before = (tmp_path / "out" / "1.csv").read_bytes()
    with pytest.raises(Exception, match="there already"):
        exports.write_maker_files(rows_of(spark, [("1", 3), ("3", 1)]), path)
    assert sorted(p.name for p in Path(path).iterdir()) == ["1.csv", "2.csv"] and (tmp_path / "out" / "1.csv").read_bytes() == before
    exports.write_maker_files(rows_of(spark, [("3", 1)]), path, "overwrite")
    assert [p.name for p in Path(path).iterdir()] == ["3.csv"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(OrderFiles)
    bad = spark.range(20).select(F.when(F.col("id") == 19, F.lit("_x")).otherwise(F.concat(F.lit("f"), "id")).alias("file"), F.lit("line").alias("line")).repartitionByRange(4, "file")
    with pytest.raises(Exception, match="no name"):
        bad.write.format("orderfiles").mode("append").save(str(tmp_path / "out"))
    assert list((tmp_path / "out").iterdir()) == []
