"""Saves of order files: what each outcome leaves, and that tables change together or not at all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfline.operators import saves
from shelfline.sources import manifests

FILES = [("f1", "C", "S", "new.pdf", "p/1", "op", 1), ("f2", "C", "S", "locked.pdf", "p/2", "op", 2), ("f3", "C", "S", "gone.pdf", None, "op", 3), ("f4", "D", "S", "other.pdf", None, "op", 4), ("f5", "C", "S", "again.pdf", None, "op", 5)]
ORDERS = [("f1", "n1", "100"), ("f1", "n2", "200"), ("f2", "n3", "300"), ("f2", "n4", "400"), ("f3", "n5", "300"), ("f4", "n6", "300"), ("f5", "n7", "200")]
LINES = [("n1", 1, "a"), ("n2", 1, "b"), ("n3", 1, "c"), ("n6", 1, "d"), ("n7", 1, "e"), ("n7", 2, "f")]
CURRENT = [("o1", "C", "S", "100", "imported", "x.pdf", "p/0"), ("o3", "C", "S", "300", "confirmed", "y.pdf", None), ("o9", "C", "S", "900", "shipped", "z.pdf", None)]


@pytest.fixture(scope="module")
def tables(spark):
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    return (
        frame(FILES, "file_id string, client_id string, supplier_id string, file_name string, path string, operator_name string, at int"),
        frame(ORDERS, "file_id string, id string, order_no string"),
        frame(LINES, "order_id string, line_no int, jan string"),
        frame(CURRENT, "id string, client_id string, supplier_id string, order_no string, status string, source_file string, source_file_path string"),
        frame([("o1", 1, "old"), ("o3", 1, "kept")], "order_id string, line_no int, jan string"),
        frame([], "client_id string, supplier_id string, file_name string, status string, file_storage_path string, operator_name string, imported_at int"),
    )


def test_what_each_outcome_leaves(tables):
    got = {k: [tuple(r) for r in df.collect()] for k, df in saves.saved(*tables).items()}
    assert {r.file_id: r.outcome for r in saves.outcomes(tables[0], tables[1], tables[3]).collect()} == {"f1": "saved", "f2": "attached", "f3": "refused", "f4": "saved", "f5": "saved"}
    assert sorted(got["orders"]) == [
        ("n6", "D", "S", "300", "imported", "other.pdf", None),
        ("n7", "C", "S", "200", "imported", "again.pdf", None),
        ("o1", "C", "S", "100", "imported", "new.pdf", "p/1"),
        ("o3", "C", "S", "300", "confirmed", "locked.pdf", "p/2"),
        ("o9", "C", "S", "900", "shipped", "z.pdf", None),
    ]
    assert sorted(got["order_lines"]) == [("n6", 1, "d"), ("n7", 1, "e"), ("n7", 2, "f"), ("o1", 1, "a"), ("o3", 1, "kept")]
    assert sorted(b[2] for b in got["import_batches"]) == ["again.pdf", "locked.pdf", "new.pdf", "other.pdf"]


def test_tables_change_together_or_not_at_all(spark, tables, tmp_path):
    root = f"file://{tmp_path}/db"
    assert manifests.version(spark, root) == 0
    first = manifests.publish(spark, root, {"orders": tables[3], "order_lines": tables[4], "import_batches": tables[5]}, 0)
    assert first == 1 and manifests.tables(spark, root)["orders"]["rows"] == 3
    after = saves.saved(*tables[:3], *[manifests.read(spark, root, n) for n in ("orders", "order_lines", "import_batches")])
    broken = after["import_batches"].withColumn("status", F.when(F.col("file_name") == "new.pdf", F.raise_error(F.lit("lost"))).otherwise(F.col("status")))
    with pytest.raises(Exception, match="lost"):
        manifests.publish(spark, root, after | {"import_batches": broken}, 1)
    assert manifests.version(spark, root) == 1 and sorted(r.order_no for r in manifests.read(spark, root, "orders").collect()) == ["100", "300", "900"]
    assert manifests.publish(spark, root, after, 1) == 2
    assert {k: v["rows"] for k, v in manifests.tables(spark, root).items()} == {"orders": 5, "order_lines": 5, "import_batches": 4}
    with pytest.raises(manifests.Outdated):
        manifests.publish(spark, root, {"orders": tables[3]}, 1)
    assert manifests.publish(spark, root, {"orders": tables[3]}, 2) == 3 and manifests.tables(spark, root)["order_lines"]["rows"] == 5
    assert manifests.read(spark, root, "orders", 2).count() == 5


def test_of_two_saves_of_one_version_one_is_published(spark, tables, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/db"
    manifests.publish(spark, root, {"orders": tables[3]}, 0)
    monkeypatch.setattr(manifests, "version", lambda *_: 0)  # the second save looked before the first was done
    with pytest.raises(manifests.Outdated):
        manifests.publish(spark, root, {"orders": tables[3].limit(1)}, 0)
    monkeypatch.undo()
    assert manifests.read(spark, root, "orders").count() == 3
