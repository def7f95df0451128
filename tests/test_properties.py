"""Hand-made cases, properties, sinks and the stream."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shelfline.functions import text as tx
from shelfline.operators import cells, destinations, documents, imports, introductions, lifecycle, matching, pages, pricing, sinks
from shelfline.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_golden_amounts(spark):
    """The worked sample: doubles give 5855 where exact arithmetic gives 5856."""
    rows = spark.createDataFrame([("4900000000011", 12, 1800.0, 3780.0), ("4900000000028", 6, 1200.0, 2800.0)], "jan string, qty int, w double, r double")
    got = rows.select(F.floor(F.col("w") * F.col("qty")).alias("amount"), pricing.payout_amount(F.col("r"), F.col("qty"), pricing.payout_rate(F.col("w"), F.col("r")), F.lit(0.08)).alias("payout")).collect()
    assert [(r.amount, r.payout) for r in got] == [(21600, 17971), (7200, 5855)]
    lines = rows.select("qty", F.col("w").alias("unit_price_snapshot"), F.col("r").alias("retail_price_snapshot"), F.lit(0.08).alias("fbp_fee_rate_snapshot"), F.lit(1).alias("payout_amount"))
    assert lifecycle.payout_totals(lines).first().payout_total == 23827
    assert one(spark, pricing.payout_amount(F.lit(1025.0), F.lit(91), F.lit(0.08), F.lit(0.08))) is None


def test_text_rules(spark):
    assert one(spark, tx.trim(F.lit("　 a b "))) == "a b"
    assert one(spark, tx.match_key(F.lit("入荷先：**ＬＯＦＴ・渋谷（本店） ¥1,200 x"))) in ("**loft渋谷本店", "loft渋谷本店")
    assert one(spark, tx.order_number(F.lit("123"))) == "00000123" and one(spark, tx.order_number(F.lit("123456789"))) == "123456789" and one(spark, tx.order_number(F.lit("ORD-1001"))) == "ORD-1001"
    assert one(spark, tx.split_address(F.lit("東京都港区1-2-3"))) == ["東京都港区", "1-2-3", ""]
    assert one(spark, tx.split_address(F.lit("100-0001\n大阪府大阪市\n北区1\nビル 2"))) == ["大阪府大阪市", "北区1", "ビル 2"]
    assert one(spark, tx.split_address(F.lit("100-0001 北海道虻田郡倶知安町1-1"))) == ["北海道虻田郡倶知安町", "1-1", ""]
    assert one(spark, tx.tax_rate(F.lit("8"))) == 0.08 and one(spark, tx.money(F.lit("1,200円"))) == 1200 and one(spark, tx.whole_number(F.lit("1.5"))) is None
    assert one(spark, tx.month_label(F.lit(""), F.lit("2024-03-31"))) == "2024年3月" and one(spark, tx.month_label(F.lit(None).cast("string"), F.lit(""))) == "不明"
    assert one(spark, pricing.half_up(F.lit(-2.5))) == -2
    assert one(spark, imports.to_day(F.lit("2024年3月5日"))) == dt.date(2024, 3, 5) == one(spark, imports.to_day(F.lit("20240305"))) and one(spark, imports.to_day(F.lit("2024/13/5"))) is None
    assert one(spark, tx.located_address(F.lit("100-0001"), F.lit("100-0001 1000001 東京"))) == "100-0001 東京"


def test_name_keys(spark):
    got = one(spark, matching.name_keys(F.lit("コスメロフト渋谷店")))
    assert got[0] == "コスメロフト渋谷店" and {"渋谷店", "渋谷", "コスメロフト渋谷"} <= set(got)
    assert one(spark, matching.name_keys(F.lit(""))) == []


def test_empty_tables(spark):
    none = spark.createDataFrame([], "file_id string, sheet_name string, row_idx int, col_idx int, value string")
    assert cells.row_list(none).count() == cells.matrix(none).count() == cells.profile(none, [("a", ["b"])]).count() == 0
    docs = spark.createDataFrame([("f", None), ("g", "")], "file_id string, text string")
    good, bad = documents.order_rows(docs)
    assert good.count() == 0
    html = spark.createDataFrame([(1, None), (2, "")], "page_id int, html string")
    assert all(f(html).count() == 0 for f in (pages.json_ld, pages.boxes, pages.items, pages.links))


def test_fill_down_and_gap(spark):
    rows = spark.createDataFrame([("f", "s", i, 0, v) for i, v in enumerate(["", "a", "", "b", None, ""])], "file_id string, sheet_name string, row_idx int, col_idx int, value string")
    assert [r.value for r in cells.fill_down(rows, 0).orderBy("row_idx").collect()] == [None, "a", "a", "b", "b", "b"]
    kept = cells.until_gap(rows, F.coalesce(F.col("value"), F.lit("")) != "")
    assert [r.row_idx for r in kept.orderBy("row_idx").collect()] == [1]


def test_equal_lines_of_a_document_count_once(spark):
    text = "発注番号 A-1\n発注日 2024/1/2\n納期 2024/1/5\n納品先 店\n4900000000011 品 3\n4900000000011 品 3\n4900000000028\nx\n6個\n"
    good, bad = documents.order_rows(spark.createDataFrame([("f", text), ("g", "発注番号 A-2")], "file_id string, text string"))
    assert sorted((r.jan, r.qty) for r in good.collect()) == [("4900000000011", 3), ("4900000000028", 6)]
    assert bad.first().missing == "order_date,arrival_due_date,ship_to_name,items"


def test_a_wrong_postal_code_speaks_against_a_destination(spark):
    dest = spark.createDataFrame([("100-0001", "東京物流センター", "100-0001", "東京都港区1-2-3", "03-1111-2222", [])], "code string, name string, postal_code string, address string, tel string, aliases array<string>")
    docs = spark.createDataFrame([(1, "〒100-0001 東京都港区1-2-3", "", ""), (2, "〒100-0001 札幌市", "", ""), (3, "〒999-9999 東京都港区1-2-3", "1000001", ""), (4, None, None, None)], "doc_id int, text string, code string, center_name string")
    got = {r.doc_id: (r.code, r.method) for r in destinations.resolve(docs, dest).collect()}
    assert got == {1: ("100-0001", "code"), 2: (None, "none"), 3: (None, "none"), 4: (None, "none")}


def test_one_bad_row_blocks_its_file(spark):
    mapping = imports.mapping_of("anything:x")
    rows = [("f", i, no, "2024/1/2", "2024/1/3", "店", "30", "4900000000011", q) for i, (no, q) in enumerate([("1", "2"), ("1", "0"), ("2", "1.5")])] + [("g", 0, "3", "2024/1/2", "2024/1/3", "店", "42", "4900000000011", " 4 ")]
    df = spark.createDataFrame(rows, "file_id string, row_idx int, `発注No` string, `発注日` string, `着荷指定日` string, `お届け先会社名` string, `倉庫` string, `JANコード` string, `数量` string")
    norm = imports.normalise(df, mapping)
    faults = imports.errors(norm)
    assert sorted((r.file_id, r.row_number) for r in faults.collect()) == [("f", 3), ("f", 4)]
    headers, lines = imports.drafts(norm)
    assert [(r.order_no, r.warehouse) for r in headers.collect()] == [("3", "埼玉センター(No.42)")] and lines.first().qty == 4


def test_confirm_then_undo_restores_lines(spark):
    orders = spark.createDataFrame([("o", "C", "1", dt.date(2024, 1, 1), dt.date(2024, 1, 4), "imported", "s")], "id string, client_id string, order_no string, order_date date, arrival_due_date date, status string, store_name string")
    lines = spark.createDataFrame([("o", 1, "j", 2)], "order_id string, line_no int, jan string, qty int")
    products = spark.createDataFrame([("C", "j", "n", 100.0, 200.0)], "client_id string, jan string, name string, wholesale_price double, retail_price double")
    clients = spark.createDataFrame([("C", "c", None)], "id string, name string, fbp_fee_rate double")
    done, refused = lifecycle.confirm(orders, lines, products, clients)
    assert refused.count() == 0 and done.first().payout_amount == 168
    _, back = lifecycle.undo_confirm(orders.withColumn("status", F.lit("confirmed")), done)
    assert back.select("order_id", "line_no", "jan", "qty").collect() == lines.collect() and back.first().amount is None


def test_dedupe_is_idempotent_and_blind_to_row_order(spark):
    rows = [("i", "j", "c", f"n{k % 3}", k % 2 == 0, k) for k in range(30)]
    schema = "import_id string, jan string, store_code string, store_name string, is_introduced boolean, ord int"
    a = introductions.dedupe(spark.createDataFrame(rows, schema))
    b = introductions.dedupe(introductions.dedupe(spark.createDataFrame(rows[::-1], schema).repartition(7)))
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 3


def test_sinks(spark, tmp_path):
    root = str(tmp_path)
    entries = spark.createDataFrame([("a", 1), ("b", 2)], "import_id string, qty int")
    entries.where("import_id = 'b'").write.partitionBy("import_id").parquet(f"{root}/x/entries")
    sinks.append_import(entries.where("import_id = 'a'"), spark.createDataFrame([("a",)], "import_id string"), f"{root}/x")
    assert [r.qty for r in sinks.read_imports(spark, f"{root}/x")[1].collect()] == [1]
    stores = spark.createDataFrame([("1", "A"), ("2", "B")], "store_code string, chain_name string")
    stores.write.partitionBy("chain_name").parquet(f"{root}/s")
    sinks.replace_chain(spark.createDataFrame([("9", "A")], "store_code string, chain_name string"), f"{root}/s")
    assert sorted(r.store_code for r in spark.read.parquet(f"{root}/s").collect()) == ["2", "9"] or sorted(str(r.store_code) for r in spark.read.parquet(f"{root}/s").collect()) == ["2", "9"]
    assert spark.read.parquet(sinks.snapshot(stores, f"{root}/v", 1)).count() == 2


def test_stream_keeps_the_latest_row(spark, tmp_path):
    root = str(tmp_path)
    schema = spark.createDataFrame([], "id string, at int, status string").schema
    for n, rows in enumerate(([("a", 1, "new"), ("b", 1, "new")], [("a", 3, "saved"), ("a", 2, "old")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/in/{n}")
        ingest.ingest(spark, f"{root}/in/*", schema, f"{root}/table", f"{root}/cp").awaitTermination()
    got = ingest.current(spark, f"{root}/table", schema, ["id"], ["at", "status"])
    assert sorted((r.id, r.status) for r in got.collect()) == [("a", "saved"), ("b", "new")]
