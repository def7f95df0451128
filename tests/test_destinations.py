"""Each step of the delivery cascade, the reasons that it leaves, and what an import keeps of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfline.operators import destinations as ds
from shelfline.operators import documents

R = ds.REASONS
MASTER = [
    ("081701", "株式会社大山", "103-0007", "東京都中央区日本橋浜町1-9-12", "03-6858-3947", ["株式会社大山"], "大山"),
    ("081701J", "埼玉流通センター", "343-0824", "埼玉県越谷市流通団地1-1-17", "048-989-4311", ["オオヤマ サイタマ リュウツウ"], "大山"),
    ("081701JX", "埼玉流通センター別館", "343-0825", "埼玉県越谷市流通団地9-9-9", "048-989-4312", [], "大山"),
    ("200-0001", "名古屋中央物流", "200-0001", "愛知県名古屋市5-6-7", "052-111-2222", [], ""),
    ("AR1", "大阪第一倉庫", "530-0001", "大阪府大阪市北区1-2-3", "06-1111-0001", ["おおさかだいいち"], "あらた"),
    ("AR2", "大阪第二倉庫", "530-0001", "大阪府大阪市北区4-5-6", "06-1111-0002", [], "あらた"),
    ("AR3", "双子甲", "600-0001", "京都府京都市7-7-7", "075-1", [], "あらた"),
    ("AR4", "双子乙", "600-0001", "京都府京都市7-7-7", "075-1", [], "あらた"),
]
DOCS = [
    ("block", "発注元 081701\nお届け先\n０８１７０１ｊ\nお届け先TEL\n081701JX", "", "", "", "", ("081701J", "code", [])),
    ("longest", "x081701JXy\n発注元 081701", "", "", "", "", ("081701JX", "code", [])),
    ("head", "発注元\n081701", "", "", "", "", ("081701", "code", [R["headquarters"]])),
    ("several", "081701J\n081701JX", "", "", "", "", ("081701JX", "code", [R["several"] % "081701JX / 081701J"])),
    ("post", "200-0001 札幌", "", "", "", "", (None, "none", [R["other_address"] % ("200-0001", "名古屋中央物流"), R["not_registered"]])),
    ("given", "なし", "ar1", "", "", "", ("AR1", "code", [])),
    ("kana", "大阪府大阪市北区1-2-3", "", "オオサカダイイチ", "", "", ("AR1", "centerName", [R["by_name"]])),
    ("names", "なし", "", "大阪", "", "", (None, "none", [R["not_registered"]])),
    ("two names", "埼玉県越谷市流通団地1-1-17", "", "埼玉流通センター別館", "", "", (None, "none", [R["name_address"] % "埼玉流通センター別館", R["not_registered"]])),
    ("tie", "〒530-0001 大阪府大阪市北区4-5-6", "", "", "", "", ("AR2", "postal", [R["by_postal"] % "AR2"])),
    ("by tel", "〒530-0001 大阪第二倉庫?", "", "", "06-1111-0002", "", ("AR2", "postal", [R["by_postal"] % "AR2"])),
    ("twins", "〒600-0001 京都府京都市7-7-7", "", "", "", "", (None, "none", [R["several_postal"], R["not_found"]])),
    ("tel", "大阪府大阪市北区1-2-3 TEL 0611110001", "", "", "", "", ("AR1", "tel", [])),
    ("wrong tel", "札幌 TEL 06-1111-0001", "", "", "", "", (None, "none", [R["not_found"]])),
    ("scope", "081701J", "", "", "", "あらた", (None, "none", [R["not_found"]])),
    ("stranger", "081701J", "", "", "", "無名", (None, "none", [R["unregistered"] % "無名"])),
    ("null", None, None, None, None, None, (None, "none", [R["not_found"]])),
]
SCHEMA = "doc_id string, text string, code string, center_name string, tel string, wholesaler_name string"


@pytest.fixture(scope="module")
def resolved(spark):
    master = spark.createDataFrame(MASTER, "code string, name string, postal_code string, address string, tel string, aliases array<string>, wholesaler_name string")
    return ds.resolve(spark.createDataFrame([d[:-1] for d in DOCS], SCHEMA), master).cache()


def test_every_step_and_its_reasons(resolved):
    got = {r.doc_id: (r.code, r.method, list(r.reasons)) for r in resolved.collect()}
    assert got == {d[0]: d[-1] for d in DOCS}
    assert all(r.needs_review == (r.method == "none" or len(r.reasons) > 0) for r in resolved.collect())


def test_an_import_keeps_serious_reasons(resolved):
    got = {r.doc_id: (r.needs_review, list(r.reasons)) for r in ds.import_review(resolved, F.lit(True), F.lit(False)).collect()}
    assert got["kana"] == (False, []) and got["head"] == (True, [R["headquarters"]]) and got["tie"] == (False, [])
    assert got["null"] == (True, [R["not_found"], R["not_registered"], R["no_address"]])


def test_parts_of_an_order_by_hand(spark):
    text = "発注書\n摘要\n¥1,200\n*ロフト梅田　12\n備考\n急ぎ\n金額合計\n倉庫:30\n発注番号 発注日 着荷指定日\n98765432\n24.5.6\n2024年5月9日\nお届先 株式会社 何か\nお届先住所 東京都\nTEL 03-1-2222\n4901234567894 クリーム 12 500 6000\n4901234567801 7 4901234567802 8\n4901234567803\n06-1111-2222\n3個"
    r = documents.parsed(spark.createDataFrame([("f", text), ("n", None)], "file_id string, text string")).orderBy("file_id").first()
    assert (r.order_no, str(r.order_date), str(r.arrival_due_date), r.layout) == ("98765432", "2024-05-06", "2024-05-09", 1)
    assert (r.ship_to_name, r.ship_to_address, r.ship_to_tel, r.warehouse, r.memo) == ("株式会社 何か", "東京都", "03-1-2222", "30", "*ロフト梅田 12")
    assert [tuple(i) for i in r["items"]] == [("4901234567894", 12), ("4901234567801", 7), ("4901234567802", 8), ("4901234567803", 3)]


def test_keys_of_destinations(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(ds.code_key(F.lit("ａ-ｶあ1"))) == "Aカア1" and one(ds.headquarters(F.lit("0817-01"))) is True
    assert one(ds.destination_key(F.lit(None), F.lit("x"))) == ":x" and one(ds.delivery_address(F.lit("1"), F.lit(""), F.lit(None), F.lit("2"))) == "1\n2"
    assert one(ds.wholesaler_of(F.lit("x"), F.lit("ｵｵﾔﾏ"), F.array(F.lit("")), F.lit(""))) == "大山"
