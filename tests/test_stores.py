"""Steps of store matching and files, on small tables that state each rule."""

from __future__ import annotations

from shelfline.operators import stores
from shelfline.sources import files

LOCATIONS = [
    ("loft-1", "渋谷ロフト"),
    ("loft-2", "コスメロフト 梅田"),
    ("loft-3", "グランスタ東京"),
    ("hands-7", "ハンズ 名古屋栄店"),
    ("hands-8", "ハンズ 梅田店"),
    ("ainz-0012", "アインズ 札幌"),
    ("atcosme-tokyo", "@cosme TOKYO"),
    ("X99999", "みなとみらい東急スクエア本館"),
    ("0345", "天神地下街"),
]
#: name, code, step, matched code.
WANT = [
    ("any name", "501", 1, "atcosme-tokyo"),
    ("渋谷ロフト", "", 2, "loft-1"),
    ("渋谷ロフト店", "", 2, "loft-1"),
    ("アインズ 札幌駅前", "", 3, "ainz-0012"),
    ("コスメ梅田茶屋町", "", 4, "loft-2"),
    ("コスメグラ東京", "", 5, "loft-3"),
    ("hb名古屋栄x", "", 3, "hands-7"),
    ("ハンズNorthgate梅田", "", 6, "hands-8"),
    ("zzz", "X99999", 7, "X99999"),
    ("zzz", "10012", 7, "ainz-0012"),
    ("天神地下街", "0345", 2, "0345"),
    ("ｚｚｚ", "345", None, None),
    ("未知の店", "77", None, None),
    ("", "", None, None),
]


def test_every_step_of_the_cascade(spark):
    locations = spark.createDataFrame(LOCATIONS, "store_code string, store_name string")
    entries = spark.createDataFrame([(n, c) for n, c, *_ in WANT] + [(None, None)], "store_name string, store_code string")
    legacy = spark.createDataFrame([("501", "atcosme-tokyo")], "code string, official string")
    got = {(r.store_name, r.store_code): (r.step, r.matched_code) for r in stores.resolve_stores(entries, locations, legacy).collect()}
    assert got == {(n, c): (step, code) for n, c, step, code in WANT}
    assert stores.resolve_stores(entries.limit(0), locations).count() == 0 and stores.resolve_stores(entries, locations.limit(0)).where("step IS NOT NULL").count() == 0


def test_short_codes_of_one_chain(spark):
    locations = spark.createDataFrame([("loft-12", "池袋ロフト"), ("12", "別の店")], "store_code string, store_name string")
    entries = spark.createDataFrame([("ロフト", "12", "q"), ("ハンズ", "12", "別の店"), (None, "12", None)], "retailer string, store_code string, store_name string")
    got = {r.retailer: r.matched_code for r in stores.sellout_locations(entries, locations).collect()}
    assert got["ロフト"] == "loft-12" and got["ハンズ"] == "12"


def test_matrix_rows_take_over_like_a_fold(spark):
    import itertools

    kinds = [(False, ""), (True, ""), (False, "a"), (True, "a")]
    rows = [(f"{n}-{k}", i, *kind) for n in range(1, 6) for k, seq in enumerate(itertools.product(kinds, repeat=n)) for i, kind in enumerate(seq)]
    want = {}
    for key, i, intro, address in rows:
        now = want.get(key)
        if now is None or (not now[1] and intro) or (not now[2] and address):
            want[key] = (i, intro, address)
    got = stores.one_matrix_row(spark.createDataFrame(rows, "key string, ord long, introduced boolean, address string")).collect()
    assert {r.key: r.ord for r in got} == {k: v[0] for k, v in want.items()}


def test_csv_files_in_two_encodings(spark, tmp_path):
    text = '発注No,数量, 備考\n1,2,"a,b\nc"\n\n , ,\n3\n'
    (tmp_path / "u.csv").write_bytes(text.encode("utf-8-sig"))
    (tmp_path / "s.csv").write_bytes(text.encode("cp932"))
    (tmp_path / "none.csv").write_bytes(b"")
    got = files.order_csv(spark, str(tmp_path)).collect()
    assert len(got) == 4 and {r.file_id.rsplit("/", 1)[1] for r in got} == {"u.csv", "s.csv"}
    for r in got:
        assert r.fields == ({"発注No": "1", "数量": "2", "備考": "a,b\nc"} if r.row_idx == 0 else {"発注No": "3", "数量": "", "備考": ""})


def test_candidates_are_left_out_only_while_others_remain(spark):
    locations = [("hands-1", "ハンズ柏店"), ("hands-be_2", "ハンズビー柏モディ店"), ("hands-be_3", "ハンズビー川越店"), ("hands-be_4", "ハンズビー川越モディ店"), ("x5", "大宮東口"), ("x6", "大宮西口"), ("x7", "町田駅前"), ("x8", "町田駅前"), ("x9", "渋谷スクランブルスクエア"), ("", "甲府")]
    want = [("柏", "hands-1", 1), ("ハンズビー柏", "hands-be_2", 1), ("柏モディ", "hands-be_2", 1), ("川越", "hands-be_3", 2), ("大宮", "x6", 3), ("渋谷SQ", "x9", 1), ("甲府", "", 1)]
    names = spark.createDataFrame([(w[0],) for w in want] + [("町田",), ("",), (None,), ("札幌",)], "name string")
    known = spark.createDataFrame([("x6",), ("x7",), ("x8",)], "store_code string")
    got = stores.store_candidates(names, spark.createDataFrame(locations, "store_code string, store_name string"), known)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    alone = stores.store_candidates(names, spark.createDataFrame(locations, "store_code string, store_name string"))
    assert sorted(map(tuple, alone.collect())) == sorted(w for w in want if w[2] < 3)


def test_legacy_codes_and_the_last_step_within_the_cascade(spark):
    locations = spark.createDataFrame([("atcosme-osaka", "@cosme OSAKA"), ("hands-1", "ハンズ柏店"), ("hands-be_2", "ハンズビー柏モディ店")], "store_code string, store_name string")
    entries = spark.createDataFrame([("何か", "502"), ("柏", "")], "store_name string, store_code string")
    assert sorted((r.store_name, r.step, r.matched_code) for r in stores.resolve_stores(entries, locations).collect()) == [("何か", 1, "atcosme-osaka"), ("柏", 9, "hands-1")]
