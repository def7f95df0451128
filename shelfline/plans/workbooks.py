"""Products of workbooks and product families, over sheets and names made by SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import workbooks as op
from ..sources.testdata import Tables
from .views import using

_K, _F, _S = "p_partkey", "(p_partkey % 30)", "CASE floor(p_partkey / 30) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '店舗マスタ' END"
_JAN = "concat('49', lpad(cast(p_partkey as {S}), 11, '0'))"
#: Three columns of rows; some files have no heading but a label, some sheets of a file have none.
_ROWS = f"""SELECT concat('w', {_F}) AS file_id, {_S} AS sheet_name, cast(4 + floor(p_partkey / 90) as int) AS row_idx,
  CASE WHEN {_F} % 4 = 0 THEN CASE WHEN {_K} % 11 = 0 THEN '商品名' ELSE 'x' END WHEN {_K} % 5 <> 0 THEN {_JAN} ELSE 'なし' END AS c0,
  CASE WHEN {_F} % 4 = 0 THEN CASE WHEN {_K} % 22 = 0 THEN concat('Label ', {_K}) ELSE '' END WHEN {_K} % 10 = 5 THEN concat('JAN ', {_JAN}) ELSE '' END AS c1,
  CASE WHEN {_F} % 4 = 0 THEN CASE WHEN {_K} % 11 = 0 THEN concat('Other ', {_K}) WHEN {_K} % 13 = 0 THEN concat('JAN ', {_JAN}) ELSE '' END ELSE CASE {_K} % 7 WHEN 0 THEN 'エシエンス' WHEN 1 THEN '' ELSE concat(p_name, {_K} % 4) END END AS c2 FROM part
UNION ALL SELECT DISTINCT concat('w', {_F}), {_S}, 3, 'JAN コード', '単品コード', '商品名' FROM part WHERE {_F} % 4 > 1 OR {_F} % 4 = 1 AND floor(p_partkey / 30) % 3 <> 1"""


def _cells(t: Tables) -> DataFrame:
    t.raw("part").createOrReplaceTempView("_part")
    rows = t.spark.sql(_ROWS.replace("{S}", "string").replace("FROM part", "FROM _part"))
    return rows.select("file_id", "sheet_name", "row_idx", F.posexplode(F.array("c0", "c1", "c2")).alias("col_idx", "value"))


_PRODUCTS = f"""WITH r AS ({_ROWS.replace("{S}", "VARCHAR")}), d AS (SELECT *, regexp_extract(regexp_replace(c0, '[^0-9]', '', 'g'), '^[0-9]{{13}}') AS j0, regexp_extract(regexp_replace(c1, '[^0-9]', '', 'g'), '^[0-9]{{13}}') AS j1, regexp_extract(regexp_replace(c2, '[^0-9]', '', 'g'), '^[0-9]{{13}}') AS j2 FROM r),
h AS (SELECT file_id, sheet_name FROM r WHERE row_idx = 3), k AS (SELECT d.*, coalesce(nullif(j0, ''), nullif(j1, '')) AS jan, regexp_replace(lower(c2), '[ x×ー-]', '', 'g') AS key FROM d JOIN h USING (file_id, sheet_name) WHERE row_idx BETWEEN 4 AND 27),
s AS (SELECT *, length(key) - CASE WHEN key = 'エシエンス' THEN 50 ELSE 0 END AS score FROM k WHERE jan IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id, sheet_name ORDER BY score DESC, row_idx) = 1),
b AS (SELECT * FROM s WHERE sheet_name <> '店舗マスタ' QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY score DESC, sheet_name) = 1),
j AS (SELECT file_id, sheet_name, row_idx, 0 AS col, j0 AS jan FROM d UNION ALL SELECT file_id, sheet_name, row_idx, 1, j1 FROM d UNION ALL SELECT file_id, sheet_name, row_idx, 2, j2 FROM d),
f AS (SELECT file_id, arg_min(jan, (sheet_name, row_idx, col)) AS jan FROM j WHERE jan <> '' AND row_idx < 30 GROUP BY file_id),
l AS (SELECT file_id, arg_min(coalesce(nullif(c1, ''), c2), (sheet_name, row_idx)) AS label FROM d WHERE c0 = '商品名' AND row_idx < 30 GROUP BY file_id)
SELECT file_id, CASE WHEN b.file_id IS NOT NULL THEN b.jan ELSE coalesce(f.jan, '') END AS jan, CASE WHEN b.file_id IS NOT NULL THEN b.c2 ELSE coalesce(l.label, '') END AS product_name FROM (SELECT DISTINCT file_id FROM r) LEFT JOIN b USING (file_id) LEFT JOIN f USING (file_id) LEFT JOIN l USING (file_id)"""

_NAME = "CASE cast(jan as bigint) % 9 WHEN 0 THEN concat('ダーマインショット ', cast(jan as bigint) % 4) WHEN 1 THEN concat('エシエンス', cast(jan as bigint) % 5) ELSE name END"
_MASTER = f"SELECT client_id, jan, {_NAME} AS name, CASE WHEN cast(jan as bigint) % 6 = 0 THEN concat({_NAME}, ' 正式') ELSE '' END AS formal_name, CASE WHEN cast(jan as bigint) % 4 = 0 THEN internal_sku ELSE '' END AS internal_sku FROM products WHERE client_id <> 'C3' OR cast(jan as bigint) % 9 > 1 OR jan = '0000000000009'"
_ASKED = """SELECT DISTINCT concat('C', p_partkey % 5) AS client_id, CASE p_partkey % 3 WHEN 0 THEN lpad(cast(p_partkey as {S}), 13, '0') WHEN 1 THEN 'UNKNOWN' ELSE '' END AS jan,
  CASE floor(p_partkey / 3) % 6 WHEN 0 THEN concat('ダマショット', p_partkey % 7) WHEN 1 THEN concat(upper(p_name), ' long set') WHEN 2 THEN 'ダーマ ショット' WHEN 3 THEN concat('エシエンス', p_partkey % 6, '箱') WHEN 4 THEN '' ELSE concat('zzz ', p_partkey % 9) END AS name FROM part"""


def _families(t: Tables) -> DataFrame:
    t.raw("part").createOrReplaceTempView("_part")
    t.products().createOrReplaceTempView("_products")
    asked = t.spark.sql(_ASKED.replace("{S}", "string").replace("FROM part", "FROM _part"))
    return op.display(asked, t.spark.sql(_MASTER.replace("FROM products", "FROM _products")))


_KEY = lambda c: f"replace(replace(regexp_replace(lower({c}), '[ x×ー-]', '', 'g'), 'ダマショット', 'ダマインショット'), 'ダマショット', 'ダマインショット')"
_PLAIN = lambda c: f"regexp_replace(lower({c}), '[ x×ー-]', '', 'g')"
_FAMILY = lambda c: f"regexp_matches({_PLAIN(c)}, 'ダマインショット|エシエンス|esience|ダマ')"
#: Every row against every product of its client.
_DISPLAY = using(
    "products",
    f""", m AS ({_MASTER}), s AS (SELECT *, coalesce(nullif(formal_name, ''), name) AS shown FROM m), p AS (SELECT *, {_KEY("shown")} AS key FROM s), r AS (SELECT *, trim(name) AS n, {_KEY("name")} AS key FROM ({_ASKED.replace("{S}", "VARCHAR")})),
j AS (SELECT r.*, p.name AS j_name FROM r LEFT JOIN p ON p.client_id = r.client_id AND p.jan = r.jan),
x AS (SELECT j.client_id, j.jan, j.n, p.jan AS p_jan, p.name AS p_name, CASE WHEN j.key = p.key THEN length(p.key) + 1000 WHEN contains(j.key, p.key) OR contains(p.key, j.key) THEN least(length(j.key), length(p.key)) + 100 WHEN contains(j.key, 'ダマインショット') AND contains(p.key, 'ダマインショット') THEN 500 ELSE 0 END AS score
  FROM j JOIN p ON p.client_id = j.client_id AND j.key <> '' AND p.key <> '' WHERE j_name IS NULL),
b AS (SELECT * FROM x WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY client_id, jan, n ORDER BY score DESC, p_name, p_jan) = 1),
o AS (SELECT client_id, min(jan) AS only_jan FROM s WHERE {_FAMILY("shown")} GROUP BY client_id HAVING count(*) = 1),
f AS (SELECT j.client_id, j.jan, j.n, CASE WHEN j_name IS NOT NULL THEN j.jan ELSE coalesce(b.p_jan, j.jan) END AS found_jan,
  CASE WHEN j_name IS NOT NULL AND j.n <> '' AND ({_PLAIN("j.n")} <> {_PLAIN("j_name")} AND (contains({_PLAIN("j.n")}, {_PLAIN("j_name")}) AND length({_PLAIN("j.n")}) > length({_PLAIN("j_name")}) + 2 OR regexp_matches({_PLAIN("j.n")}, '14包|esience|エシエンス14'))) THEN j.n WHEN j_name IS NOT NULL THEN j_name ELSE coalesce(b.p_name, nullif(j.n, ''), j.jan) END AS found_name,
  j_name IS NOT NULL OR b.p_jan IS NOT NULL AS there FROM j LEFT JOIN b USING (client_id, jan, n)),
g AS (SELECT f.*, CASE WHEN there THEN found_jan WHEN jan IN ('', 'UNKNOWN') AND {_FAMILY("n")} THEN only_jan END AS p_jan FROM f LEFT JOIN o USING (client_id)),
sk AS (SELECT client_id, internal_sku, arg_min(shown, (formal_name = '', CASE WHEN formal_name = '' THEN name ELSE '' END, name, jan)) AS head FROM s WHERE internal_sku <> '' GROUP BY ALL),
be AS (SELECT client_id, min(shown) AS only_shown, min(internal_sku) AS only_sku FROM s WHERE contains({_PLAIN("shown")}, 'ダマインショット') GROUP BY client_id HAVING count(*) = 1),
c AS (SELECT s.client_id, s.jan AS p_jan, CASE WHEN sk.head IS NOT NULL THEN sk.head WHEN {_FAMILY("s.shown")} AND only_shown IS NOT NULL THEN only_shown ELSE s.shown END AS shown, CASE WHEN sk.head IS NOT NULL THEN s.internal_sku WHEN {_FAMILY("s.shown")} AND only_shown IS NOT NULL THEN only_sku ELSE s.internal_sku END AS sku
  FROM s LEFT JOIN sk ON sk.client_id = s.client_id AND sk.internal_sku = s.internal_sku LEFT JOIN be ON be.client_id = s.client_id),
e AS (SELECT g.client_id, g.jan, g.n AS name, coalesce(g.p_jan, found_jan) AS shown_jan, CASE WHEN g.p_jan IS NOT NULL THEN coalesce(nullif(c.shown, ''), found_jan) ELSE coalesce(nullif(found_name, ''), found_jan) END AS shown_name, coalesce(c.sku, '') AS sku FROM g LEFT JOIN c USING (client_id, p_jan))
SELECT client_id, jan, name, shown_jan, shown_name, CASE WHEN sku <> '' THEN 'sku:' || sku WHEN {_PLAIN("shown_name")} <> '' THEN 'name:' || {_PLAIN("shown_name")} ELSE 'jan:' || shown_jan END AS product_key FROM e""",
)

QUERIES = {
    "workbook_products": (lambda t: op.file_products(_cells(t)), _PRODUCTS),
    "introduction_display_products": (_families, _DISPLAY),
}
