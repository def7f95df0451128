"""Products with further fields made by SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import extras as op
from ..sources.testdata import Tables

_VALUES = ", ".join(
    (f"CASE WHEN (p_partkey + {i}) % 4 = 0 THEN ' ' WHEN (p_partkey + {i}) % 4 > 1 THEN concat(p_type, ' {c} ', p_partkey % 17) END AS {c}" if kind == "text" else f"CASE WHEN (p_partkey + {i}) % 5 > 0 THEN p_size * 5e-1 + {i} END AS {c}")
    for i, (c, kind) in enumerate(op.FIELDS.items())
)
_PARTS = f"SELECT p_partkey, p_name, {_VALUES} FROM part"
_TYPED = f"SELECT p_partkey, p_name, {', '.join(f'nullif(trim({c}), {chr(39) * 2}) AS {c}' if kind == 'text' else c for c, kind in op.FIELDS.items())} FROM ({_PARTS})"
_TEXTS = " || chr(10) || ".join(f"coalesce({c}, '')" for c, kind in op.FIELDS.items() if kind == "text")
_FOUND = f"SELECT p_partkey, p_name FROM ({_TYPED}) WHERE contains(lower(p_name || chr(10) || {_TEXTS}), 'kana 1')"


def _products(t: Tables) -> DataFrame:
    t.raw("part").createOrReplaceTempView("_part")
    return op.packed(t.spark.sql(_PARTS.replace("FROM part", "FROM _part")))


def _found(t: Tables) -> DataFrame:
    return op.search(_products(t), " KANA 1", ["p_name"]).select("p_partkey", "p_name")


QUERIES = {
    "product_extras": (lambda t: op.unpacked(_products(t)), _TYPED),
    "product_extras_found": (_found, _FOUND),
    "product_extras_page": (lambda t: op.page(_found(t), ["p_partkey"], 2)[0], f"SELECT * FROM ({_FOUND}) ORDER BY p_partkey LIMIT 50 OFFSET 50"),
    "product_extras_count": (lambda t: op.page(_found(t), ["p_partkey"], 2)[1], f"SELECT count(*) AS found FROM ({_FOUND})"),
}
