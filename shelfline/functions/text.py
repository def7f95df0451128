"""Text rules as column expressions. Unicode normalisation, which Spark SQL lacks, is one pandas function."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What the rules count as blank: \\s and the ideographic, no-break and zero-width no-break spaces.
BLANK = "\\s\u3000\u00a0\ufeff"
UNKNOWN = "店舗不明"

#: Dashes and symbols that names are compared without. Fixed values.
SYMBOLS = "・･\\\\/／\\-ー‐‑‒–—―_,，、.．()（）［\\]\\[【】"
HEADER_WORDS = ("発注番号", "発注日", "着荷指定", "口座", "商品コード", "条件区分", "有償", "景品")


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode NFKC. Apply it to distinct texts where a column repeats."""
    return values.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def trim(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), f"^[{BLANK}]+|[{BLANK}]+$", "")


def squeeze(c: Column) -> Column:
    return trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), f"[{BLANK}]+", " "))


def first_filled(*values: Column | str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.lit(v) if isinstance(v, str) else v, F.lit("")) for v in values])


def header_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(nfkc(F.coalesce(c, F.lit("")))), f"[{BLANK}]", "")


def memo_key(c: Column) -> Column:
    """A memo without its lead-in words, stars and price tail."""
    out = nfkc(F.coalesce(c, F.lit("")))
    for pattern in ("^入荷先[:：]?", "^店舗[:：]?", "^店名[:：]?", "^\\*+", f"[{BLANK}]*¥[\\d,]+.*$"):
        out = F.regexp_replace(out, pattern, "")
    return squeeze(out)


def match_key(c: Column) -> Column:
    """A name for comparison: memo key, lower case, without blanks, dashes and brackets."""
    return F.regexp_replace(F.lower(memo_key(c)), f"[{BLANK}{SYMBOLS}]", "")


def is_header(c: Column) -> Column:
    """Two or more of the table header's words."""
    text = F.regexp_replace(c, f"[{BLANK}]", "")
    hits = F.lit(0)
    for w in HEADER_WORDS:
        hits += F.contains(text, F.lit(w)).cast("int")
    return hits >= 2


def location_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(nfkc(F.coalesce(c, F.lit("")))), f"[{BLANK}()（）]", "")


def jan_digits(c: Column) -> Column:
    """The first 13 digits after all else is removed, empty if there are fewer."""
    return F.regexp_extract(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", ""), "[0-9]{13}", 0)


def whole_number(c: Column) -> Column:
    """Commas and blanks removed; null unless a whole number is left."""
    plain = F.regexp_replace(c, f"[,{BLANK}]", "")
    return F.when(plain.rlike("^-?[0-9]+$"), plain.try_cast("long"))


def money(c: Column) -> Column:
    return F.regexp_replace(c, f"[,円{BLANK}]", "").try_cast("double")


def tax_rate(c: Column) -> Column:
    """A rate below one from 10%, 10 or 0.1."""
    n = F.regexp_replace(c, f"[%％{BLANK}]", "").try_cast("double")
    return F.when(F.contains(c, F.lit("%")) | (n > 1), n / 100).otherwise(n)


def positive(c: Column) -> Column:
    return F.coalesce(c.try_cast("double") > 0, F.lit(False))


def postal(c: Column) -> Column:
    """The first seven-digit postal code as ddd-dddd, empty without one."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?<![0-9])\d{3}-?\d{4}(?![0-9])", 0), r"^(\d{3})-?(\d{4})$", "$1-$2")


def phone(c: Column) -> Column:
    """Digits of the first thing that looks like a phone number."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), r"0\d{1,4}-?\d{1,4}-?\d{3,4}", 0), "-", "")


def block_numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+-\d+(?:-\d+)?"), F.lit(0)))


def looks_like_address(c: Column) -> Column:
    t = trim(c)
    return (F.length(t) >= 4) & ~t.rlike("^[0-9]+$")


def located_address(post: Column, address: Column) -> Column:
    """Postal code and address, the address without postal codes of its own in front."""
    body = F.regexp_replace(trim(address), r"^((\d{3}-\d{4}|\d{7})\s+)+", "")
    return F.concat_ws(" ", F.nullif(trim(post), F.lit("")), F.nullif(body, F.lit("")))


def order_number(c: Column) -> Column:
    """Digits are padded to eight; longer and other numbers stay."""
    return F.when(c.rlike("^[0-9]+$") & (F.length(c) < 8), F.lpad(c, 8, "0")).otherwise(c)


def yen(x: Column) -> Column:
    return F.format_number(F.floor(x + F.lit(0.5)), 0)


def csv_cell(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def split_address(c: Column) -> Column:
    """array of three parts: lines if there are several, else a cut after the municipality."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\r?\n"), trim), lambda x: x != "")
    rest = F.when(F.get(lines, F.lit(0)).rlike(r"^\d{3}-?\d{4}$"), F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines)
    body = F.when(F.size(lines) > 1, F.array_join(rest, "")).otherwise(trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"^(.*?)\d{3}-?\d{4}", "$1")))
    cuts = (r"^(.+?[都道府県].+?郡.+?[町村])", r"^(.+?[都道府県].+?市.+?区)", r"^(.+?[都道府県].+?市)", r"^(.+?[都道府県].+?区)", r"^(.+?[都道府県].+?[町村])")
    head = F.coalesce(*[F.nullif(F.regexp_extract(body, p, 1), F.lit("")) for p in cuts], F.lit(""))
    cut = F.when(head != "", F.array(trim(head), trim(F.substring(body, F.length(head) + 1, F.length(body))), F.lit(""))).otherwise(F.array(body, F.lit(""), F.lit("")))
    several = F.array(F.get(rest, F.lit(0)), F.get(rest, F.lit(1)), F.array_join(F.slice(rest, F.lit(3), F.size(rest)), " "))
    return F.when((F.size(lines) > 1) & (F.size(rest) >= 2), several).otherwise(cut)


def month_key(start: Column, end: Column) -> Column:
    """yyyy-MM of the period's end, else of its start; other text stays, empty without both."""
    src = F.coalesce(first_filled(end, start), F.lit(""))
    parts = F.split(src, "-")
    return F.when(F.coalesce(F.get(parts, F.lit(1)), F.lit("")) != "", F.concat(F.get(parts, F.lit(0)), F.lit("-"), F.lpad(F.get(parts, F.lit(1)), 2, "0"))).otherwise(src)


def month_label(start: Column, end: Column) -> Column:
    key = month_key(start, end)
    return F.when(key == "", "不明").when(key.rlike(r"^\d{4}-\d{2}$"), F.concat(F.substring(key, 1, 4), F.lit("年"), F.substring(key, 6, 2).try_cast("int").cast("string"), F.lit("月"))).otherwise(key)


def period_text(start: Column, end: Column) -> Column:
    s, e = F.coalesce(start, F.lit("")), F.coalesce(end, F.lit(""))
    return F.when((s == "") & (e == ""), "期間不明").when((e == "") | (s == e), s).otherwise(F.concat(s, F.lit(" 〜 "), e))


def aliases(c: Column) -> Column:
    """Distinct trimmed names between line breaks and commas."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[\n,、]"), trim), lambda x: x != ""))


def percent_text(rate: Column) -> Column:
    return F.concat(F.floor(rate * 1000 + F.lit(0.5)) / 10, F.lit("%"))


def inferred_chain(code: Column, name: Column) -> Column:
    """The chain that a store's code, else its name, stands for; empty without one."""
    out = F
    for i, (prefix, chain) in enumerate((("loft-", "ロフト"), ("hands-", "ハンズ"), ("atcosme-", "@cosme STORE"), ("ainz-", "アインズ"))):
        out = (F if i == 0 else out).when(F.startswith(code, F.lit(prefix)), chain)
    for pattern, chain in (("(?i)ロフト|loft", "ロフト"), ("(?i)ハンズ|hands", "ハンズ"), ("(?i)@cosme|アットコスメ", "@cosme STORE"), ("(?i)アインズ|ainz", "アインズ")):
        out = out.when(name.rlike(pattern), chain)
    return out.otherwise("")


def jan_value(c: Column, number: Column) -> Column:
    """A sell-out cell as JAN: numbers without their fraction, exponents written out; text needs eight digits; empty otherwise."""
    t = F.coalesce(c, F.lit(""))
    t = F.regexp_replace(t, f"^[{BLANK}]+|[{BLANK}]+$", "")
    whole = t.try_cast("decimal(38,10)")
    plain = F.when(whole < 0, F.ceil(whole)).otherwise(F.floor(whole)).cast("string")
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    return F.when(number & whole.isNotNull(), plain).when(t.rlike(r"(?i)^\d+(\.\d+)?e\+\d+$"), plain).when(digits >= 8, F.regexp_replace(t, f"[{BLANK}]+", "")).otherwise("")


def jan_cell(c: Column, number: Column) -> Column:
    """A product-master cell as JAN: numbers rounded halves up, text without blanks and without `.0` at its end."""
    n = c.try_cast("decimal(38,10)")
    return F.when(number & n.isNotNull(), F.floor(n + F.lit(0.5).cast("decimal(2,1)")).cast("string")).otherwise(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{BLANK}]", ""), r"\.0$", ""))


def unit_volume(value: Column, unit: Column) -> Column:
    """Value and unit with a blank between; ml is written mL; the value alone without a unit, empty without a value."""
    u = trim(unit)
    u = F.when(u == "ml", "mL").otherwise(u)
    v = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(v == "", "").when(u == "", v).otherwise(F.concat(v, F.lit(" "), u))


def preferred_name(other: Column, name: Column) -> Column:
    """The formal, or the export's, name where it is not blank, else the name."""
    return F.coalesce(F.nullif(trim(other), F.lit("")), name, F.lit(""))


def format_key(key: Column, file_name: Column) -> Column:
    """A row list whose file is called an address book is a promotional address list."""
    return F.when((key == "row-list") & F.contains(file_name, F.lit("住所録")), "promotional-address-list").otherwise(key)


def has_useful_text(c: Column) -> Column:
    """Twenty characters or more that are neither blank nor a page mark."""
    marks = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)--\s*\d+\s*of\s*\d+\s*--", "")
    return F.length(F.regexp_replace(marks, r"\s", "")) >= 20


def text_quality(c: Column) -> Column:
    """Length, 200 for each 13-digit number, 100 for each date, 3 for each Japanese character, 1 for each digit; blanks don't count."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", "")
    n = lambda p: F.regexp_count(t, F.lit(p))
    return F.length(t) + 200 * n(r"\d{13}") + 100 * n(r"\d{4}[/\-.年月]\d{1,2}[/\-.月]\d{1,2}") + 3 * n(r"[\p{IsHiragana}\p{IsKatakana}\p{IsHan}]") + n(r"\d")


#: Labels around the ship-to part of an order. Fixed values.
SHIP_TO = ("お届け先", "お届先", "納品先")
SHIP_TO_ENDS = ("お届け先住所", "お届先住所", "納品先住所", "お届け先TEL", "お届先TEL", "納品先TEL", "発注先", "発注元")


def ship_to_block(c: Column) -> Column:
    """Up to seven lines after the first ship-to label, as far as a line that holds another label; empty without one."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\r?\n"), trim), lambda x: x != "")
    start = f"^({'|'.join(SHIP_TO)})(|[:：]| .*)$"
    is_label = lambda x: x.rlike(start) & ~F.contains(x, F.lit("住所")) & ~F.contains(x, F.lit("TEL"))
    at = F.array_position(F.transform(lines, is_label), True).cast("int")
    rest = F.when(at > 0, F.slice(lines, F.greatest(at, F.lit(1)) + 1, F.lit(7)))
    end = F.array_position(F.transform(rest, lambda x: x.rlike("|".join(SHIP_TO_ENDS))), True).cast("int")
    return F.coalesce(F.array_join(F.when(end > 0, F.slice(rest, F.lit(1), end - 1)).otherwise(rest), "\n"), F.lit(""))


#: Words of an order that tell its wholesaler. Fixed values.
WHOLESALERS = (("大山", "081701|大山|オオヤマ|フィットエクスプレス"), ("あらた", "あらた|アラタ"))


def wholesaler(c: Column) -> Column:
    """The wholesaler that a text names, the first of the list on ties; empty without one."""
    t = nfkc(F.coalesce(c, F.lit("")))
    return F.coalesce(*[F.when(t.rlike(p), name) for name, p in WHOLESALERS], F.lit(""))


#: Parts of store names of two chains. Fixed values.
COSME_TOKENS = (
    "cosme", "アットコスメ", "ルミネ", "マルイ", "ニュウマン", "アミュエスト", "天満橋", "なんばウォーク", "サンシャイン", "mozo", "フォーラス", "ステラプレイス",
    "ラゾーナ", "ららぽーと", "シドニー", "錦糸町", "マルート", "tsutaya", "イオンモール高崎", "イオンモール高岡", "イオンモール浦和美園", "アトレ亀戸", "金沢",
)
AEON_PREFIXES = ("イオンスタイル", "イオンリテール", "イオンスーパー", "イオンモール", "aeon")


def plain_key(c: Column) -> Column:
    """A name for comparison: NFKC, lower case, without blanks, dashes and brackets."""
    return F.regexp_replace(F.lower(nfkc(F.coalesce(c, F.lit("")))), f"[{BLANK}{SYMBOLS}]", "")


def _plain(text: str) -> str:
    return re.sub(f"[{BLANK}{SYMBOLS}]", "", unicodedata.normalize("NFKC", text).lower())


def cosme_score(key: Column) -> Column:
    """How surely a plain key names a store of @cosme: 1000 and its length, else 500 and the longest part's length, else 0."""
    best = [F.when((key != "") & (F.contains(key, F.lit(t)) | F.contains(F.lit(t), key)), 500 + len(t)).otherwise(0) for t in map(_plain, COSME_TOKENS)]
    named = F.contains(key, F.lit("cosme")) | F.contains(key, F.lit(_plain("アットコスメ")))
    return F.when(named, F.length(key) + 1000).otherwise(F.greatest(*best))


def aeon_score(key: Column) -> Column:
    """How surely a plain key names a store of AEON: its length and 200 if it starts like one and is none of @cosme's, else 0."""
    starts = key.rlike("^(" + "|".join(map(_plain, AEON_PREFIXES)) + ")")
    return F.when((cosme_score(key) == 0) & starts, F.length(key) + 200).otherwise(0)
