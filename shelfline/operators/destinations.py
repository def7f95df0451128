"""Delivery destinations of order documents: a cascade from codes over names and postal codes to phone numbers.

destinations: code, name, postal_code, address, tel, aliases (array), and wholesaler_name where there is one. documents:
doc_id, text, code, center_name, and address, tel, wholesaler_name where there are such. Every step leaves its evidence, a
destination or the reason why there is none; the first destination counts, and the reasons up to it stay with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .matching import _meet

LEAD = 8  # by which the best centre name must be ahead
LEAST = 7  # letters and digits of a code that counts within a longer word
HEADQUARTERS = "081701"  # stands on every order of its wholesaler and names no centre

#: Reasons for a review, as the order screen shows them. Fixed values.
REASONS = {
    "unregistered": "%s の配送先マスタが登録されていません",
    "several": "センターコードが複数見つかりました（%s）",
    "other_address": "配送先コード %s は郵便番号形式ですが、発注書の住所とマスター（%s）の住所が一致しません",
    "headquarters": "センターコードが本部共通コードのみです",
    "name_address": "センター名は %s と一致しましたが、発注書の住所とマスターの住所が一致しません",
    "by_name": "配送先コードが見つからないため、センター名で判定しました",
    "several_names": "センター名が複数候補と一致しました",
    "postal_address": "郵便番号 %s は %s と一致しましたが、発注書の住所とマスターの住所が一致しません",
    "by_postal": "郵便番号候補から %s を特定しました",
    "several_postal": "PDF内の郵便番号候補が複数センターと一致し、配送先コード・センター名・住所・TELだけでは特定できませんでした",
    "tel_address": "TELは %s と一致しましたが、発注書の住所とマスターの住所が一致しません",
    "several_tel": "TELが複数センターと一致しました",
    "not_registered": "配送先マスタに一致するセンターが見つかりませんでした",
    "not_found": "配送先コードまたはセンター名をPDFから特定できませんでした",
    "no_name": "お届け先名称をPDFから特定できませんでした",
    "no_address": "お届け先住所をPDFから特定できませんでした",
}
#: What keeps an order with a destination in review. Fixed values.
SERIOUS = "複数見つかりました|本部共通コードのみ|特定できませんでした|住所が一致しません"

_KATAKANA, _HIRAGANA = ("".join(map(chr, range(first, first + 86))) for first in (0x30A1, 0x3041))
_POSTAL_CODE = r"^\d{3}-?\d{4}$"


def hiragana(c: Column) -> Column:
    return F.translate(c, _KATAKANA, _HIRAGANA)


def _code_key(c: Column) -> Column:
    return F.translate(F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")), _HIRAGANA, _KATAKANA)


def _address_key(c: Column) -> Column:
    return F.lower(hiragana(F.regexp_replace(c, f"[{tx.BLANK}都道府県]", "")))


def code_key(c: Column) -> Column:
    """Letters and digits after NFKC, upper case, kana as katakana."""
    return _code_key(tx.nfkc(F.coalesce(c, F.lit(""))))


def address_key(c: Column) -> Column:
    return _address_key(tx.nfkc(F.coalesce(c, F.lit(""))))


def name_key(c: Column) -> Column:
    return F.lower(hiragana(F.regexp_replace(tx.nfkc(F.coalesce(c, F.lit(""))), f"[{tx.BLANK}()・]", "")))


def _reason(kind: str, *values: Column) -> Column:
    return F.format_string(REASONS[kind], *values) if values else F.lit(REASONS[kind])


def _own(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def headquarters(code: Column) -> Column:
    """True for the code that every order of its wholesaler carries."""
    return code_key(code) == HEADQUARTERS


def wholesaler_of(code: Column, name: Column, aliases: Column, given: Column) -> Column:
    """The wholesaler of a destination: as it stands, else by its code and names; empty without one."""
    text = F.concat_ws(" ", code, name, F.array_join(aliases, " "))
    return F.when(given != "", given).when(text.rlike("大山|オオヤマ|ｵｵﾔﾏ|081701"), "大山").when(text.rlike("あらた|アラタ"), "あらた").otherwise("")


def destination_key(wholesaler: Column, code: Column) -> Column:
    """What tells destinations apart: wholesaler and code."""
    return F.concat(F.coalesce(wholesaler, F.lit("")), F.lit(":"), code)


def delivery_address(*parts: Column) -> Column:
    """Postal code and the address' parts, a line for each that is filled."""
    return F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda x: x != ""), "\n")


def prepared(destinations: DataFrame) -> DataFrame:
    """The master with the keys that every step compares; made once for all documents."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    flat = destinations.select(
        "code", "name", "postal_code", "address", "tel", aliases.alias("aliases"), _own(destinations, "wholesaler_name").alias("given"), tx.nfkc(F.array_join(F.concat(F.array(F.coalesce("name", F.lit(""))), aliases), "\n")).alias("names")
    )
    names = F.split("names", "\n")
    return flat.select(
        F.col("code").alias("d_code"),
        F.coalesce("name", F.lit("")).alias("d_label"),
        code_key(F.col("code")).alias("d_key"),
        tx.postal(F.col("postal_code")).alias("d_postal"),
        F.when(F.col("code").rlike(_POSTAL_CODE), tx.postal(F.col("code"))).otherwise("").alias("d_code_postal"),
        F.regexp_replace(F.coalesce("tel", F.lit("")), "[^0-9]", "").alias("d_tel"),
        address_key(F.col("address")).alias("d_address"),
        F.transform(names, _address_key).alias("d_names"),
        F.transform(names, lambda x: F.lower(hiragana(F.regexp_replace(x, f"[{tx.BLANK}()・]", "")))).alias("d_centers"),
        wholesaler_of(F.col("code"), F.col("name"), F.col("aliases"), F.col("given")).alias("d_wholesaler"),
    )


def address_score() -> Column:
    """30 for the whole address, 15 for each shared block number, 8 for each alias, 5 for the name."""
    shared = F.size(F.array_intersect(tx.block_numbers(F.col("key")), tx.block_numbers(F.col("d_address"))))
    aliases = F.slice("d_names", F.lit(2), F.size("d_names"))
    named = F.size(F.filter(aliases, lambda a: (F.length(a) >= 6) & F.contains(F.col("key"), a)))
    whole = (F.col("d_address") != "") & F.contains("key", F.col("d_address"))
    name = F.get("d_names", F.lit(0))
    return F.when(whole, 30).otherwise(0) + 15 * shared + 8 * named + F.when((F.length(name) >= 4) & F.contains("key", name), 5).otherwise(0)


def compatible() -> Column:
    """Postal codes must not contradict; with an equal one a weak sign is enough, without one 15 points are needed."""
    has = lambda c: (F.col(c) != "") & F.array_contains("postals", F.col(c))
    read = F.when(has("d_postal"), F.col("d_postal")).when(has("d_code_postal"), F.col("d_code_postal")).otherwise(F.coalesce(F.get("postals", F.lit(0)), F.lit("")))
    both = (read != "") & (F.col("d_postal") != "")
    alias = F.exists("d_names", lambda a: (F.length(a) >= 6) & F.contains(F.col("key"), a))
    weak = (F.col("score") >= 5) | ((F.col("found_tel") != "") & (F.col("d_tel") == F.col("found_tel"))) | alias
    return F.when(both & (read != F.col("d_postal")), False).when(both | has("d_code_postal"), weak).otherwise(F.col("score") >= 15)


def _searched(documents: DataFrame) -> DataFrame:
    """A row for each document with what the steps look at."""
    parts = [_own(documents, c) for c in ("text", "address", "tel", "center_name")]
    flat = documents.select("doc_id", _own(documents, "code").alias("code"), _own(documents, "center_name").alias("center_name"), _own(documents, "tel").alias("tel"), _own(documents, "wholesaler_name").alias("wholesaler"), delivery_address(*parts).alias("search"))
    flat = flat.withColumn("plain", tx.nfkc(F.col("search")))
    tel = F.regexp_extract("search", r"0\d{1,4}-\d{1,4}-\d{3,4}", 0)
    found = F.regexp_replace(F.when(tel != "", tel).otherwise(F.regexp_extract("search", r"0\d{9,10}", 0)), "-", "")
    posts = F.regexp_extract_all("search", F.lit(r"(?<![0-9A-Za-z_])\d{3}-?\d{4}(?![0-9A-Za-z_])"), F.lit(0))
    given = F.regexp_replace("tel", "[^0-9]", "")
    return flat.select(
        "doc_id",
        "wholesaler",
        "search",
        "plain",
        code_key(F.col("code")).alias("given"),
        name_key(F.col("center_name")).alias("center"),
        _address_key(F.col("plain")).alias("key"),
        found.alias("found_tel"),
        F.when(given != "", given).otherwise(found).alias("tel"),
        F.array_distinct(F.transform(posts, tx.postal)).alias("postals"),
    )


def _in_scope() -> Column:
    return (F.col("wholesaler") == "") | (F.col("wholesaler") == F.col("d_wholesaler"))


def found_codes(searched: DataFrame, dest: DataFrame) -> DataFrame:
    """doc_id, codes: the master's codes that stand in the ship-to part, else in the whole text; the longest of each line.

    A code counts where a line is that code, and one of seven letters and digits or more wherever it stands. The latter meet
    lines on their rarest run of seven, so that codes which begin alike do not meet every line. The headquarters' code goes
    where there is another one; codes that are postal codes come last, long ones first.
    """
    lines = lambda c, part: F.transform(F.split(c, "\r?\n"), lambda x: F.struct(F.lit(part).alias("part"), _code_key(x).alias("line")))
    rows = searched.select("doc_id", "wholesaler", F.posexplode(F.concat(lines(tx.ship_to_block(F.col("plain")), 0), lines(F.col("plain"), 1))).alias("at", "l")).select("doc_id", "wholesaler", "at", "l.*").where("line <> ''")
    codes = dest.where("d_key <> ''").select("d_key", "d_code", "d_wholesaler")
    runs = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - LEAST + 1), lambda i: F.substring(c, i, F.lit(LEAST)))
    grams = codes.where(F.length("d_key") >= LEAST).select("d_key", F.explode(F.array_distinct(runs(F.col("d_key")))).alias("gram")).distinct()
    rarest = grams.join(grams.groupBy("gram").count(), "gram").groupBy("d_key").agg(F.min(F.struct("count", "gram")).alias("m")).select("d_key", F.col("m.gram").alias("gram"))
    inside = rows.where(F.length("line") >= LEAST).select("*", F.explode(F.array_distinct(runs(F.col("line")))).alias("gram")).join(rarest, "gram").where(F.contains("line", F.col("d_key"))).drop("gram")
    whole = rows.withColumn("d_key", F.col("line"))
    met = inside.unionByName(whole).join(codes, "d_key").where(_in_scope())
    one = met.groupBy("doc_id", "part", "at").agg(F.min(F.struct((-F.length("d_code")).alias("size"), "d_code", "d_key")).alias("m"))
    each = one.groupBy("doc_id", "part", "m.d_code", "m.d_key").agg(F.min("at").alias("at"))
    key = F.struct(F.col("d_code").rlike(_POSTAL_CODE).alias("late"), (-F.length("d_code")).alias("size"), "at", "d_code", (F.col("d_key") == HEADQUARTERS).alias("head"))
    per = each.groupBy("doc_id", "part").agg(F.array_sort(F.collect_list(key)).alias("codes"))
    best = per.groupBy("doc_id").agg(F.min_by("codes", "part").alias("codes"))
    others = F.filter("codes", lambda x: ~x["head"])
    return best.select("doc_id", F.transform(F.when(F.size(others) > 0, others).otherwise(F.col("codes")), lambda x: x["d_code"]).alias("codes"))


def _said(rows: DataFrame, step: int, method: str, code: Column, ok: Column, reasons: list[Column], order: Column | None = None) -> DataFrame:
    """Evidence of a step: doc_id, and e: its place, whether it decides, code, method, reasons."""
    kept = F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")
    e = F.struct(F.lit(step).alias("step"), (F.lit(0) if order is None else order).cast("int").alias("place"), ok.alias("ok"), code.alias("code"), F.lit(method).alias("method"), kept.alias("reasons"))
    return rows.select("doc_id", e.alias("e"))


def _candidates(rows: DataFrame) -> DataFrame:
    """doc_id, n, best (a destination or null), ambiguous: which of a document's candidates its address, else its phone number, speaks for."""
    scored = rows.withColumn("score", address_score())
    c = F.struct(
        (-F.col("score")).alias("minus"), (-F.length("d_key")).alias("size"), "d_code", "d_label", "d_postal", "score", compatible().alias("fits"), ((F.col("tel") != "") & (F.col("d_tel") == F.col("tel"))).alias("called"), F.struct("d_address", "d_tel").alias("place")
    )
    got = scored.groupBy("doc_id").agg(F.array_sort(F.collect_set(c)).alias("c"))
    called = F.filter("c", lambda x: x["called"])
    ahead = lambda a: (F.get(a, F.lit(0))["score"] > 0) & (F.get(a, F.lit(0))["score"] > F.get(a, F.lit(1))["score"])
    one, twins = F.size("c") == 1, F.size(F.array_distinct(F.transform("c", lambda x: x["place"]))) < F.size("c")
    first = lambda a: F.get(a, F.lit(0))
    best = F.when(one, F.when(first(F.col("c"))["fits"], first(F.col("c")))).when(twins, F.lit(None)).when(ahead(F.col("c")), first(F.col("c")))
    best = best.when((F.size(called) == 1) | ((F.size(called) > 1) & ahead(called)), first(called))
    return got.select("doc_id", F.size("c").alias("n"), best.alias("best"), (~one & best.isNull()).alias("ambiguous"))


def resolve(documents: DataFrame, destinations: DataFrame) -> DataFrame:
    """doc_id, code, method (code, centerName, postal, tel or none), needs_review, reasons: what the first step that decides says.

    Only destinations of the document's wholesaler count where it has one. Without a destination the method is none and the
    document needs a review. Documents without text or with nulls are as empty ones.
    """
    dest, docs = prepared(destinations), _searched(documents)
    scoped = docs.select("doc_id", "wholesaler", "key", "postals", "found_tel", "tel", "given", "center")
    known = dest.select(F.col("d_wholesaler").alias("wholesaler")).distinct()
    stray = _said(docs.where("wholesaler <> ''").join(known, "wholesaler", "left_anti"), -1, "none", F.lit(None).cast("string"), F.lit(True), [_reason("unregistered", F.col("wholesaler"))])

    codes = found_codes(docs, dest)
    several = _said(codes.where(F.size("codes") > 1), 0, "none", F.lit(None).cast("string"), F.lit(False), [_reason("several", F.array_join("codes", " / "))])
    first = dest.select(F.col("d_key"), F.struct((-F.length("d_code")).alias("size"), "d_code", "d_label", "d_postal", "d_code_postal", "d_tel", "d_address", "d_names").alias("d"), "d_wholesaler")

    def by_code(rows: DataFrame, step: int) -> DataFrame:
        """rows: scoped documents with d_key and at. The longest code of each key counts."""
        met = rows.join(first, "d_key").where(_in_scope())
        one = met.groupBy("doc_id", "at", "d_key").agg(F.min("d").alias("d"), *[F.first(c).alias(c) for c in ("key", "postals", "found_tel")]).select("doc_id", "at", "d_key", "key", "postals", "found_tel", "d.*")
        one = one.withColumn("score", address_score())
        fits = (F.col("d_code_postal") == "") | compatible()
        told = F.when(~fits, _reason("other_address", F.col("d_code"), F.col("d_label"))).when(F.col("d_key") == HEADQUARTERS, _reason("headquarters"))
        return _said(one, step, "code", F.col("d_code"), fits, [told], F.col("at"))

    listed = codes.select("doc_id", F.posexplode("codes").alias("at", "_code")).join(dest.select(F.col("d_code").alias("_code"), "d_key").distinct(), "_code")
    one = by_code(listed.join(scoped, "doc_id"), 1)
    two = by_code(scoped.where("given <> ''").select("*", F.col("given").alias("d_key"), F.lit(0).alias("at")), 2)

    named = dest.select("*", F.explode(F.array_distinct("d_centers")).alias("d_center")).where("d_center <> ''")
    pairs = _meet(scoped.where("center <> ''").select("center").distinct(), "center", named.select("d_center").distinct(), "d_center")
    near = scoped.join(pairs, "center").join(named, "d_center").where(_in_scope())
    points = F.when(F.col("d_center") == F.col("center"), 100).when((F.length("d_center") >= 8) & (F.contains("center", F.col("d_center")) | F.contains("d_center", F.col("center"))), 80).when((F.length("d_center") >= 6) & F.contains("center", F.col("d_center")), 60)
    scored = near.withColumn("points", points).where("points IS NOT NULL").withColumn("score", address_score())
    # The best of a destination's names, then the two best destinations.
    per = scored.groupBy("doc_id", "d_code", "d_wholesaler").agg(F.max("points").alias("points"), F.max("d_label").alias("d_label"), F.max(compatible()).alias("fits"))
    by = Window.partitionBy("doc_id").orderBy(F.desc("points"), "d_code")
    ranked = per.withColumn("r", F.row_number().over(by)).withColumn("next", F.lead("points").over(by)).where("r = 1")
    ahead = F.col("next").isNull() | (F.col("points") >= F.col("next") + LEAD)
    told = F.when(~ahead, _reason("several_names")).when(F.col("fits"), _reason("by_name")).otherwise(_reason("name_address", F.col("d_label")))
    three = _said(ranked, 3, "centerName", F.col("d_code"), ahead & F.col("fits"), [told])

    by_postal = _candidates(scoped.withColumn("d_postal", F.explode("postals")).join(dest.where("d_postal <> ''"), "d_postal").where(_in_scope()))
    best = F.col("best")
    fits = F.coalesce(best["fits"], F.lit(False))
    told = F.when(F.col("ambiguous"), _reason("several_postal")).when(best.isNotNull() & ~fits, _reason("postal_address", best["d_postal"], best["d_label"])).when(fits & (F.col("n") > 1), _reason("by_postal", best["d_code"]))
    four = _said(by_postal, 4, "postal", best["d_code"], fits, [told])
    by_tel = _candidates(scoped.where("found_tel <> ''").withColumn("d_tel", F.col("found_tel")).join(dest, "d_tel").where(_in_scope()))
    told = F.when(F.col("ambiguous"), _reason("several_tel")).when(best.isNotNull() & ~fits, _reason("tel_address", best["d_label"]))
    five = _said(by_tel, 5, "tel", best["d_code"], fits, [told])

    every = stray
    for step in (several, one, two, three, four, five):
        every = every.unionByName(step)
    evidence = every.groupBy("doc_id").agg(F.array_sort(F.collect_list("e")).alias("e"))
    both = docs.select("doc_id", "center").join(evidence, "doc_id", "left").join(codes, "doc_id", "left")
    e = F.coalesce("e", F.array().cast(evidence.schema["e"].dataType))
    at = F.array_position(F.transform(e, lambda x: x["ok"]), True).cast("int")
    hit = F.get(e, at - 1)
    none = F.when(F.col("codes").isNull() & (F.col("center") == ""), _reason("not_found")).otherwise(_reason("not_registered"))
    reasons = F.flatten(F.transform(F.when(at > 0, F.slice(e, F.lit(1), F.greatest(at, F.lit(0)))).otherwise(e), lambda x: x["reasons"]))
    found = (at > 0) & hit["code"].isNotNull()
    reasons = F.when(at > 0, reasons).otherwise(F.concat(reasons, F.array(none)))
    out = both.select("doc_id", F.when(found, hit["code"]).alias("code"), F.when(found, hit["method"]).otherwise("none").alias("method"), reasons.alias("reasons"))
    return out.select("doc_id", "code", "method", ((F.col("method") == "none") | (F.size("reasons") > 0)).alias("needs_review"), "reasons")


def import_review(resolved: DataFrame, has_name: Column, has_address: Column) -> DataFrame:
    """resolved with what an import keeps: of a destination's reasons the serious ones alone, without one all and what is missing besides."""
    serious = F.filter("reasons", lambda r: r.rlike(SERIOUS))
    lacking = F.array_compact(F.array(_reason("not_registered"), F.when(~has_name, _reason("no_name")), F.when(~has_address, _reason("no_address"))))
    kept = F.when(F.col("code").isNotNull(), serious).otherwise(F.concat("reasons", lacking))
    return resolved.withColumn("reasons", kept).withColumn("needs_review", F.col("code").isNull() | (F.size("reasons") > 0))
