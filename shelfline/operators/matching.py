"""Untidy store names to chains, channels and store locations. Matching runs on distinct names, which are joined back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as tx
from ..sources.shared import kept

#: Parts that a store's name is compared with and without. Fixed values.
PREFIXES = ("カラフルタウン", "カラフル", "ゆめタウン", "コスメロフト", "コスメ", "東京", "池袋", "プラグスマーケット", "ハンズビー", "ハンズ", "hands", "hb", "ロフト", "loft")
SUFFIXES = ("インターパークロフト", "サンシャインシティロフト", "バンパクロフト", "ミロード店", "パルコロフ", "ロフト", "loft", "ロフ", "店")

#: Memo words that decide the chain before the dictionary is asked. Fixed values.
FIRST_CHAINS = (("ロフト", ("ロフト", "loft")), ("ハンズ", ("ハンズ", "tokyuhands", "hands")), ("アインズ", ("アインズ", "ainz")), ("ミモザ", ("イナイミモザ", "ミモザ")), ("ドン・キホーテ", ("ドンキ", "donki")))

#: Chains of each channel, channels in order of precedence. Fixed values.
CHANNELS = {
    "variety": ("ロフト", "ハンズ", "東急ハンズ", "アインズ", "PLAZA", "プラザ", "アットコスメ", "@cosme", "@cosme STORE", "アットコスメストア", "インキューブ", "ミモザ", "アフタヌーンティー", "アミング", "京王アートマン", "アートマン", "R.O.U", "ショップイン", "ネットストア"),
    "drugstore": (
        "マツモトキヨシ", "マツキヨ", "ココカラファイン", "ウエルシア", "ウェルシア", "ツルハドラッグ", "ツルハ", "サンドラッグ", "スギ薬局", "スギドラッグ", "コクミンドラッグ", "コクミン", "トモズ", "クリエイト", "セイムス",
        "カワチ薬品", "クスリのアオキ", "ドラッグストアモリ", "ドラモリ", "コスモス薬品", "キリン堂", "サツドラ", "ウォンツ", "ザグザグ", "杏林堂", "V・drug", "ブイドラッグ",
    ),
    "discount": ("ドン・キホーテ", "ドンキホーテ", "ドンキ", "メガドンキ", "MEGAドン・キホーテ"),
    "gms": ("イオン", "イトーヨーカドー", "ヨーカドー", "西友", "イズミ", "ゆめタウン", "平和堂", "アル・プラザ"),
    "cvs": ("セブンイレブン", "セブン-イレブン", "ファミリーマート", "ファミマ", "ローソン", "ミニストップ", "デイリーヤマザキ", "ナチュラルローソン"),
}

#: Words that tell the channel where no chain did. Fixed values.
CHANNEL_WORDS = (("variety", ("ロフト", "loft", "ハンズ")), ("drugstore", ("ドラッグ", "薬局", "薬品")), ("discount", ("ドンキ",)), ("gms", ("イオン", "ヨーカドー", "西友")), ("cvs", ("セブン", "ファミリ", "ローソン", "ミニストップ")))


@F.pandas_udf(ArrayType(StringType()))
def name_keys(values: pd.Series) -> pd.Series:
    """Keys of normalised names, the name first: without leading parts, without trailing parts, without both."""

    def keys(name: str) -> list[str]:
        if not name:
            return []
        cut = [name] + [name[len(p) :] for p in PREFIXES if name.startswith(p) and len(name) > len(p) + 1]
        both = cut + [v[: -len(s)] for v in dict.fromkeys(cut) for s in SUFFIXES if v.endswith(s) and len(v) > len(s) + 1]
        return [k for i, k in enumerate(dict.fromkeys(both)) if i == 0 or len(k) >= 2]

    return values.fillna("").map(keys)


def chain_dictionary(stores: DataFrame) -> DataFrame:
    """chain, ord, key: every normalised name and alias of the chains (name, aliases, ord)."""
    every = stores.select(F.col("name").alias("chain"), "ord", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    return every.select("chain", "ord", tx.match_key(F.col("alias")).alias("key")).where("key <> ''").distinct()


def merge_chains(default: DataFrame, stored: DataFrame) -> DataFrame:
    """Default chains with the aliases of stored ones that share a normalised name, and the other stored ones."""
    d, s = chain_dictionary(default), chain_dictionary(stored)
    same = s.select(F.col("chain").alias("stored"), "key").join(d.select(F.col("chain").alias("into"), F.col("ord").alias("into_ord"), "key"), "key").groupBy("stored").agg(F.min_by("into", "into_ord").alias("into"))
    both = default.select("name", "aliases", "ord").unionByName(
        stored.join(same, stored.name == same.stored, "left").select(F.coalesce("into", "name").alias("name"), F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("aliases"), (F.col("ord") + 1_000_000).alias("ord"))
    )
    rows = both.select("name", "ord", F.explode(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name"))).alias("a"))
    return rows.groupBy("name").agg(F.array_sort(F.collect_set("a")).alias("aliases"), F.min("ord").alias("ord"))


def memo_chains(memos: DataFrame, stores: DataFrame, memo: str = "memo") -> DataFrame:
    """memo, chain for each distinct memo: the first words that decide, else the best alias, else unknown.

    An alias equal to the memo scores its length + 1000; one that holds the memo or stands in it scores its length; the
    earlier chain wins ties. Candidates meet over two-character grams, so the dictionary may grow without a cross join.
    """
    own = memos.select(F.col(memo).alias("memo")).distinct().withColumn("key", tx.match_key(F.col("memo"))).withColumn("header", tx.is_header(tx.memo_key(F.col("memo"))))
    first = F.lit(None).cast("string")
    for chain, words in reversed(FIRST_CHAINS):
        hit = F.lit(False)
        for w in words:
            hit |= F.contains("key", F.lit(w))
        first = F.when(hit, chain).otherwise(first)
    ok = (F.col("key") != "") & ~F.col("header")
    own = own.withColumn("first", F.when(ok, first))
    names = chain_dictionary(stores).withColumnRenamed("key", "alias")
    open_ = own.where(ok & F.col("first").isNull()).select("memo", "key")
    met = _meet(open_, "key", names, "alias")
    score = F.when(F.col("key") == F.col("alias"), F.length("alias") + 1000).otherwise(F.length("alias"))
    best = met.groupBy("memo").agg(F.max_by("chain", F.struct(score, -F.col("ord"))).alias("best"))
    return own.join(best, "memo", "left").select("memo", F.coalesce("first", "best", F.lit(tx.UNKNOWN)).alias("chain"))


def _grams(c: str, n: int) -> Column:
    """The different grams of up to n characters; of a shorter text the text itself among them."""
    of = lambda k: F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substring(F.col(c), i, F.lit(k)))
    return F.array_distinct(F.concat(*[F.when(F.length(c) >= k, of(k)).otherwise(F.array().cast("array<string>")) for k in range(1, n + 1)]))


def _inside(a: DataFrame, x: str, b: DataFrame, y: str, n: int = 4, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Pairs where y holds x, of rows equal in the columns `by`. They meet on that gram of x, of n characters or all of a shorter
    one, which the fewest y hold.

    A gram of x that no y holds rules x out. Names that share their beginning so meet on what tells them apart.
    """
    size = F.least(F.length(x), F.lit(n))
    own = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - size + 1), lambda i: F.substring(F.col(x), i, size)))
    # No y holds an x that is longer than all of them, and grams that no x has rule nothing out.
    longest = b.groupBy(*by).agg(F.max(F.length(y)).alias("_most")).where("_most > 0")
    a_ = a.where(F.length(x) > 0).select(*by, x).distinct()
    a_ = (a_.join(longest, by) if by else a_.crossJoin(longest)).where(F.length(x) <= F.col("_most")).select(*by, x)
    asked_of = a_.select(*by, x, F.explode(own).alias("_g"))
    held = b.where(F.length(y) > 0).select(*by, y).distinct().withColumn("_g", F.explode(_grams(y, n))).join(asked_of.select(*by, "_g").distinct(), [*by, "_g"], "left_semi")
    count = held.groupBy(*by, "_g").agg(F.count("*").alias("_n"))
    asked = asked_of.join(count, [*by, "_g"], "left")
    rare = asked.groupBy(*by, x).agg(F.min_by("_g", F.struct("_n", "_g")).alias("_g"), F.count_if(F.col("_n").isNull()).alias("_none")).where("_none = 0").select(*by, x, "_g")
    pairs = rare.join(held, [*by, "_g"]).where(F.contains(F.col(y), F.col(x))).select(*by, x, y)
    return a.join(pairs, [*by, x]).join(b, [*by, y])


def _meet(a: DataFrame, x: str, b: DataFrame, y: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Pairs where one text holds the other, of rows equal in the columns `by`."""
    both = [*a.columns, *[c for c in b.columns if c not in by]]
    return _inside(a, x, b, y, by=by).select(*both).unionByName(_inside(b, y, a, x, by=by).select(*both)).distinct()


def channels(stores: DataFrame, name: str = "store_name", matched: str = "matched_store_name") -> DataFrame:
    """name, matched, channel for each distinct pair of names: the first channel with a chain that holds a name or stands in it."""
    clean = lambda c: F.when(F.coalesce(F.col(c), F.lit("")).isin("", tx.UNKNOWN), "").otherwise(tx.match_key(F.col(c)))
    flat = stores.select(name, matched).distinct().withColumn("_a", clean(name)).withColumn("_b", clean(matched))
    words = stores.sparkSession.createDataFrame([(i, c, n) for i, (c, ns) in enumerate(CHANNELS.items()) for n in ns], "rank int, channel string, name string")
    keys = [(r.rank, r.channel, r.key) for r in words.select("rank", "channel", tx.match_key(F.col("name")).alias("key")).collect()]  # the fixed list above
    none = (F.col("_a") == "") & (F.col("_b") == "")
    out = F.when(none, "other")
    for c in CHANNELS:
        hit = F.lit(False)
        for _, _, key in sorted(k for k in keys if k[1] == c):
            for t in ("_a", "_b"):
                hit |= (F.col(t) != "") & (F.contains(F.col(t), F.lit(key)) | F.contains(F.lit(key), F.col(t)))
        out = out.when(hit, c)
    both = F.concat("_a", "_b")
    for c, ws in CHANNEL_WORDS:
        hit = F.lit(False)
        for w in ws:
            hit |= F.contains(both, F.lit(w))
        out = out.when(hit, c)
    return flat.select(name, matched, out.otherwise("other").alias("channel"))


def channel_summary(entries: DataFrame) -> DataFrame:
    """Distinct introduced stores, and how many of them each channel has."""
    own = entries.where("is_introduced").select("matched_store_name", "store_code", "store_name").distinct()
    found = channels(own).withColumnsRenamed({"store_name": "_n", "matched_store_name": "_m"})
    named = own.join(found, own.store_name.eqNullSafe(found["_n"]) & own.matched_store_name.eqNullSafe(found["_m"]))
    return named.agg(F.count("*").alias("introduced"), *[F.count_if(F.col("channel") == c).alias(c) for c in CHANNELS])


def lookup(locations: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, key, store_code, store_name, the first location by name and code for each name key."""
    w = Window.partitionBy(*by, "key").orderBy("store_name", "store_code")
    keyed = locations.select(*by, "store_code", "store_name", F.explode(name_keys(tx.location_key(F.col("store_name")))).alias("key"))
    return keyed.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def resolve_locations(entries: DataFrame, locations: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, store_name, store_code, step, matched_code for each distinct one of the entries; step and code are null without a match.
    Entries meet locations that are equal in the columns `by`.

    Steps: 1 an equal name key (the entry's keys in order), 2 a loosely equal name (a prefix, an inclusion of four or more
    characters, or the first six inside), 3 the code (short numbers are a sheet's own and count only if names agree), 4 the
    only location whose name holds the entry's. The first step that finds one wins; within it the first key, then the
    first location by name and code. What several steps read is checkpointed, so that no plan holds another one many times.
    """
    by_name = kept(lookup(locations, by).select(*by, "key", F.col("store_name").alias("l_name"), F.col("store_code").alias("l_code")))
    pair = [*by, "store_name", "store_code"]
    own = kept(entries.select(*pair).distinct().withColumn("name", tx.location_key(F.col("store_name"))))
    keys = kept(own.select(*pair, F.posexplode(name_keys(F.col("name"))).alias("pos", "key")))
    first = F.min_by("l_code", F.struct("pos", "l_name", "l_code"))

    exact = kept(keys.join(by_name, [*by, "key"]).groupBy(*pair).agg(first.alias("code1")))
    left = kept(keys.join(exact.select(*pair), pair, "left_anti").where(F.length("key") >= 3))
    loose = kept(_loose(left, by_name.where(F.length("key") >= 3).withColumnRenamed("key", "cand"), by).groupBy(*pair).agg(first.alias("code2")))
    short = F.trim("store_code").rlike("^[0-9]{2,4}$")
    coded = own.where("coalesce(store_code, '') <> ''").join(locations.select(*by, "store_code", F.col("store_name").alias("l_name")), [*by, "store_code"])
    agree = F.arrays_overlap(name_keys(F.col("name")), name_keys(tx.location_key(F.col("l_name"))))
    by_code = coded.where(~short | agree).select(*pair, F.col("store_code").alias("code3"))
    names = kept(locations.select(*by, F.col("store_code").alias("l_code"), tx.location_key(F.col("store_name")).alias("l_key")).where("l_key <> ''"))
    holds = _meet(own.where("name <> ''").select(*pair, "name"), "name", names, "l_key", by).where(F.contains("l_key", F.col("name")))
    unique = kept(holds.groupBy(*pair).agg(F.count_distinct("l_code").alias("n"), F.min("l_code").alias("code4")).where("n = 1").drop("n"))

    out = own.select(*pair)
    for part in (exact, loose, by_code, unique):
        out = out.join(part, pair, "left")
    step = F.when(F.col("code1").isNotNull(), 1).when(F.col("code2").isNotNull(), 2).when(F.col("code3").isNotNull(), 3).when(F.col("code4").isNotNull(), 4)
    return out.select(*pair, step.alias("step"), F.coalesce("code1", "code2", "code3", "code4").alias("matched_code"))


def _loose(keys: DataFrame, names: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Pairs (key, cand) that are loosely equal, of a key only the first location where its first six characters stand.

    Beginnings meet as wholes: each text's beginnings are joined with the other texts. Of equal first six characters, which
    many names share, one stands for all, and only the first location that holds them counts.
    """
    begin = lambda c: F.transform(F.sequence(F.lit(3), F.length(c)), lambda i: F.substring(F.col(c), F.lit(1), i))
    ahead = names.withColumn("key", F.explode(begin("cand"))).join(keys, [*by, "key"])
    behind = keys.withColumn("cand", F.explode(begin("key"))).join(names, [*by, "cand"])
    cores = keys.where(F.length("key") >= 4).select(*by, F.substring("key", 1, 6).alias("core")).distinct()
    first = _inside(cores, "core", names.where(F.length("cand") >= 4), "cand", by=by).groupBy(*by, "core").agg(F.min(F.struct("l_name", "l_code", "cand")).alias("_l")).select(*by, "core", "_l.*")
    inside = keys.where(F.length("key") >= 4).withColumn("core", F.substring("key", 1, 6)).join(first, [*by, "core"]).drop("core")
    around = _inside(names.where(F.length("cand") >= 4), "cand", keys, "key", by=by)
    cols = [*keys.columns, *[c for c in names.columns if c not in by]]
    return ahead.select(*cols).unionByName(behind.select(*cols)).unionByName(inside.select(*cols)).unionByName(around.select(*cols))
