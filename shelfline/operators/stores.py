"""Chains of orders and introductions, further steps of store matching, and which imports and rows of stores count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.shared import kept
from .matching import _inside, _meet, memo_chains, name_keys, resolve_locations

#: Names that a sheet cuts short, and parts of the names that they stand for, in order of precedence. Fixed values.
TRUNCATED = {
    "コスメノノワク": ("nonowa",),
    "コスメグラ東京": ("グランスタ",),
    "コスメイクスピ": ("イクスピアリ",),
    "コスメ本厚木": ("本厚木",),
    "コスメ武蔵小金": ("武蔵小金井", "nonowa"),
    "コスメシァル鶴": ("シァル", "鶴見"),
}

#: Chains whose stores an official list names. Fixed values.
OFFICIAL = ("ハンズ", "ロフト", "@cosme STORE", "アインズ")


def order_chains(orders: DataFrame, lines: DataFrame, stores: DataFrame) -> DataFrame:
    """order_id, chain: the saved name, else the chain of the first memo that has one (by line, then text), else of all memos joined, else unknown.

    orders: order_id, saved; lines: order_id, line_no, memo; header-like and blank memos don't count. Memos are matched as
    distinct texts. An order without lines keeps its saved name or is unknown.
    """
    usable = (tx.match_key(F.col("memo")) != "") & ~tx.is_header(tx.memo_key(F.col("memo")))
    found = lines.join(kept(memo_chains(lines.select("memo").distinct().where(usable), stores)), "memo")
    none = F.col("chain") == tx.UNKNOWN
    # Only an order without any chain needs its memos joined: of the others none is gathered.
    memos = F.collect_list(F.when(none, F.struct("line_no", "memo")))
    per = found.groupBy("order_id").agg(F.min_by("chain", F.when(~none, F.struct("line_no", "memo"))).alias("first"), memos.alias("memos"))
    per = kept(per.select("order_id", "first", F.when(F.col("first").isNull(), F.array_join(F.transform(F.array_sort("memos"), lambda x: x["memo"]), " ")).alias("all")))
    open_ = per.where(F.col("first").isNull())
    whole = open_.join(memo_chains(open_, stores, "all").withColumnRenamed("memo", "all"), "all").select("order_id", F.col("chain").alias("whole"))
    saved = F.when(~tx.trim(F.col("saved")).isin("", tx.UNKNOWN), tx.trim(F.col("saved")))
    both = orders.join(per.select("order_id", "first"), "order_id", "left").join(whole, "order_id", "left")
    return both.select("order_id", F.coalesce(saved, "first", "whole", F.lit(tx.UNKNOWN)).alias("chain"))


def series(entries: DataFrame) -> DataFrame:
    """import_id, series: the chain of an import's whole sheet by its format, where it has five entries or more, else empty.

    entries: import_id, format_key, store_code, store_name. A flag list is of ロフト with three such names, or with codes of
    its kind in a fifth of the rows or in ten; an allocation list of @cosme STORE with three such names.
    """
    key = tx.plain_key(F.col("store_name"))
    loft, cosme = (key.contains("ロフト") | key.contains("loft")), (key.contains("cosme") | key.contains(tx._plain("アットコスメ")))
    code = tx.trim(F.col("store_code")).rlike(r"^(2\d{2}|501)$")
    n = entries.groupBy("import_id", "format_key").agg(F.count("*").alias("n"), F.count_if(loft).alias("loft"), F.count_if(code).alias("codes"), F.count_if(cosme).alias("cosme"))
    own = (
        F.when(F.col("n") < 5, "")
        .when(F.col("format_key") == "hands-allocation-list", "ハンズ")
        .when(F.col("format_key") == "ainz-shipment-list", "アインズ")
        .when((F.col("format_key") == "flag-list") & ((F.col("loft") >= 3) | (F.col("codes") >= F.least(F.lit(10), F.ceil(F.col("n") / 5)))), "ロフト")
        .when((F.col("format_key") == "store-allocation-list") & (F.col("cosme") >= 3), "@cosme STORE")
        .otherwise("")
    )
    return n.select("import_id", own.alias("series"))


def introduction_chains(entries: DataFrame, stores: DataFrame) -> DataFrame:
    """Adds matched_chain: what the sheet's format says, else the chain of the entry's name as a memo."""
    of = series(entries)
    memo = memo_chains(entries.select(F.col("store_name").alias("memo")), stores).select(F.col("memo").alias("store_name"), F.col("chain").alias("_memo_chain"))
    code = tx.trim(F.col("store_code")).rlike(r"^(2\d{2}|501)$")
    fixed = (
        F.when(F.col("format_key") == "hands-allocation-list", "ハンズ")
        .when(F.col("format_key") == "ainz-shipment-list", "アインズ")
        .when((F.col("format_key") == "flag-list") & ((F.col("series") == "ロフト") | code), "ロフト")
        .when(F.col("format_key") == "store-allocation-list", "@cosme STORE")
    )
    both = entries.join(of, "import_id", "left").join(memo, "store_name", "left")
    return both.withColumn("matched_chain", F.coalesce(fixed, "_memo_chain", F.lit(tx.UNKNOWN))).drop("series", "_memo_chain")


def chains_to_refresh(entries: DataFrame) -> DataFrame:
    """import_id, chain: the official chains whose lists an import needs anew, by its series, its entries' chains or names."""
    by_entry = entries.where(F.col("matched_chain").isin(*OFFICIAL)).select("import_id", F.col("matched_chain").alias("chain"))
    by_name = entries.where(F.startswith(F.lower(tx.nfkc(F.coalesce("store_name", F.lit("")))), F.lit("hb"))).select("import_id", F.lit("ハンズ").alias("chain"))
    by_series = series(entries).where("series <> ''").select("import_id", F.col("series").alias("chain"))
    return by_entry.unionByName(by_name).unionByName(by_series).distinct()


def newest(imports: DataFrame, read: int, key: str = "client_id") -> DataFrame:
    """The `read` newest imports of each client."""
    w = Window.partitionBy(key).orderBy(F.desc("imported_at"), F.desc("import_id"))
    return imports.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= read).drop("_r")


def latest_by_chain(imports: DataFrame) -> DataFrame:
    """Each client's newest import of every chain; of a client without any chain the newest import."""
    own = F.struct("imported_at", "import_id")
    chain = F.coalesce(tx.trim(F.col("chain_name")), F.lit(""))
    best = imports.groupBy("client_id", chain.alias("_chain")).agg(F.max(own).alias("_best"))
    some = F.max(F.col("_chain") != "").over(Window.partitionBy("client_id"))
    best = best.withColumn("_some", some).where((F.col("_chain") != "") | ~F.col("_some"))
    return imports.join(best.select("client_id", F.col("_best.import_id").alias("import_id")), ["client_id", "import_id"], "left_semi")


def _fragment(a: Column, b: Column, least: int, most: int) -> Column:
    """The longest beginning of a, of least to most characters, that stands in b; 0 without one."""
    return F.coalesce(*[F.when((F.length(a) >= n) & F.contains(b, F.substring(a, 1, n)), n) for n in range(most, least - 1, -1)], F.lit(0))


def _near(a: DataFrame, x: str, b: DataFrame, y: str, n: int, by: list[str]) -> DataFrame:
    """Pairs, equal in the columns `by`, where the first n characters of one text stand in the other, by equi joins on grams of n characters."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(F.col(c), i, F.lit(n))))
    a, b = a.where(F.length(x) >= n), b.where(F.length(y) >= n)
    ahead = a.withColumn("_g", F.substring(x, 1, n)).join(b.withColumn("_g", F.explode(grams(y))), [*by, "_g"])
    behind = a.withColumn("_g", F.explode(grams(x))).join(b.withColumn("_g", F.substring(y, 1, n)), [*by, "_g"])
    return ahead.unionByName(behind).drop("_g").distinct()


def _best(pairs: DataFrame, score: Column, least: int, by: list[str]) -> DataFrame:
    """by, name, store_code: the location of the best score, the first by name and code on ties, from `least` on."""
    best = pairs.withColumn("_s", score).where(F.col("_s") >= least).groupBy(*by, "name").agg(F.min_by("l_code", F.struct(-F.col("_s"), F.col("l_name"), F.col("l_code"))).alias("store_code"))
    return best.select(*by, "name", "store_code")


def _named(locations: DataFrame, by: list[str]) -> DataFrame:
    return locations.select(*by, F.col("store_code").alias("l_code"), F.col("store_name").alias("l_name"), tx.location_key(F.col("store_name")).alias("l_key"))


def cosmetic_matches(names: DataFrame, locations: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """name, store_code: names that start with コスメ to locations of コスメロフト by the longest shared beginning of what follows, 2 to 8 characters."""
    own = names.select(*by, "name").distinct().withColumn("key", tx.location_key(F.col("name"))).where(F.startswith("key", F.lit("コスメ"))).withColumn("core", F.substring("key", 4, 1 << 30)).where(F.length("core") >= 3)
    there = _named(locations, by).where(F.startswith("l_key", F.lit("コスメロフト"))).withColumn("cand", F.substring("l_key", 7, 1 << 30))
    ahead, behind = _fragment(F.col("core"), F.col("cand"), 2, 8), _fragment(F.col("cand"), F.col("core"), 2, 8)
    return _best(_near(own, "core", there, "cand", 2, by), F.when(ahead > 0, ahead).otherwise(behind), 2, by)


def truncated_matches(names: DataFrame, locations: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """name, store_code: names of the list to the first location that holds the first part that any location holds."""
    spark = names.sparkSession
    listed = spark.createDataFrame([(tx._plain(k), i, tx._plain(p)) for k, parts in TRUNCATED.items() for i, p in enumerate(parts)], "key string, rank int, part string")
    parts = F.array(*[F.lit(p) for p in sorted({tx._plain(p) for ps in TRUNCATED.values() for p in ps})])
    there = _named(locations, by).withColumn("part", F.explode(F.filter(parts, lambda p: F.contains("l_key", p)))).groupBy(*by, "part").agg(F.min_by("l_code", F.struct("l_name", "l_code")).alias("store_code"))
    own = names.select(*by, "name").distinct().withColumn("key", tx.location_key(F.col("name")))
    met = own.join(F.broadcast(listed), "key").join(there, [*by, "part"])
    return met.groupBy(*by, "name").agg(F.min_by("store_code", "rank").alias("store_code"))


def hands_key(c: Column) -> Column:
    return _hands(tx.location_key(c))


def _hands(key: Column) -> Column:
    """A plain name as the chain ハンズ writes it. Fixed values."""
    out = key
    for pattern, by in (("^hb", "ハンズビー"), ("ハンズビーハンズ", "ハンズ"), ("city", "シティ"), ("northgate", ""), ("パルコシティ", ""), (r"\d+店$", ""), ("店$", "")):
        out = F.regexp_replace(out, pattern, by)
    return out


def hands_matches(names: DataFrame, locations: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """name, store_code: names to locations of ハンズ: equal keys, one inside the other, else the longest shared beginning of 4 to 10 characters."""
    own = names.select(*by, "name").distinct().withColumn("key", hands_key(F.col("name"))).where(F.length("key") >= 3)
    there = _named(locations, by).where(F.startswith("l_code", F.lit("hands-")) | F.contains("l_key", F.lit("ハンズ"))).withColumn("cand", hands_key(F.col("l_name"))).where("cand <> ''")
    pairs = _near(own, "key", there, "cand", 4, by).unionByName(_meet(own, "key", there, "cand", by)).distinct()
    k, c = F.col("key"), F.col("cand")
    ahead = _fragment(k, c, 4, 10)
    score = F.when(k == c, 1000).when(F.contains(k, c) | F.contains(c, k), F.least(F.length(k), F.length(c)) + 100).when(ahead > 0, ahead).otherwise(_fragment(c, k, 4, 10))
    return _best(pairs, score, 4, by)


def store_candidates(names: DataFrame, locations: DataFrame, introduced: DataFrame | None = None, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, name, store_code, stage: the one location whose name holds the name, after filters that each apply only if they leave something.

    Locations of ハンズビー go unless the name speaks of them or no other is there. Stage 1: one is left. 2: one whose name is
    the place alone. 3: one of the introduced codes. 4: one that is both. A name with SQ also stands for its two long forms.
    introduced: store_code. Candidates are counted by kind and never gathered, so a name that many locations hold costs no
    more than its rows. Names that are blank or have no single location are left out.
    """
    own = names.select(*by, "name").distinct().withColumn("q", tx.location_key(F.col("name"))).where("q <> ''")
    long_ = F.when(F.col("q").rlike("sq|エスキュ"), F.array(*[F.regexp_replace("q", "sq|エスキュ", x) for x in ("スクエア", "スクランブルスクエア")])).otherwise(F.array().cast("array<string>"))
    asked = kept(own.withColumn("asked", F.explode(F.array_distinct(F.concat(F.array("q"), long_)))))
    there = kept(_named(locations, by).where("l_key <> ''"))
    pairs = kept(_inside(asked.select(*by, "asked").distinct(), "asked", there.select(*by, "l_key").distinct(), "l_key", by=by))
    code = F.lower(F.trim("l_code"))
    be = F.startswith(code, F.lit("hands-be_")) | F.startswith(code, F.lit("hands-be-")) | (code == "hands-be") | F.contains("l_key", F.lit("ハンズビー")) | F.startswith("l_key", F.lit("hb"))
    place = F.regexp_replace(F.regexp_replace(_hands(F.col("l_key")), "^ハンズビー", ""), "^ハンズ", "")
    met = asked.join(pairs, [*by, "asked"]).join(there.withColumn("be", be).withColumn("place", place), [*by, "l_key"])
    met = met.groupBy(*by, "name", "q", tx.first_filled(F.col("l_code"), F.col("l_name")).alias("l_id")).agg(F.max(F.struct("l_name", "l_code", "be", "place")).alias("l")).select(*by, "name", "q", "l.*")
    if introduced is not None:
        met = met.join(introduced.select(F.col("store_code").alias("l_code"), F.lit(True).alias("in")).distinct(), "l_code", "left")
    else:
        met = met.withColumn("in", F.lit(None).cast("boolean"))
    exact, known = F.col("place") == F.col("q"), F.coalesce("in", F.lit(False))
    kinds = {"all": F.lit(True), "exact": exact, "in": known, "both": exact & known}
    counted = [x for pool, ok in (("any", F.lit(True)), ("rest", ~F.col("be"))) for kind, test in kinds.items() for x in (F.count_if(ok & test).alias(f"{pool}_{kind}"), F.min(F.when(ok & test, F.col("l_code"))).alias(f"{pool}_{kind}_code"))]
    per = met.groupBy(*by, "name", "q").agg(*counted)
    rest = ~F.col("q").rlike("ビー|^hb") & (F.col("rest_all") > 0)
    of = lambda c: F.when(rest, F.col(f"rest_{c}")).otherwise(F.col(f"any_{c}"))
    stages = F.coalesce(*[F.when(of(kind) == 1, F.struct(F.lit(i).alias("stage"), of(f"{kind}_code").alias("code"))) for i, kind in enumerate(kinds, 1)])
    return per.select(*by, "name", stages.alias("s")).where("s IS NOT NULL").select(*by, "name", F.col("s.code").alias("store_code"), F.col("s.stage").alias("stage"))


#: Codes of one wholesaler's allocation sheets and the pages of the stores that they stand for. Fixed values.
LEGACY = {
    "100": "tsutaya-ebisubashi", "101": "tsutaya-kumamoto", "103": "tsutaya-sapporo", "104": "tsutaya-hakodate", "302": "aeon-takaoka", "303": "aeon-takasaki", "304": "maroot-toyama", "501": "tokyo", "502": "osaka",
    "503": "nagoya", "55": "lumine-shinjuku", "56": "marui-ueno", "61": "lumine-ikebukuro", "62": "lumine-yurakucho", "63": "marui-mizonokuchi", "65": "marui-kobe", "66": "sunshine-ikebukuro", "67": "amuest-hakata",
    "71": "lumine-omiya", "72": "lalaport-fujimi", "73": "newoman-yokohama", "74": "lumine-yokohama", "75": "aeon-urawamisono", "76": "lazona-kawasaki", "77": "lalaport-toyosu", "81": "sydney-kameido",
    "83": "termina-kinshicho", "86": "sapporo-stellarplace", "87": "kanazawa-forus", "88": "newoman-takanawa", "89": "mozo-wondercity", "600": "misugi-temmabashi", "601": "misugi-namba",
}


def legacy_codes(spark: SparkSession) -> DataFrame:
    """code, official."""
    return spark.createDataFrame([(k, f"atcosme-{v}") for k, v in LEGACY.items()], "code string, official string")


def first_with_address(rows: DataFrame) -> DataFrame:
    """One row of each chain and code, or chain and name without a code: the first with an address, else the first by `ord`."""
    chain = tx.trim(F.col("chain_name"))
    name = F.coalesce(F.nullif(tx.location_key(F.col("store_name")), F.lit("")), "store_name")
    key = F.concat(F.when(chain != "", F.concat(chain, F.lit("::"))).otherwise(""), F.when(F.coalesce("store_code", F.lit("")) != "", F.concat(F.lit("code:"), "store_code")).otherwise(name))
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    best = rows.groupBy(key.alias("_key")).agg(F.min(F.struct((F.coalesce("address", F.lit("")) == "").alias("none"), F.col("ord"), row.alias("row"))).alias("b"))
    return best.select("b.row.*")


def one_matrix_row(rows: DataFrame) -> DataFrame:
    """One row of each `key`, read in the order of `ord`: a later row takes over if it is the first introduced or the first with an address.

    rows: key, ord, introduced, address. A row with both stays. Without one, rows with one of the two take over from each
    other, so what stays is the first row of its kind after the last of the other kind. That needs minima and maxima only,
    so a key's rows never meet in one task.
    """
    has = F.coalesce(F.col("address"), F.lit("")) != ""
    kind = F.when(F.col("introduced") & has, 3).when(F.col("introduced"), 2).when(has, 1).otherwise(0)
    rows = rows.withColumn("_kind", kind)
    last = rows.groupBy("key").agg(*[F.max(F.when(F.col("_kind") == k, F.col("ord"))).alias(f"_last{k}") for k in (1, 2)], F.max(F.when(F.col("_kind") == 3, True)).alias("_both"))
    low, high = F.coalesce("_last1", F.lit(-1)), F.coalesce("_last2", F.lit(-1))
    own = F.when(F.col("_both"), F.col("_kind") == 3).when((low < 0) & (high < 0), True).when(low > high, (F.col("_kind") == 1) & (F.col("ord") > high)).otherwise((F.col("_kind") == 2) & (F.col("ord") > low))
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "_kind"])
    return rows.join(last, "key").where(own).groupBy("key").agg(F.min(F.struct(F.col("ord"), row.alias("row"))).alias("b")).select("b.row.*")


def by_wholesaler(destinations: DataFrame, name: str) -> DataFrame:
    """The destinations of a wholesaler: the stored one, else what code, name and aliases tell; all for an empty name."""
    text = F.concat_ws(" ", "code", "name", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "))
    return destinations if not name else destinations.where(tx.first_filled(F.col("wholesaler_name"), tx.wholesaler(text)) == name)


def search_chains(stores: DataFrame, query: str) -> DataFrame:
    """Chains whose name or one of whose aliases holds the text, in any case."""
    q = query.strip().lower()
    inside = lambda c: F.contains(F.lower(c), F.lit(q))
    return stores.where(F.lit(not q) | inside(F.col("name")) | F.exists("aliases", inside))


def search_products(products: DataFrame, clients: DataFrame, query: str, client: str = "all") -> DataFrame:
    """A client's products, or all, that hold the text in JAN, names, SKU or the client's name joined by blanks, in any case."""
    named = products.join(clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name")), "client_id", "left")
    text = F.lower(F.array_join(F.transform(F.array("jan", "name", "internal_sku", "client_name"), lambda x: F.coalesce(x, F.lit(""))), " "))
    return named.where((F.lit(client == "all") | (F.col("client_id") == client)) & F.contains(text, F.lit(query.strip().lower())))


def product_export(products: DataFrame, picks: DataFrame | None = None) -> DataFrame:
    """Ordered columns of the product master's export, of the picked keys (client_id, jan) or of all: one text for each cell."""
    own = products if picks is None else products.join(picks, ["client_id", "jan"], "left_semi")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return own.select("client_id", "jan", text("name").alias("name"), text("internal_sku").alias("sku"), text("category").alias("category"), text("wholesale_price").alias("wholesale"), text("retail_price").alias("retail"))


def by_code(locations: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, alias, store_code, store_name: every form of a code; of locations that share one, the last by name and code."""
    from .sheets import code_aliases  # sheets are read with this module's names

    every = locations.select(*by, "store_code", "store_name", F.explode(code_aliases(F.col("store_code"))).alias("alias")).where("alias <> ''")
    return every.groupBy(*by, "alias").agg(F.max_by(F.struct("store_code", "store_name"), F.struct("store_name", "store_code")).alias("l")).select(*by, "alias", "l.*")


def resolve_stores(entries: DataFrame, locations: DataFrame, legacy: DataFrame | None = None, introduced: DataFrame | None = None, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, store_name, store_code, step, matched_code for each distinct one of the entries: the whole cascade, over the locations
    that are equal in the columns `by`.

    Steps: 1 a legacy code (legacy: code, official; LEGACY without it), 2 an equal name key, 3 a loosely equal name, 4 コスメ to コスメロフト, 5 a
    name cut short, 6 ハンズ, 7 a code of more than four digits or other form, in any of its forms, 8 such a code of two to four
    digits if the names agree, 9 the one candidate of store_candidates(), which may look at the introduced codes. The first
    step that finds one wins. An entry without a name has its code alone; null names and codes are empty. Each step is
    checkpointed: in one plan the cascade is too large for a small driver.
    """
    pair = [*by, "store_name", "store_code"]
    own = kept(entries.select(*by, F.coalesce("store_name", F.lit("")).alias("store_name"), F.coalesce("store_code", F.lit("")).alias("store_code")).distinct())
    locations = kept(locations.select(*by, "store_code", "store_name"))
    base = kept(resolve_locations(own, locations, by).select(*pair, F.col("step").alias("_step"), F.col("matched_code").alias("_code")))
    names = kept(own.select(*by, F.col("store_name").alias("name")).distinct())
    parts = [(4, cosmetic_matches), (5, truncated_matches), (6, hands_matches)]
    out = own.join(base, pair, "left")
    for n, f in parts:
        out = out.join(kept(f(names, locations, by).select(*by, F.col("name").alias("store_name"), F.col("store_code").alias(f"_c{n}"))), [*by, "store_name"], "left")
    coded = kept(by_code(locations, by).select(*by, F.col("alias").alias("_alias"), F.col("store_code").alias("_c7"), F.col("store_name").alias("_n7")))
    out = out.withColumn("_alias", F.nullif("store_code", F.lit(""))).join(coded, [*by, "_alias"], "left")
    legacy = legacy_codes(entries.sparkSession) if legacy is None else legacy
    official = legacy.join(coded, F.col("official") == F.col("_alias")).select(*by, F.col("code").alias("_legacy"), F.col("_c7").alias("_c1"))
    out = out.withColumn("_legacy", F.trim("store_code")).join(official, [*by, "_legacy"], "left")
    only = kept(store_candidates(names, locations, introduced, by).select(*by, F.col("name").alias("store_name"), F.col("store_code").alias("_c9")))
    out = out.join(only, [*by, "store_name"], "left")
    short = F.trim("store_code").rlike("^[0-9]{2,4}$")
    agree = F.arrays_overlap(name_keys(tx.location_key(F.col("store_name"))), name_keys(tx.location_key(F.col("_n7"))))
    steps = [F.col("_c1"), F.when(F.col("_step") == 1, F.col("_code")), F.when(F.col("_step") == 2, F.col("_code")), F.col("_c4"), F.col("_c5"), F.col("_c6"), F.when(~short, F.col("_c7")), F.when(short & agree, F.col("_c7")), F.col("_c9")]
    step = F.coalesce(*[F.when(c.isNotNull(), i) for i, c in enumerate(steps, 1)])
    return kept(out.select(*pair, step.alias("step"), F.coalesce(*steps).alias("matched_code")))


def introduced_codes(entries: DataFrame, imports: DataFrame, locations: DataFrame) -> DataFrame:
    """store_code: the locations of the introduced entries of each chain's newest import."""
    own = entries.where("is_introduced").join(latest_by_chain(imports).select("import_id"), "import_id", "left_semi")
    return resolve_stores(own, locations).where(F.col("matched_code").isNotNull()).select(F.col("matched_code").alias("store_code")).distinct()


def sellout_locations(entries: DataFrame, locations: DataFrame) -> DataFrame:
    """retailer, store_code, store_name, matched_code of each distinct triple: a short code of ロフト is its official one, else the cascade decides."""
    own = entries.select("retailer", F.coalesce("store_code", F.lit("")).alias("store_code"), F.coalesce("store_name", F.lit("")).alias("store_name")).distinct()
    loft = own.where((F.col("retailer") == "ロフト") & F.trim("store_code").rlike("^[0-9]{2,4}$")).withColumn("official", F.concat(F.lit("loft-"), F.trim("store_code")))
    loft = loft.join(locations.select(F.col("store_code").alias("official")).distinct(), "official").select("retailer", "store_code", "store_name", "official")
    rest = resolve_stores(own, locations).select("store_name", "store_code", F.col("matched_code").alias("_m"))
    out = own.join(loft, ["retailer", "store_code", "store_name"], "left").join(rest, ["store_name", "store_code"], "left")
    return out.select("retailer", "store_code", "store_name", F.coalesce("official", "_m").alias("matched_code"))


def enriched(rows: DataFrame, locations: DataFrame) -> DataFrame:
    """Rows (store_code, store_name, address) with the matched location's name and, where it has them, code and address."""
    found = resolve_stores(rows, locations).where("matched_code IS NOT NULL").select(F.col("store_name").alias("_n"), F.col("store_code").alias("_c"), "matched_code")
    there = locations.select(F.col("store_code").alias("matched_code"), F.col("store_name").alias("_name"), F.col("address").alias("_address"))
    out = rows.join(found, (F.coalesce("store_name", F.lit("")) == F.col("_n")) & (F.coalesce("store_code", F.lit("")) == F.col("_c")), "left").join(there, "matched_code", "left")
    first = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    out = out.withColumn("store_code", first(F.col("store_code"), F.col("matched_code"))).withColumn("store_name", F.coalesce("_name", "store_name")).withColumn("address", first(F.col("_address"), F.col("address")))
    return out.drop("matched_code", "_n", "_c", "_name", "_address")


def row_chain(code: Column, name: Column, chain: Column, wanted: str = "all") -> Column:
    """The chain of a matrix row: what code or name stand for, else its own, else the one that was asked for."""
    return tx.first_filled(tx.inferred_chain(code, name), tx.trim(chain), "" if wanted == "all" else wanted)


def matrix_rows(entries: DataFrame, locations: DataFrame) -> DataFrame:
    """Rows of a matrix of stores: of chains with an official list its locations, of others the entries' stores, enriched; each store once.

    entries: chain_name, store_code, store_name, ord.
    """
    chains = entries.select(tx.trim(F.col("chain_name")).alias("chain_name")).where("chain_name <> ''").distinct()
    listed = locations.where(F.col("chain_name").isin(*OFFICIAL)).join(chains, "chain_name", "left_semi").select("chain_name", "store_code", "store_name", "address", F.lit(0).cast("long").alias("ord"))
    official = listed.select("chain_name").distinct()
    own = entries.withColumn("chain_name", tx.trim(F.col("chain_name"))).where("chain_name <> ''").join(official, "chain_name", "left_anti")
    own = enriched(own.select("chain_name", "store_code", "store_name", F.lit("").alias("address"), "ord"), locations)
    return listed.unionByName(first_with_address(own.select(*listed.columns)))


def report_options(entries: DataFrame) -> DataFrame:
    """kind, value: the products and chains that a report of introductions offers."""
    chain = tx.trim(F.col("chain_name"))
    products = entries.where("is_introduced").select(F.lit("product").alias("kind"), tx.first_filled(F.col("product_name"), F.col("jan")).alias("value"))
    return products.unionByName(entries.where((chain != "") & (chain != tx.UNKNOWN)).select(F.lit("chain").alias("kind"), chain.alias("value"))).distinct()


def numbered(rows: DataFrame, order: list[str | Column]) -> DataFrame:
    """Rows in a total order, with their place in it: a list's sort made visible. Only places within runs of equal first keys meet in a task."""
    first, own = order[0], Window.partitionBy(order[0]).orderBy(*order[1:])
    sizes = rows.groupBy(first).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return rows.withColumn("_r", F.row_number().over(own)).join(before, first).withColumn("place", F.col("_before") + F.col("_r")).drop("_r", "_before")
