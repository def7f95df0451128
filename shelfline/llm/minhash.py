"""Document fingerprints by one-permutation MinHash, in DataFrame operations only.

Every shingle is hashed once: its low bits name a bin, and each bin keeps its smallest hash. An empty bin takes the
value of the first full bin in a fixed sequence of its own (optimal densification), so that equal sets stay equal and
the chance that two texts agree in a bin stays their Jaccard similarity. Only the low byte of each bin is stored, two
hex digits each; likeness() corrects for bytes that agree by chance.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

BINS = 64
SHINGLE = 5
BITS = 8
RUN = 4000  # rows ordered together, about, when texts meet their next ones
CUTS = 1000  # quantiles of the key, at most, that a plan holds


def _probes(bins: int) -> list[list[int]]:
    """For each bin the bins to take from when it is empty: random ones, with repeats, and in the end every one."""
    out = []
    for i in range(bins):
        r = random.Random(i)
        rest = [*range(bins)]
        r.shuffle(rest)
        out.append([r.randrange(bins) for _ in range(bins)] + rest)
    return out


def words_of(text: Column) -> Column:
    """Lower-cased words between ASCII white space; an empty array for null and blank texts."""
    clean = F.trim(F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", "     "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " +"))


def fingerprints(rows: DataFrame, key: list[str], text: str = "text", out: str = "fingerprint", keep: list[str] = [], bins: int = BINS, shingle: int = SHINGLE) -> DataFrame:  # noqa: B006
    """key, `out`, keep: the packed fingerprint of each row's text, in hex. key must tell the rows apart; keep: columns of
    fixed width that go along, so that a task's aggregation stays in place.

    A text with fewer words than a shingle has one, the whole sequence; a text without words has an empty fingerprint.
    """
    split = rows.select(*key, *keep, words_of(F.col(f"`{text}`")).alias("_w"))
    each = split.select(*key, *keep, "_w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_w") - shingle, F.lit(0)))).alias("_i"))
    h = F.xxhash64(F.least(F.size("_w"), F.lit(shingle)), *[F.get("_w", F.col("_i") + k) for k in range(shingle)])
    hashed = each.select(*key, *keep, (F.size("_w") > 0).alias("_some"), h.alias("_h"))
    hashed = hashed.select(*key, *keep, "_some", F.col("_h").bitwiseAND(F.lit(bins - 1)).cast("int").alias("_b"), F.shiftrightunsigned("_h", (bins - 1).bit_length()).alias("_v"))
    least = hashed.groupBy(*key).agg(F.max("_some").alias("_some"), *[F.max(c).alias(c) for c in keep], *[F.min(F.when(F.col("_b") == b, F.col("_v"))).alias(f"_m{b}") for b in range(bins)])
    mins = F.array(*[F.col(f"_m{b}") for b in range(bins)])
    probes = F.array(*[F.array(*map(F.lit, p)) for p in _probes(bins)])
    filled = least.select(*key, *keep, "_some", mins.alias("_m"), probes.alias("_p")).select(
        *key,
        *keep,
        "_some",
        F.transform("_m", lambda x, i: F.coalesce(x, F.element_at(F.filter(F.transform(F.get("_p", i), lambda j: F.get("_m", j)), lambda y: y.isNotNull()), 1))).alias("_m"),
    )
    digits = F.array_join(F.transform("_m", lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit((1 << BITS) - 1))), 2, "0")), "")
    return filled.select(*key, *keep, F.when(F.col("_some"), F.lower(digits)).otherwise("").alias(out))


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two empty fingerprints are alike, an empty and a full one are not."""
    same = F.lit(0)
    for i in range(bins):
        same += (F.substring(a, 2 * i + 1, 2) == F.substring(b, 2 * i + 1, 2)).cast("int")
    chance = 1 / (1 << BITS)
    corrected = F.greatest(F.lit(0.0), (same / bins - chance) / (1 - chance))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(corrected)


def runs(df: DataFrame, key: str, hash_: str, run: int = RUN, cuts: int = CUTS) -> DataFrame:
    """Adds _run, a struct by whose order rows lie by descending key (null last) and then by `hash_`, in runs of about `run` rows.

    Keys are cut at quantiles, `cuts` at most, and between two of them in equal steps. A key that more rows share than lie
    between quantiles, of which there are `cuts` at most, has runs of its own, cut by ranges of the hash; rows equal in key
    and hash, if there are as many, are cut by a salt, so that their order is that of their salts. No task then orders more
    than a few runs, whatever the number of rows and however often a key or a text repeats.
    """
    n, k, h = df.count(), F.col(f"`{key}`"), F.col(f"`{hash_}`")
    most = max(1, min(-(-n // run), cuts))
    share, parts = max(run, -(-n // most)), max(1, -(-n // most // run))
    often = df.groupBy(k.alias("_k")).agg(F.count("*").alias("_n")).where(F.col("_n") > share).select("_k", F.ceil(F.log2(F.col("_n") / run)).cast("int").alias("_bits")).collect()  # `cuts` rows at most
    same = df.groupBy(k.alias("_sk"), h.alias("_sh")).agg(F.count("*").alias("_n")).where(F.col("_n") > share).select("_sk", "_sh", F.ceil(F.col("_n") / run).cast("int").alias("_salts"))  # as many
    bounds = set(df.agg(F.percentile_approx(k, [i / most for i in range(most + 1)], 100_000).alias("b")).first().b or []) if most > 1 else set()
    bounds = sorted(bounds | {r._k for r in often if r._k is not None}, reverse=True)
    steps = F.array(*map(F.lit, bounds)).cast(f"array<{df.schema[key].dataType.simpleString()}>")
    bits = df.sparkSession.createDataFrame([tuple(r) for r in often], f"_k {df.schema[key].dataType.simpleString()}, _bits int")
    both = df.join(F.broadcast(bits), k.eqNullSafe(F.col("_k")), "left").join(F.broadcast(same), k.eqNullSafe(F.col("_sk")) & h.eqNullSafe(F.col("_sh")), "left")
    above = F.size(F.filter(steps, lambda b: b > k))
    bucket = F.when(k.isNull(), 2 * len(bounds) + 2).otherwise(2 * above + F.col("_bits").isNotNull().cast("int"))
    high, low = F.get(steps, above - 1), F.get(steps, above)
    part = F.when(F.col("_bits").isNull() & k.isNotNull(), F.floor((high - k) / (high - low) * parts)).cast("long")
    own = [F.coalesce(c, F.lit(0).cast("long")) for c in (part, F.call_function("shiftright", h, F.lit(64) - F.col("_bits")), F.pmod(F.monotonically_increasing_id(), F.col("_salts")))]
    return both.select(*[f"`{c}`" for c in df.columns], F.struct(bucket.alias("bucket"), *[c.alias(name) for c, name in zip(own, ("part", "range", "salt"), strict=True)]).alias("_run"))


def following(df: DataFrame, value: str, order: list[Column], first: Column, out: str) -> DataFrame:
    """Adds _place (from 1, within _run) and `out`, the value of the next row; after the last row of all comes the first.

    first: greatest in the row that `order` puts first. Only the first value of each run crosses to the run before it, by a join on the runs.
    """
    own = Window.partitionBy("_run").orderBy(*order)
    placed = df.withColumn("_place", F.row_number().over(own)).withColumn(out, F.lead(value).over(own)).withColumn("_end", F.lead(F.lit(1)).over(own).isNull())
    heads = df.groupBy("_run").agg(F.max_by(value, first).alias("_head"))
    every = Window.orderBy("_r")  # over the numbers of runs alone
    before = F.coalesce(F.lag("_r").over(every), F.last("_r").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    names = df.select(F.col("_run").alias("_r")).distinct().select("_r", before.alias("_to"))
    crossing = heads.join(names, F.col("_run") == F.col("_r")).select("_to", "_head")
    joined = placed.join(crossing, (F.col("_run") == F.col("_to")) & F.col("_end"), "left")
    return joined.withColumn(out, F.when(F.col("_end"), F.col("_head")).otherwise(F.col(out))).drop("_to", "_head", "_end")


def with_next(df: DataFrame, key: str, text: str, out: str = "next_text") -> DataFrame:
    """_run, _place, _key, _text and `out`, the text of the next row in descending order of key, null last; rows that share
    a key lie in the order of their texts' hashes.
    """
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"), F.xxhash64(F.col(f"`{text}`")).alias("_hash"))
    order = [F.col("_key").desc_nulls_last(), F.col("_hash")]
    return following(runs(rows, "_key", "_hash"), "_text", order, F.struct("_key", F.bitwise_not("_hash")), out).drop("_hash")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text. Null texts are empty; rows that share a doc_id, or have none,
    stay apart and lie in the order of their texts' hashes. The only document of a table is its own next one.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(docs, "doc_id", "text").withColumnsRenamed({"_key": "doc_id", "_text": "text"}).withColumn("n_chars", F.length("text").cast("long"))
    edited = paired.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))"), F.expr("substring(next_text, 1, cast(n_chars div 2 as int))")))
    sha = F.sha2("edited", 256)
    parts = [F.conv(F.substring(sha, 16 * i + 1, 16), 16, -10).cast("long").alias(f"_s{i}") for i in range(4)]
    kept = ["doc_id", "n_chars", *[f"_s{i}" for i in range(4)]]
    both = edited.select("_run", "_place", "doc_id", "n_chars", *parts, F.posexplode(F.array("text", "edited")).alias("_which", "text"))
    prints = fingerprints(both, ["_run", "_place", "_which"], keep=kept)
    pick = lambda w: F.max(F.when(F.col("_which") == w, F.col("fingerprint")))
    rows = written(prints.groupBy("_run", "_place").agg(*[F.max(c).alias(c) for c in kept], pick(0).alias("fingerprint"), pick(1).alias("edited_fingerprint")), "prints")
    near = following(rows.withColumnRenamed("_place", "_at"), "fingerprint", [F.col("_at")], -F.col("_at"), "next_fingerprint")
    return near.select(
        "doc_id",
        "n_chars",
        F.lower(F.concat(*[F.lpad(F.hex(f"_s{i}"), 16, "0") for i in range(4)])).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
