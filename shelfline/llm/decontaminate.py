"""Benchmark decontamination by spaced-seed hashing.

A mask looks at some words of a stretch and ignores the others, so a substituted word leaves the hashes of masks that
ignore it as they were. Hashes of all benchmark positions are joined with those of all training positions, and each
meeting is verified by comparing the words around it one by one, substitutions allowed. Training positions pass a bit
table of fixed size before the join, which spares the shuffle of hashes that no benchmark item has.

The masks find every stretch of 8 to 13 words with as many substitutions as a similarity of 0.8 allows (tests/llm tries
them all). A mask needs its own words alone, so passages that begin before a text or end after it are found too. Items
of fewer words have seeds of their own: up to four words the whole item, as no substitution is allowed there, and of
five to seven words each half, as the one substitution allowed leaves one half as it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, chunks, distinct, lean, mixed, separators, span_hashes, tidy, words, written

MASKS = ((0, 1, 3, 6, 7), (0, 1, 4, 6, 7), (0, 1, 3, 4, 5))
SPAN = 8
WINDOW = 13
SIMILARITY = 0.8
TABLE_BITS = 1 << 26

_SYMBOL = separators("symbol")
_FACTOR = np.array([mixed(np.array([i + 1], np.uint64))[0] | np.uint64(1) for i in range(SPAN)])


def short_seeds(n: int) -> list[tuple[int, int]]:
    """First place and number of words of each seed of an item of n words, n below SPAN."""
    return [(0, n)] if n < 5 else [(0, n // 2), (n // 2, n - n // 2)]


def _masked(h: np.ndarray, mask: tuple[int, ...], k: int) -> np.ndarray:
    """Hash under the mask of each position from which the mask's words follow."""
    n = max(0, len(h) - mask[-1])
    total = np.full(n, k + 1, np.uint64)
    for place in mask:
        total += h[place : place + n] * _FACTOR[place]
    return mixed(total)


def _masks(lengths: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """Number and places of the masks for long items and for short ones of the given lengths."""
    short = sorted({size for n in lengths for _, size in short_seeds(n)})
    return [*enumerate(MASKS), *((len(MASKS) + size, tuple(range(size))) for size in short)]


def _lists(values: pa.Array, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)


def _hits(texts: pa.Array, reach: int, masks: list, keep) -> pa.Array:
    """For each text a list of (hash, at, words around) for its masked positions that keep() lets through."""
    out, wide = [], SPAN + 2 * reach
    for first, end, buf, offsets in chunks(texts):
        starts, ends, before = words(buf, offsets, _SYMBOL)
        found, code = distinct(buf, starts, ends)
        h = span_hashes(buf, starts, ends)
        text = np.repeat(np.arange(end - first), np.diff(before))
        rows = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for k, mask in masks:
            x = _masked(h, mask, k)
            at = np.flatnonzero((text[: len(x)] == text[mask[-1] :]) & keep(x)) if len(x) else np.zeros(0, np.int64)
            rows.append((x[at], at))
        x, at = (np.concatenate(r) for r in zip(*rows, strict=True))
        order = np.argsort(at, kind="stable")
        x, at = x[order], at[order]
        around = at[:, None] - reach + np.arange(wide)
        inside = (around >= before[text[at]][:, None]) & (around < before[text[at] + 1][:, None])
        near = np.where(inside, code[np.clip(around, 0, max(len(code) - 1, 0))] if len(code) else 0, -1).reshape(-1)
        near = found.cast(pa.large_string()).cast(pa.string()).take(pa.array(near, mask=near < 0))
        items = [pa.array(x.view(np.int64)), pa.array((at - before[text[at]]).astype(np.int32)), _lists(near, np.arange(len(at) + 1) * wide)]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(text[at], minlength=end - first))])
        out.append(_lists(pa.StructArray.from_arrays(items, names=["h", "at", "near"]), cuts))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32()), ("near", pa.list_(pa.string()))])))


def seeds(df: DataFrame, keys: list[str], text: str, masks: list, reach: int, table: np.ndarray) -> DataFrame:
    """keys, h, at, near: a row for each masked position whose hash is in the bit table, with the words around it."""
    shared = df.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("array<struct<h:long,at:int,near:array<string>>>")
    @tidy
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bits = shared.value

        def keep(x: np.ndarray) -> np.ndarray:
            at = x & np.uint64(8 * len(bits) - 1)
            return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

        for batch in batches:
            yield _hits(batch, reach, masks, keep)

    return lean(df).select(*keys, F.explode(hashed(F.col(f"`{text}`").cast("string"))).alias("s")).select(*keys, "s.*")


def item_seeds(items: DataFrame) -> DataFrame:
    """_row, _at, h of the items in column _words: all masks at all positions, or the seeds of a short item."""

    @F.arrow_udf("array<struct<h:long,at:int>>")
    def hashed(texts: pa.Array) -> pa.Array:
        out = []
        for own in texts.to_pylist():
            raw = [w.encode() for w in own]
            ends = np.cumsum([len(w) for w in raw], dtype=np.int64)
            h = span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends)
            if len(own) < SPAN:
                found = [(_masked(h[a : a + n], tuple(range(n)), len(MASKS) + n)[:1], a) for a, n in short_seeds(len(own)) if n]
            else:
                found = [(_masked(h, mask, k), 0) for k, mask in enumerate(MASKS)]
            out.append([{"h": int(x), "at": a + i} for xs, a in found for i, x in enumerate(xs.view(np.int64).tolist())])
        return pa.array(out, pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32())])))

    return items.select("_row", F.explode(hashed("_words")).alias("s")).select("_row", F.col("s.at").alias("_at"), "s.h")


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased, and of characters beyond ASCII; an empty array for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def table_of(index: DataFrame, bits: int = TABLE_BITS) -> np.ndarray:
    """The bit table of the benchmark's hashes: bits / 8 bytes, built in parts by tasks and gathered by the driver."""
    parts = 64
    size = bits // parts

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1)
            for p in np.unique(at // np.uint64(size)).tolist():
                here = at[at // np.uint64(size) == p] - np.uint64(p * size)
                np.bitwise_or.at(own.setdefault(int(p), np.zeros(size // 8, np.uint8)), here >> np.uint64(3), np.uint8(1) << (here & np.uint64(7)).astype(np.uint8))
        for p, x in own.items():
            yield pa.record_batch([pa.array([p], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["part", "bits"])

    out = np.zeros((parts, size // 8), np.uint8)
    dealt = index.select("h").distinct().repartition(F.expr(f"((h & {bits - 1}) div {size})"))
    found = dealt.mapInArrow(built, "part int, bits binary").toArrow()
    for p, x in zip(found["part"].to_pylist(), found["bits"], strict=True):
        out[p] |= np.frombuffer(x.as_buffer(), np.uint8)
    return out.reshape(-1)


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """key, item, matched, at: for each text and item that share a passage, the most equal words in one window and where it starts.

    A passage is `window` consecutive words (the whole item, if it has fewer) of which a share of `similarity` or more
    equal the item's words in the same order and places; `at` may lie before the text if the passage's first words are
    cut off. Words are ASCII letters and digits in lower case and all characters beyond ASCII, compared letter by letter;
    places beyond a text's ends count as different words. An item of a few words matches wherever these stand, so a
    benchmark that has such answers as items of their own should be filtered first. Null and empty texts and items hold
    nothing; rows without a key are compared and reported under null; equal matches give the smallest `at`.
    """
    reach, wide = window - 1, SPAN + 2 * (window - 1)
    items = benchmark.select(F.col(f"`{item}`").alias("_item"), words_of(F.col(f"`{item_text}`")).alias("_words")).where(F.size("_words") > 0)
    items = written(items.distinct().withColumn("_row", F.monotonically_increasing_id()), "items")
    index = item_seeds(items)
    lengths = [r.n for r in items.select(F.size("_words").alias("n")).where(F.col("n") < SPAN).distinct().collect()]  # SPAN rows at most
    found = seeds(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_t")), ["_key"], "_t", _masks(lengths), reach, table_of(index))

    @F.arrow_udf("struct<matched:int,start:int>")
    def verified(near: pa.Array, own: pa.Array, lead: pa.Array) -> pa.Array:
        """near: `wide` words of the text, null beyond its ends; own: the item's, of which `lead` stand before the seed."""
        n = len(near)
        if not n:
            return pa.StructArray.from_arrays([pa.array([], pa.int32())] * 2, names=["matched", "start"])
        size = own.value_lengths().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(n), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(reach - lead.to_numpy(), size)
        same = pc.equal(near.flatten().take(pa.array(row * wide + place)), own.flatten())
        equal, there = np.zeros((n, wide), bool), np.zeros((n, wide), bool)
        there[row, place] = True
        equal[row, place] = pc.fill_null(same, False).to_numpy(zero_copy_only=False)
        sums = np.cumsum(np.pad(equal, ((0, 0), (1, 0))), axis=1)
        most = np.minimum(window, size)
        matched, start = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low = there.argmax(1)
        for at in range(wide):
            stop = np.minimum(at + most, wide)
            got = np.where((at >= low) & (at + most <= low + size), sums[np.arange(n), stop] - sums[:, at], -1)
            better = got > matched
            matched[better], start[better] = got[better], at
        enough = matched >= np.ceil(similarity * most - 1e-9)
        return pa.StructArray.from_arrays([pa.array(np.where(enough, matched, 0), pa.int32()), pa.array(start - reach, pa.int32())], names=["matched", "start"])

    lead = F.least(F.col("_at"), F.lit(reach))
    around = F.slice("_words", F.col("_at") - lead + 1, lead + SPAN + reach)
    met = found.join(index, "h").join(items, "_row").select("_key", "_item", "at", verified("near", around, lead).alias("v")).where("v.matched > 0")
    best = met.groupBy("_key", "_item").agg(F.max(F.struct(F.col("v.matched").alias("matched"), (-(F.col("at") + F.col("v.start"))).alias("back"))).alias("b"))
    return best.select(F.col("_key").alias(key), F.col("_item").alias(item), F.col("b.matched").alias("matched"), (-F.col("b.back")).alias("at"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark passage: one row for each document and item.

    Null and empty texts hold nothing. Rows that share a doc_id, or have none, give one row for each item together, and so do
    equal items; of equally good places the smallest counts. An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def op7_sql() -> str:
    """The same by brute force in DuckDB: equal words on a diagonal, counted for every window of the item."""
    split = lambda t: f"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, unnest(range(len(ws))) AS p, unnest(ws) AS w FROM (SELECT doc_id, {split("text")} AS ws FROM documents)),
b AS (SELECT item_id, len(ws) AS n, unnest(range(len(ws))) AS q, unnest(ws) AS w FROM (SELECT item_id, {split("text")} AS ws FROM benchmark)),
met AS (SELECT doc_id, item_id, p - q AS diagonal, n, list(q) AS qs FROM d JOIN b USING (w) GROUP BY ALL HAVING count(*) >= ceil({SIMILARITY} * least({WINDOW}, n) - 1e-9)),
counted AS (SELECT doc_id, item_id, diagonal, n, s, count(*) AS matched
  FROM (SELECT doc_id, item_id, diagonal, n, unnest(qs) AS q FROM met), (SELECT unnest(range(-{WINDOW - 1}, 1)) AS back) o, LATERAL (SELECT q + back AS s)
  WHERE s >= 0 AND s + least({WINDOW}, n) <= n AND q < s + least({WINDOW}, n) GROUP BY ALL),
good AS (SELECT * FROM counted WHERE matched >= ceil({SIMILARITY} * least({WINDOW}, n) - 1e-9))
SELECT doc_id, item_id, CAST(max(matched) AS INTEGER) AS matched, CAST(min(diagonal + s) FILTER (matched = m) AS INTEGER) AS at FROM (SELECT *, max(matched) OVER (PARTITION BY doc_id, item_id) AS m FROM good) GROUP BY ALL"""
