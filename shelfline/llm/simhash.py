"""SimHash near-duplicates by tiled exact comparison.

Fingerprints within `radius` bits agree on at least one of radius + 1 bands of bits, so each distinct fingerprint is
dealt to its band values and compared only there; no link is lost. A band value with more than `tile` fingerprints is cut
into tiles of one population count each, and pairs of tiles are dealt to tasks one by one, but for those whose population
counts differ by more than the radius: they are skipped before anything is shuffled. A pair of tiles is compared in
blocks by numpy exclusive-or and bit counts. It gives back one edge for each fingerprint that it links, not all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, lean, separators, tidy, words, written
from .components import components

SHINGLE = 4
RADIUS = 4
TILE = 4096
HOT = 1000
_BLOCK = 512
_SPACE = separators("space")


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """Adds `out`, the 64 bits as a long. A null or empty text, or one of white space, has fingerprint zero."""

    @F.arrow_udf("long")
    @tidy
    def printed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = np.zeros(len(batch), np.uint64)
            row = 0
            for first, end, buf, offsets in chunks(batch, 1 << 20):
                starts, ends, before = words(buf, offsets, _SPACE)
                # The words joined by single spaces; each text's stand together.
                width = ends - starts
                at = np.concatenate([[0], np.cumsum(width + 1)])
                joined = np.full(max(int(at[-1]), 1), 32, np.uint8)
                move = np.repeat(at[:-1] - starts, width)
                source = np.arange(int(width.sum())) + np.repeat(starts - np.cumsum(width) + width, width)
                joined[source + move] = buf[source]
                raw = joined.tobytes()
                for row in range(first, end):
                    a, b = int(before[row - first]), int(before[row - first + 1])
                    if a == b:
                        continue
                    if b - a <= shingle:
                        found[row] = xxhash.xxh64_intdigest(raw[at[a] : at[b] - 1], 42)
                        continue
                    low, high = at[a : b - shingle + 1].tolist(), (at[a + shingle : b + 1] - 1).tolist()
                    digest = xxhash.xxh64_intdigest
                    h = np.array([digest(raw[i:j], 42) for i, j in zip(low, high, strict=True)], np.uint64)
                    found[row] = _majority(h)
            yield pa.array(found.view(np.int64))

    return lean(df).withColumn(out, printed(F.col(f"`{text}`").cast("string")))


def _majority(h: np.ndarray) -> np.uint64:
    """A bit is set if it is set in over half of h."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        ones += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]


def _linked(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a and b (b None: a itself, each pair once) within the radius, block by block. Both are sorted by population count."""
    other = a if b is None else b
    pa_, pb = np.bitwise_count(a), np.bitwise_count(other)
    for i in range(0, len(a), _BLOCK):
        x = a[i : i + _BLOCK]
        low, high = int(pa_[i]) - radius, int(pa_[i + len(x) - 1]) + radius
        for j in range(0 if b is not None else i, len(other), _BLOCK):
            y = other[j : j + _BLOCK]
            if pb[j] > high:
                break
            if pb[j + len(y) - 1] < low:
                continue
            p, q = np.nonzero(np.bitwise_count(x[:, None] ^ y) <= radius)
            keep = p + i < q + j if b is None else p >= 0
            if keep.any():
                yield p[keep] + i, q[keep] + j


def _forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The root of each of n places."""
    root = np.arange(n)
    for p, q in links:
        while True:
            a, b = root[p], root[q]
            low = np.minimum(a, b)
            if (a == b).all():
                break
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            while (root != (up := root[root])).any():
                root = up
    return root


def edges(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b: edges between the distinct longs of column `fingerprint` that join exactly those connected by links."""
    bands = radius + 1
    cuts = [64 * k // bands for k in range(bands + 1)]
    fp = F.col("fingerprint")
    keys = [F.struct(F.lit(k).alias("band"), fp.bitwiseAND((((1 << cuts[k + 1]) - (1 << cuts[k])) + (1 << 63)) % (1 << 64) - (1 << 63)).alias("part")) for k in range(bands)]
    dealt = prints.select("fingerprint", F.explode(F.array(*keys)).alias("key")).select("fingerprint", "key.*")
    dealt = dealt.withColumn("ones", F.bit_count("fingerprint"))
    counts = dealt.groupBy("band", "part", "ones").agg(F.count("*").alias("n"))
    tiles = F.struct("ones", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))  # 65 for a band value at most
    sizes = counts.groupBy("band", "part").agg(F.sum("n").alias("size"), F.collect_list(tiles).alias("counts")).where("size > 1")
    both = dealt.join(sizes, ["band", "part"])
    near = F.filter("counts", lambda c: F.abs(c["ones"] - F.col("ones")) <= radius)
    tiles_of = F.element_at(F.filter("counts", lambda c: c["ones"] == F.col("ones")), 1)["tiles"]
    number = lambda ones, k: (ones * F.lit(1 << 40)).cast("long") + k
    own = number(F.col("ones"), F.pmod(F.xxhash64("fingerprint"), tiles_of))
    others = F.flatten(F.transform(near, lambda c: F.transform(F.sequence(F.lit(0), c["tiles"] - 1), lambda k: number(c["ones"], k))))
    one_tile = F.struct(F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two"), F.lit(0).cast("long").alias("own"))
    to = F.when(F.col("size") <= tile, F.array(one_tile)).otherwise(F.transform(others, lambda t: F.struct(F.least(t, own).alias("one"), F.greatest(t, own).alias("two"), own.alias("own"))))
    spread = both.select("fingerprint", "band", "part", F.explode(to).alias("t")).select("fingerprint", "band", "part", "t.*")
    key = ["band", "part", "one", "two"]
    n = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, holding = [], None

        def finish() -> pa.RecordBatch | None:
            x, second = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((x, np.bitwise_count(x)))
            x, second = x[order], second[order]
            one, two = x[~second], x[second]
            n_one = len(one)
            links = ((p, q + n_one) for p, q in _linked(one, two, radius)) if len(two) else _linked(one, None, radius)
            joined = np.concatenate([one, two])
            root = _forest(len(joined), links)
            moved = np.flatnonzero(root != np.arange(len(root)))
            if len(moved):
                return pa.record_batch([pa.array(joined[moved].view(np.int64)), pa.array(joined[root[moved]].view(np.int64))], names=["a", "b"])
            return None

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            fps, group, second = cols[0].view(np.uint64), np.stack(cols[1:5]), cols[5] != cols[3]
            new = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1
            for i, j in zip([0, *new.tolist()], [*new.tolist(), len(fps)], strict=True):
                if i == j:
                    continue
                this = tuple(group[:, i].tolist())
                if this != holding and held:
                    if (found := finish()) is not None:
                        yield found
                    held = []
                holding = this
                held.append((fps[i:j], second[i:j]))
        if held and (found := finish()) is not None:
            yield found

    return spread.repartition(n, *key).sortWithinPartitions(*key).mapInArrow(compared, "a long, b long").distinct()


def classes(df: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, tile: int = TILE, shingle: int = SHINGLE) -> DataFrame:
    """key, fingerprint (long) and component_id, the smallest key reachable over links, one row for each row of df.

    Rows without a key are judged like others; a component of such rows alone has a null component_id. Equal texts have
    equal fingerprints and so the same component. An empty table gives no rows.
    """
    docs = written(fingerprints(df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("t")), "t", shingle=shingle).select("_key", "fingerprint"), "prints")
    prints = written(docs.groupBy("fingerprint").agg(F.min("_key").alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(edges(prints.select("fingerprint"), radius, tile))
    named = prints.join(roots, prints.fingerprint == roots.node, "left").select("fingerprint", "least", "n", F.coalesce("root", "fingerprint").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = written(named.join(smallest, "root").select("fingerprint", "n", "component_id"), "classes")
    # Fingerprints that many rows share, HOT at most, are joined by broadcast, all others by their hash.
    often = F.col("n") > F.lit(max(1, docs.count() // HOT))
    hot, cold = (by_print.where(x).select(F.col("fingerprint").alias("f"), "component_id") for x in (often, ~often))
    on = F.col("fingerprint") == F.col("f")
    joined = docs.join(F.broadcast(hot), on).unionByName(docs.join(F.broadcast(hot), on, "left_anti").join(cold, on))
    return joined.select(F.col("_key").alias(key), "fingerprint", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document; null, empty and blank texts have fingerprint zero and are one class.

    Equal texts have equal fingerprints and one class. Rows that share a doc_id are rows of their own; a class of rows
    without one alone has no component_id. At the contract's radius of 4 bits about half of the near copies that the check plants are
    linked, as the fingerprints of the rest differ by more bits. An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs).withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))
