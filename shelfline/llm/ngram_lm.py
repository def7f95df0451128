"""Language-model scoring with log-frequency Bloom filters.

Counts of unigrams and bigrams are quantised to levels 1 + floor(log(c) / log(STEP)), and an n-gram is entered once for
each level up to its own; who asks for a count probes level after level until a probe misses. There are two filters.
The n-grams of the highest counts are in one of fixed size that is broadcast: they come up in almost every text. All
n-grams are in a filter that is cut into segments by the leading bits of their hashes. A Spark task builds a segment, of
as many bits as its entries need; segments stay in a table, and the n-grams that the broadcast filter doesn't hold are
asked there: the texts are put into packs, the different n-grams of a pack are dealt to their segments, and the levels
come back to the pack. So nothing that grows with the corpus is broadcast or passes the driver, no n-gram is left out,
and the work is the same for every text at any size of the corpus. The probabilities are smoothed:

    p(w)     = (c(w) + 1) / (N + V + 1)
    p(w | v) = (c(v w) + mu p(w)) / (c(v) + mu)

where c(v w) is at most c(v) and c(w). The text's first word follows a start mark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, crc_mod, distinct, fresh, lean, mixed, separators, settled, span_hashes, steady, words

FILTER_BITS = 1 << 26  # 8 MB, on the driver and in every Python worker
BITS_PER_ENTRY = 8  # at least
PROBES = 4
STEP = 1.5
MU = 4.0
SEGMENTS, SEGMENT = 256, 1 << 19  # segments at least; training tokens in one, about
LEAST_LEVEL = 6  # of the n-grams in the broadcast filter, at least: counts of 8 and more
PACK = 2 << 20  # bytes of the texts that ask together
FREQUENT, FREQUENT_BYTES = 100_000, 4 << 20  # words whose counts are broadcast, and their bytes, at most; all others are joined

_SPACE = separators("space")
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_BELOW = 2  # levels below its least one that the broadcast filter also holds, so that few others pass by chance
_PARTS = 64  # of the broadcast filter, each built by one task
_KNOWN = 20  # bits of the slots for levels that a worker has found: 9 MB
_LEVELS = 160  # more than a count of 64 bits has


def _bigram(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(v * np.uint64(0xD6E8FEB86659FD93) ^ (w + np.uint64(0x2545F4914F6CDD1D))) & ~np.uint64(1)


def _unigram(h: np.ndarray) -> np.ndarray:
    return h | np.uint64(1)


def _token_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the number of words before it; hashes of the words, with an end mark after each text; each one's predecessor."""
    starts, ends, before = words(buf, offsets, _SPACE)
    h = span_hashes(buf, starts, ends)
    with_end = np.insert(h, before[1:], _END)
    previous = np.empty_like(with_end)
    previous[1:] = with_end[:-1]
    previous[before[:-1] + np.arange(len(before) - 1)] = _START
    return before, with_end, previous


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (binary), count: how often each lower-cased white-space word occurs; the end mark is not among them. Exact."""

    @steady
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offsets in chunks(batch.column(0), 4 << 20):
                starts, ends, _ = words(buf, offsets, _SPACE)
                found, code = distinct(buf, starts, ends)
                yield pa.record_batch([found.cast(pa.binary()), pa.array(np.bincount(code, minlength=len(found)))], names=["word", "count"])

    return lean(docs).select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(counted, "word binary, count long").groupBy("word").agg(F.sum("count").alias("count"))


def _split(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Of hashes in order: the segments that they lie in, and where each segment's begin and, last, end."""
    own = h >> np.uint64(64 - (segments - 1).bit_length())
    first = np.flatnonzero(np.diff(own, prepend=own[:1] ^ np.uint64(1))) if len(h) else np.zeros(0, np.int64)
    return own[first].astype(np.int32), np.append(first, len(h))


def _packed(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The stretches of x between the cuts as binaries."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order and their counts, added up over the parts."""
    h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.diff(h, prepend=h[:1] ^ np.uint64(1))) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(h) else n


def ngram_counts(docs: DataFrame, text: str, segments: int) -> DataFrame:
    """segment, h, count: partial counts of hashed unigrams and bigrams, the end mark included.

    A row holds hashes of one segment, in order, as packed 64-bit integers, and their counts as 32-bit ones, so that a
    shuffle moves few rows. h is even for bigrams.
    """

    @steady
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            for _, _, buf, offsets in chunks(batch.column(0)):
                _, tokens, previous = _token_hashes(buf, offsets)
                parts += [np.unique(x, return_counts=True) for x in (_unigram(tokens), _bigram(previous, tokens))]
                parts.append((_unigram(_START)[None], np.array([len(offsets) - 1])))
            h, n = _added(parts)
            own, cuts = _split(h, segments)
            yield pa.record_batch([pa.array(own), _packed(h, cuts), _packed(n.astype(np.uint32), cuts)], names=["segment", "h", "count"])

    return lean(docs).select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(counted, "segment int, h binary, count binary")


def _level(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(count) / math.log(STEP) + 1e-9).astype(np.int64)


def _count(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for."""
    low = np.where(level > 0, np.ceil(STEP ** (level - 1.0) - 1e-9), 0)
    high = np.where(level > 0, np.maximum(np.ceil(STEP ** (level * 1.0) - 1e-9) - 1, low), 0)
    return (low + high) / 2


def _mix(h: np.ndarray, level: np.ndarray) -> np.ndarray:
    return mixed(h + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _enter(bits: np.ndarray, h: np.ndarray, level: np.ndarray, first: int = 1) -> None:
    """Enters each hash for the levels from `first` to its own; bits: a power of two of bytes."""
    each = np.maximum(level - first + 1, 0)
    own = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + first
    x = _mix(np.repeat(h, each), own)
    step = x >> np.uint64(32) | np.uint64(1)
    for _ in range(PROBES):
        at = x & np.uint64(8 * len(bits) - 1)
        np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        x = x + step


def _probe(bits: np.ndarray, h: np.ndarray, size: int, base: np.ndarray | None = None, first: int = 1) -> np.ndarray:
    """The last level for which a filter of `size` bits (from bit `base` of `bits` on) holds each hash, first - 1 if none."""
    level, open_, own, k = np.full(len(h), first - 1, np.int64), np.arange(len(h)), h, first
    while len(open_):
        x = _mix(own, np.array([k]))
        step = x >> np.uint64(32) | np.uint64(1)
        for _ in range(PROBES):
            at = x & np.uint64(size - 1)
            if base is not None:
                at += base
            hit = np.flatnonzero(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1))
            open_, own, step = open_[hit], own[hit], step[hit]
            base = None if base is None else base[hit]
            x = x[hit] + step
        level[open_] = k
        k += 1
    return level


@dataclass
class Model:
    """tokens and vocabulary: N and V of the training tokens. bits: the broadcast filter, of n-grams of level `least` and above.

    table: segment, bits; the filter of all n-grams. It stays on the workers.
    """

    tokens: int
    vocabulary: int
    segments: int
    bits: np.ndarray
    least: int
    table: DataFrame | None
    known: tuple[np.ndarray, np.ndarray] | None = None

    def frequent(self, h: np.ndarray) -> np.ndarray:
        """The level of each hash that the broadcast filter holds, 0 for others.

        A hash that it holds costs a probe for every level. Those found are kept with their levels, one for each value of the
        leading bits, so that a worker seldom probes for them again in the packs that follow.
        """
        if self.known is None:
            self.known = np.zeros(1 << _KNOWN, np.uint64), np.zeros(1 << _KNOWN, np.uint8)
        hashes, levels = self.known
        slot = (h >> np.uint64(64 - _KNOWN)).astype(np.int64)
        level = np.where(hashes[slot] == h, levels[slot], 0).astype(np.int64)
        open_ = np.flatnonzero(level == 0)
        own, size = h[open_], 8 * len(self.bits) // _PARTS
        found = _probe(self.bits, own, size, (own >> np.uint64(64 - _PARTS.bit_length() + 1)) * np.uint64(size), max(1, self.least - _BELOW))
        open_, found = open_[found >= self.least], found[found >= self.least]
        level[open_], hashes[slot[open_]], levels[slot[open_]] = found, h[open_], found
        return level

    def log10(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 of each token's probability; at: for the tokens, their predecessors and the bigrams, the places of their levels."""
        cw, cv, both = _count(level)[at]
        p = np.minimum(1.0, (cw + 1) / (self.tokens + self.vocabulary + 1))
        return np.log10((np.minimum(both, np.minimum(cv, cw)) + MU * p) / (cv + MU))


def fit(docs: DataFrame, tokens: int, vocabulary: int, text: str = "text", filter_bits: int = FILTER_BITS) -> Model:
    """The filters of all n-grams of docs. The driver receives the broadcast one, of filter_bits / 8 bytes, and _LEVELS sizes."""
    segments = 1 << max(SEGMENTS.bit_length() - 1, math.ceil(math.log2(max(1, tokens) / SEGMENT)))
    schema = pa.schema([("segment", pa.int32()), *((x, pa.binary()) for x in ("bits", "h", "level")), ("sizes", pa.list_(pa.int64()))])

    @steady
    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, holding = [], None

        def closed() -> pa.RecordBatch:
            h, count = _added(held)
            level = _level(count)
            bits = np.zeros(1 << max(3, math.ceil(math.log2(max(1, int(level.sum())) * BITS_PER_ENTRY)) - 3), np.uint8)
            for k in range(0, len(h), 1 << 17):
                _enter(bits, h[k : k + (1 << 17)], level[k : k + (1 << 17)])
            often = level >= LEAST_LEVEL
            sizes = np.bincount(level, minlength=_LEVELS).tolist()
            return pa.record_batch([[holding], [bits.tobytes()], [h[often].tobytes()], [level[often].astype(np.uint8).tobytes()], [sizes]], schema=schema)

        for batch in batches:
            for segment, h, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if segment != holding and held:
                    yield closed()
                    held = []
                holding = segment
                held.append((np.frombuffer(h, np.uint64), np.frombuffer(count, np.uint32).astype(np.int64)))
        if held:
            yield closed()

    counts = ngram_counts(docs, text, segments).repartition("segment").sortWithinPartitions("segment")
    made = settled(counts.mapInArrow(built, "segment int, bits binary, h binary, level binary, sizes array<long>"), "segments")
    sizes = np.zeros(_LEVELS, np.int64)
    for row in made.select(F.posexplode("sizes").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).collect():  # _LEVELS rows
        sizes[row.level] = row.n
    least = LEAST_LEVEL
    while (sizes[least:] * (np.arange(_LEVELS - least) + 1 + _BELOW)).sum() > filter_bits // BITS_PER_ENTRY:
        least += 1

    @steady
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, h, level in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, level = np.frombuffer(h, np.uint64), np.frombuffer(level, np.uint8).astype(np.int64)
                _enter(own.setdefault(part, np.zeros(filter_bits // 8 // _PARTS, np.uint8)), h[level >= least], level[level >= least], max(1, least - _BELOW))
        for part, bits in own.items():
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["part", "bits"])

    parts = made.select(F.shiftright("segment", (segments // _PARTS).bit_length() - 1).alias("part"), "h", "level").repartition(_PARTS, "part")
    bits = np.zeros((_PARTS, filter_bits // 8 // _PARTS), np.uint8)
    found = parts.mapInArrow(marked, "part int, bits binary").toArrow()  # _PARTS rows
    for part, own in zip(found["part"].to_pylist(), found["bits"], strict=True):
        bits[part] = np.frombuffer(own.as_buffer(), np.uint8)
    return Model(tokens, vocabulary, segments, bits.reshape(-1), least, made.select("segment", "bits"))


def packed(df: DataFrame, text: str = "text", row: str = "_row", size: int = PACK) -> DataFrame:
    """pack, rows: the rows of df, with a number of their own in column `row`, in packs of texts of about `size` bytes, as a table."""
    fields = [T.StructField(row, T.LongType()), *df.select(*[f"`{c}`" for c in df.columns if c != row]).schema.fields]
    schema = T.StructType([T.StructField("pack", T.LongType()), T.StructField("rows", T.ArrayType(T.StructType(fields)))])
    names = [f.name for f in fields]

    @steady
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, end, _, _ in chunks(batch.column(names.index(text) - 1), size):
                rows = batch.slice(first, end - first)
                ids = pa.array(np.arange(number, number + len(rows)))
                own = pa.StructArray.from_arrays([ids, *rows.columns], names=names)
                yield pa.record_batch([pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), own)], names=["pack", "rows"])
                number += len(rows)

    # Packs are long rows: small groups keep what a reader holds at once small.
    return settled(lean(df).select(*[f"`{c}`" for c in names[1:]]).mapInArrow(dealt, schema), "packs", **{"parquet.block.size": 16 << 20})


def _news(x: np.ndarray) -> np.ndarray:
    """True where a sorted array has a value for the first time."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new


def _different(texts: pa.Array) -> np.ndarray:
    """The different n-grams of the texts in order, the start mark included."""
    _, _, buf, offsets = next(chunks(texts, 1 << 60))
    _, tokens, previous = _token_hashes(buf, offsets)
    h = np.concatenate([_unigram(tokens), _unigram(_START)[None], _bigram(previous, tokens)])
    h.sort()
    return h[_news(h)]


def _placed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of x in order, and each value's place in them."""
    order = np.argsort(x)
    x = x[order]
    new, place = _news(x), np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    return x[new], place


def _grams(texts: pa.Array) -> tuple[np.ndarray, int, np.ndarray]:
    """For each text the number of tokens before it; how many different n-grams there are; of tokens, predecessors, bigrams the
    places in _different().
    """
    _, _, buf, offsets = next(chunks(texts, 1 << 60))
    before, tokens, previous = _token_hashes(buf, offsets)
    cuts = before + np.arange(len(before))
    uni, own = _placed(np.append(_unigram(tokens), _unigram(_START)))
    pairs, both = _placed(_bigram(previous, tokens))
    ahead = np.append(own[-1], own[:-2])
    ahead[cuts[:-1]] = own[-1]
    singles = np.searchsorted(pairs, uni) + np.arange(len(uni))  # both are in order and share no value
    rest = np.ones(len(uni) + len(pairs), bool)
    rest[singles] = False
    return cuts, len(rest), np.stack([singles[own[:-1]], singles[ahead], np.flatnonzero(rest)[both]])


def _marks(level: np.ndarray) -> bytes:
    """Levels, mostly 0: a bit for each that is not, then these as bytes."""
    return np.packbits(level > 0).tobytes() + level[level > 0].astype(np.uint8).tobytes()


def _unmarked(data: np.ndarray, n: int) -> np.ndarray:
    bits = (n + 7) // 8
    level = np.unpackbits(data[:bits], count=n).astype(np.int64)
    level[level > 0] = data[bits:]
    return level


def answers(packs: DataFrame, model: Model, shared, text: str = "text") -> DataFrame:
    """pack, segment, levels: the levels (bytes) of the pack's n-grams that lie in the segment and not in the broadcast filter, in order.

    The levels of those that it holds come in a row of a segment below 0, as _marks().
    """

    @steady
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for k in range(len(batch)):
                h, pack = _different(batch.column(1).slice(k, 1).flatten()), batch.column(0)[k].as_py()
                level = m.frequent(h)
                h = h[level == 0]
                own, cuts = _split(h, m.segments)
                yield pa.record_batch([pa.array(own), pa.array(np.full(len(own), pack)), _packed(h, cuts)], names=["segment", "pack", "data"])
                apart = -1 - (pack ^ pack >> 33) % m.segments  # packs lie apart, as segments do
                yield pa.record_batch([pa.array([apart], pa.int32()), pa.array([pack]), pa.array([_marks(level)])], names=["segment", "pack", "data"])

    @steady
    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding, bits = None, None
        for batch in batches:
            segments, out = batch.column(0).to_numpy(), []
            cuts = [0, *(np.flatnonzero(np.diff(segments)) + 1).tolist(), len(segments)]
            for first, end in zip(cuts, cuts[1:], strict=False):
                if first < end and segments[first] != holding:
                    holding, bits = segments[first], None
                data = batch.column(2).slice(first, end - first)
                if first < end and segments[first] < 0:
                    out.append((batch.column(1).slice(first, end - first), batch.column(0).slice(first, end - first), data))
                    continue
                if first < end and not batch.column(1)[first].is_valid:  # the segment's filter comes before what it is asked
                    bits, data, first = np.frombuffer(data[0].as_buffer(), np.uint8).copy(), data.slice(1), first + 1
                if first < end:
                    h = np.frombuffer(b"".join(data.to_pylist()), np.uint64)
                    level = (_probe(bits, h, 8 * len(bits)) if bits is not None else np.zeros(len(h), np.int64)).astype(np.uint8)
                    stops = np.concatenate([[0], np.cumsum(pc.binary_length(data).to_numpy() // 8)])
                    out.append((batch.column(1).slice(first, end - first), batch.column(0).slice(first, end - first), _packed(level, stops)))
            for pack, segment, levels in out:
                yield pa.record_batch([pack, segment, levels], names=["pack", "segment", "levels"])

    asks = packs.select("pack", F.col("rows")[text].alias("t")).mapInArrow(asked, "segment int, pack long, data binary")
    filters = model.table.select("segment", F.lit(None).cast("long").alias("pack"), F.col("bits").alias("data"))
    both = filters.unionByName(asks).repartition("segment").sortWithinPartitions("segment", F.asc_nulls_first("pack"))
    return both.mapInArrow(answered, "pack long, segment int, levels binary")


def pack_scores(packs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """The rows of the packs with `out`, the log10 probability of the text with its end mark."""
    shared = packs.sparkSession.sparkContext.broadcast(Model(model.tokens, model.vocabulary, model.segments, model.bits, model.least, None))
    fields = [f for f in packs.schema["rows"].dataType.elementType.fields if f.name != out]
    names = [f.name for f in fields]
    came = settled(answers(packs, model, shared, text), "levels")

    @steady
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, holding, held = shared.value, None, []
        for batch in batches:
            for k, (pack, levels) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
                if pack != holding:
                    holding, held = pack, []
                if levels.is_valid:
                    held.append(np.frombuffer(levels.as_buffer(), np.uint8))
                    continue
                rows = batch.column(3).slice(k, 1).flatten()
                cols = [rows.field(name) for name in names]
                before, n, at = _grams(cols[names.index(text)])
                level = _unmarked(held[0], n)
                level[level == 0] = np.concatenate([np.zeros(0, np.uint8), *held[1:]])
                scores = np.add.reduceat(m.log10(level, at), before[:-1])
                yield pa.record_batch([*cols, pa.array(scores)], names=[*names, out])

    texts = packs.select("pack", F.lit(None).cast("int").alias("segment"), F.lit(None).cast("binary").alias("levels"), "rows")
    none = F.lit(None).cast(packs.schema["rows"].dataType).alias("rows")
    both = texts.unionByName(came.select("pack", "segment", "levels", none)).repartition("pack").sortWithinPartitions("pack", F.asc_nulls_last("segment"))
    return both.mapInArrow(scored, T.StructType([*fields, T.StructField(out, T.DoubleType())]))


def model_scores(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds `out`, the log10 probability of the text with its end mark. Null and empty texts hold the end mark alone.

    Every row of df is scored, rows that repeat too; all other columns stay, and one already named `out` is replaced.
    """
    row = fresh(df, "_row")
    own = pack_scores(packed(lean(df), text, row), model, text, out)
    return own.select(*[f"`{c}`" for c in df.columns if c != out], f"`{out}`")


def base_scores(df: DataFrame, counts: DataFrame, tokens: Column, vocabulary: Column, ends: Column, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """key, n_tokens, n_known, base_score: add-one unigram scores from exact counts; words are compared by their bytes.

    The counts of the most frequent words, `frequent` and FREQUENT_BYTES at most, are broadcast, so that what is left to
    join has no hot word; the other words are joined by Spark, one row for each of a text's different words. Rows with
    the same key are added up.
    """
    share = F.floor(F.log2("count") * 4)
    left, room, least = frequent, FREQUENT_BYTES, None
    for row in counts.groupBy(share.alias("b")).agg(F.count("*").alias("n"), F.sum(F.length("word")).alias("size"), F.min("count").alias("least")).orderBy(F.desc("b")).collect():  # 256 rows at most
        left, room = left - row.n, room - row["size"]
        if left < 0 or room < 0:
            break
        least = row.least
    top = counts.where(F.col("count") >= least if least is not None else F.lit(False)).toArrow()
    shared = df.sparkSession.sparkContext.broadcast((top["word"].combine_chunks().cast(pa.large_binary()), np.log10(top["count"].to_numpy() + 1.0)))
    del top

    @steady
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, logs_of = shared.value
        for batch in batches:
            ids = batch.column(0)
            for first, end, buf, offsets in chunks(batch.column(1)):
                starts, ends_, before = words(buf, offsets, _SPACE)
                found, code = distinct(buf, starts, ends_)
                place = pc.fill_null(pc.index_in(found, value_set=often), -1).to_numpy()[code]
                hit, doc = place >= 0, np.repeat(np.arange(end - first), np.diff(before))
                logs = np.bincount(doc[hit], logs_of[place[hit]], end - first)
                own = ids.slice(first, end - first)
                yield pa.record_batch(
                    [own, pa.nulls(end - first, pa.binary()), pa.array(np.diff(before), pa.int64()), pa.array(np.bincount(doc[hit], minlength=end - first), pa.int64()), pa.array(logs.astype(np.float64))],
                    names=["k", "word", "n", "known", "logs"],
                )
                if not hit.all():
                    pair, n = np.unique(doc[~hit] * len(found) + code[~hit], return_counts=True)
                    yield pa.record_batch(
                        [own.take(pa.array(pair // len(found))), found.take(pa.array(pair % len(found))).cast(pa.binary()), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.float64())],
                        names=["k", "word", "n", "known", "logs"],
                    )

    kind = df.schema[key].dataType.simpleString()
    rows = lean(df).select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(split, f"k {kind}, word binary, n long, known long, logs double")
    joined = rows.join(counts, "word", "left")
    c = F.coalesce("count", F.lit(0))
    per = joined.groupBy("k").agg(
        F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("n"),
        F.count(F.when(F.col("word").isNull(), 1)).alias("texts"),
        F.sum(F.when(F.col("word").isNull(), F.col("known")).when(c > 0, F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.when(F.col("word").isNull(), F.col("logs")).otherwise(F.col("n") * F.log10(c + 1))).alias("logs"),
    )
    n = F.col("n") + F.col("texts")
    return per.select(
        F.col("k").alias(key),
        n.alias("n_tokens"),
        (F.col("known") + F.when(ends > 0, F.col("texts")).otherwise(0)).alias("n_known"),
        (F.col("logs") + F.col("texts") * F.log10(ends + 1) - n * F.log10(tokens + vocabulary + 1)).alias("base_score"),
    )


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document, rows that share a doc_id or have none one by one. Null and empty texts hold the end mark alone.

    An empty training set leaves N = V = 0: every probability is then one, as nothing else is known.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = crc_mod("doc_id", 7) == 2
    train = docs.where(~held_out)
    counts = settled(word_counts(train), "words")
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = train.count()
    tokens, vocabulary = total.n + ends, total.v + (ends > 0)
    packs = packed(docs)
    scores = settled(pack_scores(packs, fit(train, tokens, vocabulary)).select("_row", "doc_id", "score"), "scores")
    base = base_scores(packs.select(F.inline("rows")), counts, F.lit(tokens), F.lit(vocabulary), F.lit(ends), key="_row")
    return base.join(scores, "_row").select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
