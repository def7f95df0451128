"""Shared pieces: tables in the shared checkpoint folder, hashes on columns, words of an Arrow batch."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_CHUNK = 2 << 20


def written(df: DataFrame, name: str = "part", **options) -> DataFrame:
    """df as a table in the folder of spark.checkpoint.dir, so that later steps neither compute it again nor need its executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str, **options) -> DataFrame:
    """written(), after which the shuffle files that df took are removed."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return written(df, name, **options)
    finally:
        conf.set(key, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A folder of our own only where it names none and all tasks run
    in this one process, as in tests; a cluster without one is an error, as its machines would not see each other's files.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def lean(df: DataFrame) -> DataFrame:
    """df, after Arrow batches were held to 8 MB in its session: long texts then cost a Python worker little memory. A limit
    that differs from Spark's default stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key).rstrip("b") in ("67108864", "64m"):
        conf.set(key, "8m")
    return df


def tidy(f: Callable) -> Callable:
    """A function over an iterator of batches that hands freed memory back to the system after each one, as Python workers
    live on between stages.
    """

    @functools.wraps(f)
    def run(batches):
        for out in f(batches):
            yield out
            del out
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def steady(f: Callable) -> Callable:
    """tidy() at a task's end alone: arrays of one batch take the memory that those of the batch before have left, as new pages
    from the system cost about as much as the work on them. For functions whose batches are all held to a few MB.
    """

    @functools.wraps(f)
    def run(batches):
        libc = ctypes.CDLL(None)
        if option := getattr(libc, "mallopt", None):
            option(-3, 32 << 20)  # arrays up to this size are no mappings of their own
            option(-1, 64 << 20)  # free memory at the heap's end that stays
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(libc, "malloc_trim", None):
                trim(0)

    return run


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores in front until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % n


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def separators(kind: str) -> np.ndarray:
    """True at the bytes that end a word. space: ASCII white space; symbol: every ASCII byte but letters and digits."""
    table = np.zeros(256, bool)
    if kind == "space":
        table[[32, *range(9, 14)]] = True
    else:
        table[:128] = True
        for span in (range(48, 58), range(65, 91), range(97, 123)):
            table[list(span)] = False
    return table


def _lowered(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return raw + ((raw - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def chunks(texts: pa.Array, size: int = _CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about size bytes: first row, end row, their bytes with A-Z lower-cased, offsets. Null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    at = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + size, side="right")) - 1)
        end = min(end, n)
        yield first, end, _lowered(raw[at[first] : at[end]]), at[first : end + 1] - at[first]
        first = end


def words(buf: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in buf, and for each text the number of words before it (one more entry than texts)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~sep[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def spelled(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of each span; spans are in order and do not overlap."""
    step = np.zeros(len(buf) + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1
    cuts = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends - starts)])
    inside = buf[np.cumsum(step[:-1], dtype=np.int8) > 0]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(inside)])


def distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The different spans, told apart by their bytes, and the number of each span's own among them."""
    coded = spelled(buf, starts, ends).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


_ODD, _ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_LONG = 512  # bytes; longer spans are hashed by XXH64


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same for the same bytes everywhere: lanes of eight bytes, mixed in one after the other."""
    lanes = np.ndarray(len(buf) + 1, "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    size = ends - starts
    h = mixed(size.astype(np.uint64) * _ODD + _ADD)
    at = np.flatnonzero((size > 0) & (size <= _LONG))
    place, left = starts[at], size[at]
    while len(at):
        lane = lanes[place] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * np.maximum(8 - left, 0).astype(np.uint64)))
        h[at] = mixed((h[at] ^ lane) * _ODD + _ADD)
        more = left > 8
        at, place, left = at[more], place[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]].tobytes())
    return h
