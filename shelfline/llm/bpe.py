"""Byte-level BPE encoding and decoding.

Each match of the pattern is merged on its own. A segment tree over its byte positions keeps, in every node, the
smallest rank of a neighbouring pair with the leftmost position on ties; the root names the next merge, and a merge
changes three leaves (the merged position, its dead right neighbour, its left neighbour), each of which is carried
up in logarithmically many steps. Trees of many distinct matches of like length are kept in one array and advance together.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, tidy

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

_NONE = 65535  # no token; a rank must be below it
_INF = np.int64(1) << np.int64(62)
_POS = 24  # bits of a position in a node of a shared array
_WIDE = 512  # bytes from which a match gets a tree of its own
_CACHE, _CACHE_BYTES = 400_000, 32 << 20  # distinct matches kept by a Python worker, and their bytes and ids', at most


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(self.ranks.values()) >= _NONE:
            raise ValueError("the vocabulary has too many tokens for 16-bit pairs")
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for word, rank in self.ranks.items():
            self.token[rank] = word
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.found: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0  # of found

    @cached_property
    def pairs(self) -> dict[int, int]:
        """Rank of each pair's union; a pair is two ids of 16 bits."""
        found = {}
        for word, rank in self.ranks.items():
            for i in range(1, len(word)):
                a, b = self.ranks.get(word[:i]), self.ranks.get(word[i:])
                if a is not None and b is not None:
                    found[a << 16 | b] = rank
        return found

    @cached_property
    def keys(self) -> np.ndarray:
        return np.array(sorted(self.pairs), np.int64)

    @cached_property
    def merged(self) -> np.ndarray:
        return np.array([self.pairs[k] for k in self.keys.tolist()], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's union, _INF without one."""
        key = a << 16 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _INF >> _POS)

    def encode_many(self, matches: list[bytes]) -> list[np.ndarray]:
        """Token ids of each match."""
        out: list[np.ndarray | None] = [None] * len(matches)
        by_width: dict[int, list[int]] = {}
        for i, m in enumerate(matches):
            if (whole := self.ranks.get(m)) is not None:
                out[i] = np.array([whole], np.uint32)
            elif len(m) > _WIDE:
                out[i] = np.array(self._encode_long(m), np.uint32)
            else:
                by_width.setdefault(max(1, (len(m) - 1).bit_length()), []).append(i)
        for bits, rows in by_width.items():
            for k in range(0, len(rows), step := max(1, (1 << 18) >> bits)):
                part = rows[k : k + step]
                for i, ids in zip(part, self._encode_block([matches[i] for i in part], 1 << bits), strict=True):
                    out[i] = ids
        return out

    def _encode_block(self, matches: list[bytes], width: int) -> list[np.ndarray]:
        n, size = len(matches), np.array([len(m) for m in matches])
        padded = np.frombuffer(b"".join(m.ljust(width, b"\0") for m in matches), np.uint8).reshape(n, width)
        there = np.arange(width) < size[:, None]
        token = np.full((n, width + 2), _NONE, np.int64)  # column width: past the end; width + 1: before the start
        token[:, :width] = np.where(there, self.byte[padded], _NONE)
        right = np.tile(np.arange(1, width + 3), (n, 1))
        right[:, :width] = np.where(np.arange(1, width + 1) < size[:, None], np.arange(1, width + 1), width)
        left = np.tile(np.arange(-1, width + 1), (n, 1))
        left[:, 0] = width + 1
        tree = np.full((n, 2 * width), _INF, np.int64)
        ranks = self.rank(token[:, : width - 1], token[:, 1:width])
        tree[:, width : 2 * width - 1] = np.where(ranks < _INF >> _POS, ranks << _POS | np.arange(width - 1), _INF)
        node = width
        while node > 1:
            tree[:, node // 2 : node] = np.minimum(tree[:, node : 2 * node : 2], tree[:, node + 1 : 2 * node : 2])
            node //= 2
        live, rows = there.copy(), np.arange(n)
        while True:
            root = tree[rows, 1]
            going = root < _INF
            rows, root = rows[going], root[going]
            if not len(rows):
                break
            at, rank = root & ((1 << _POS) - 1), root >> _POS
            dead, before = right[rows, at], left[rows, at]
            after = right[rows, dead]
            token[rows, at] = rank
            live[rows, dead] = False
            right[rows, at] = after
            left[rows, after] = at
            tree[rows, width + dead] = _INF
            tree[rows, width + at] = self._leaf(rank, token[rows, after], at)
            inner = before <= width
            r, b = rows[inner], before[inner]
            tree[r, width + b] = self._leaf(token[r, b], rank[inner], b)
            for r, leaf in ((rows, dead), (rows, at), (r, b)):
                up = (width + leaf) >> 1
                for _ in range(width.bit_length() - 1):
                    tree[r, up] = np.minimum(tree[r, 2 * up], tree[r, 2 * up + 1])
                    up >>= 1
        ids = token[:, :width][live].astype(np.uint32)
        return np.split(ids, np.cumsum(live.sum(1))[:-1])

    def _leaf(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        ranks = self.rank(a, b)
        return np.where(ranks < _INF >> _POS, ranks << _POS | at, _INF)

    def _encode_long(self, match: bytes) -> array:
        """One tree of its own in packed arrays, about 40 bytes for a byte; for a single long match the other form has too few rows.

        Positions take as many bits as the match needs.
        """
        n, inf, pairs = len(match), int(_INF), self.pairs
        width, bits = 1 << (n - 1).bit_length(), n.bit_length()
        token = array("q", self.byte[np.frombuffer(match, np.uint8)].tobytes())
        left, right = array("q", range(-1, n - 1)), array("q", range(1, n + 1))
        tree = array("q", [inf]) * (2 * width)

        def leaf(i: int, j: int) -> int:
            rank = pairs.get(token[i] << 16 | token[j]) if i >= 0 and j < n else None
            return inf if rank is None else rank << bits | i

        for i in range(n - 1):
            tree[width + i] = leaf(i, i + 1)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        live = bytearray(b"\1") * n
        while (root := tree[1]) < inf:
            at = root & ((1 << bits) - 1)
            dead, before = right[at], left[at]
            after = right[dead]
            token[at], live[dead], right[at] = root >> bits, 0, after
            if after < n:
                left[after] = at
            for i, value in ((dead, inf), (at, leaf(at, after)), (before, leaf(before, at))):
                if i >= 0:
                    node = width + i
                    tree[node] = value
                    while node > 1:
                        node >>= 1
                        tree[node] = min(tree[2 * node], tree[2 * node + 1])
        return array("q", compress(token, live))

    def learn(self, matches: set[str]) -> None:
        """Encodes what is not yet known. When the cache is half full it becomes the older half, from which matches that
        recur are taken over, so that frequent ones stay.
        """
        if len(self.found) + len(matches) > _CACHE // 2 or self.size > _CACHE_BYTES // 2:
            self.older, self.found, self.size = self.found, {}, 0
        open_ = [m for m in matches if m not in self.found]
        new = [m for m in open_ if m not in self.older]
        self.found |= {m: self.older[m] for m in open_ if m in self.older}
        self.found |= zip(new, (ids.astype("<u4").tobytes() for ids in self.encode_many([m.encode() for m in new])), strict=True)
        self.size += sum(len(m) + len(self.found[m]) for m in open_)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """One to a Python worker."""
    return Vocabulary(path)


def _resolved(path: str | None) -> str:
    return path or public_tokenizers.path(VOCABULARY)


def encode(df: DataFrame, text: str = "text", out: str = "token_ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds `out`: token ids as a binary of little-endian unsigned 32-bit integers.

    Null and empty texts give an empty binary. Every other column stays; a column already named `out` is replaced.
    path: a file of ranks that exists on every executor. Special tokens have no meaning: their text is plain text.
    """
    pattern = pattern or public_tokenizers.PATTERN

    @F.arrow_udf("binary")
    @tidy
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        voc, split = vocabulary(_resolved(path)), regex.compile(pattern).findall
        for batch in batches:
            done, row = [], 0
            while row < len(batch):
                found, seen, size = [], set(), 0
                while row < len(batch) and size < 1 << 20:
                    value = batch[row].as_py() or ""
                    found.append(split(value))
                    seen.update(found[-1])
                    size, row = size + len(value), row + 1
                voc.learn(seen)
                done += [b"".join(map(voc.found.__getitem__, f)) for f in found]
            yield pa.array(done, pa.binary())

    return lean(df).withColumn(out, encoded(F.col(f"`{text}`")))


def decode(df: DataFrame, ids: str = "token_ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds `out`: the bytes of the tokens in `ids` (as encode() writes them). Null gives an empty binary."""

    @F.arrow_udf("binary")
    @tidy
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = vocabulary(_resolved(path)).token
        for batch in batches:
            yield pa.array([b"".join([token[i] for i in np.frombuffer(x.as_buffer() or b"", "<u4").tolist()]) if x.is_valid else b"" for x in batch], pa.binary())

    return lean(df).withColumn(out, decoded(F.col(f"`{ids}`")))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document; null and empty texts have no tokens. Rows that repeat are encoded each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(decode(encode(docs)))


def digests(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id",
        (F.length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
