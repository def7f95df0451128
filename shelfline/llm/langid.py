"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's likelihood is the sum, over all
of its segmentations into pieces, of the products of their probabilities; a forward pass over byte positions gives it,
scaled as it goes, so that words of any length are taken whole. A text's likelihood is the product over its words. Piece
probabilities are learned by expectation maximisation: Spark tasks run the forward and the backward pass over the
different words of each language, and Spark adds up the expected counts.

Letters only are scored: white space, ASCII digits and symbols separate words. Pieces are the vocabulary's, without
white space around them and with A-Z in lower case, like the words; letters beyond ASCII keep their case.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, crc_mod, distinct, fresh, lean, mixed, separators, tidy, words, written

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SAMPLE = 4000  # different texts of each language that are learned from, about
ROUNDS = 4

_BYTES = 1 << 16  # of words whose lattices are walked together; a longer word is walked alone
_CELLS = 1 << 20  # sums held while walking
_SCALED = 16  # places between two scalings
_FLOOR = 1e-9
_TINY = 1e-300
_SLICE = 4096  # pieces whose expected counts travel in a row
_LETTERS = separators("symbol")
_LETTERS[48:58] = True


class Pieces:
    """The pieces of the vocabulary file as a trie; every single byte is a piece, so every word can be cut up."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            found = {base64.b64decode(line.split()[0]).strip().lower() for line in f}
        self.names = sorted((found - {b""}) | {bytes([i]) for i in range(256)})
        self.number = len(self.names)
        self.length = np.array([len(x) for x in self.names])
        self.longest = int(self.length.max())
        child, piece = {}, [-1]
        for i, name in enumerate(self.names):
            node = 0
            for b in name:
                node = child.setdefault(node << 8 | b, len(piece))
                if node == len(piece):
                    piece.append(-1)
            piece[node] = i
        self.piece = np.array(piece, np.int32)
        keys = np.fromiter(child, np.int64, len(child))
        order = np.argsort(mixed(keys.view(np.uint64)))
        self.key, self.child = keys[order], np.fromiter(child.values(), np.int32, len(child))[order]
        # Where to look by the leading bits of a key's hash; exact keys are compared from there on.
        bounds = np.searchsorted(mixed(self.key.view(np.uint64)), np.arange(1 << 18, dtype=np.uint64) << np.uint64(46))
        self.start = bounds.astype(np.int32)
        self.reach = int(np.diff(np.append(bounds, len(self.key))).max())
        self.root = self.next(np.zeros(256, np.int32), np.arange(256, dtype=np.uint8))

    def next(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node by a byte, -1 without one."""
        key = node.astype(np.int64) << 8 | byte
        at, out = self.start[mixed(key.view(np.uint64)) >> np.uint64(46)], np.full(len(key), -1, np.int32)
        for k in range(self.reach):
            i = np.minimum(at + k, len(self.key) - 1)
            hit = self.key[i] == key
            out[hit] = self.child[i[hit]]
        return out

    def lattice(self, buf: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, start, end and piece of every piece in words that stand one after the other in buf."""
        word = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(buf)) - np.repeat(np.cumsum(size) - size, size)
        at, node, n, found = np.arange(len(buf)), self.root[buf], 1, []
        while len(at):
            ends = self.piece[node] >= 0
            own = at[ends]
            found.append((word[own], place[own], place[own] + n, self.piece[node[ends]]))
            more = place[at] + n < size[word[at]]
            at, node = at[more], node[more]
            node = self.next(node, buf[at + n])
            at, node, n = at[node >= 0], node[node >= 0], n + 1
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _resolved(path: str | None) -> str:
    return path or public_tokenizers.path(VOCABULARY)


def _blocks(found: pa.Array, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words by length in blocks of about _BYTES bytes and `rows` words at most: their places in found, bytes and sizes."""
    size = pc.binary_length(found).to_numpy().astype(np.int64)
    order = np.argsort(size, kind="stable")
    total = np.cumsum(size[order])
    first = int(np.searchsorted(size[order], 1))  # empty words have a likelihood of one
    while first < len(order):
        end = int(np.searchsorted(total, (total[first - 1] if first else 0) + _BYTES, side="right"))
        at = order[first : min(max(end, first + 1), first + rows)]
        yield at, np.frombuffer(b"".join(found.take(pa.array(at)).to_pylist()), np.uint8), size[at]
        first += len(at)


def _sums(lattice: tuple, size: np.ndarray, prob: np.ndarray, longest: int, every: bool = False) -> np.ndarray:
    """Log of the sum over all segmentations, for words in order of their sizes; one column for each column of prob.

    every: for each place of each word, from 0 to its size, the same of the word's bytes before it.
    """
    word, start, end, piece = lattice
    order = np.argsort(start, kind="stable")
    word, start, end, piece = word[order], start[order], end[order], piece[order]
    n, k, most, ring = len(size), prob.shape[1], int(size[-1]), longest + 1
    sums, scale = np.zeros((ring, n, k)), np.zeros((n, k))
    sums[0] = 1
    first, left = np.searchsorted(start, np.arange(most + 2)), np.searchsorted(size, np.arange(most + 2))
    own = np.cumsum(size + 1) - size - 1
    out = np.empty((int((size + 1).sum()) if every else n, k))
    for s in range(most + 1):
        low, after, now = left[s], left[s + 1], sums[s % ring]
        if s % _SCALED == 0 and s and after < n:
            top = np.maximum(sums[:, after:].max(0), _TINY)
            sums[:, after:] /= top
            scale[after:] += np.log(top)
        if every:
            out[own[low:] + s] = np.log(np.maximum(now[low:], _TINY)) + scale[low:]
        elif after > low:
            out[low:after] = np.log(np.maximum(now[low:after], _TINY)) + scale[low:after]
        here = slice(first[s], first[s + 1])
        rows = word[here]
        sums[end[here] % ring, rows] += now[rows] * prob[piece[here]]
        now[:] = 0
    return out


def forward(voc: Pieces, prob: np.ndarray, found: pa.Array) -> np.ndarray:
    """Log likelihood of each word under each language; prob: pieces x languages."""
    out = np.zeros((len(found), prob.shape[1]))
    for at, buf, size in _blocks(found, max(1, _CELLS // ((voc.longest + 1) * max(1, prob.shape[1])))):
        out[at] = _sums(voc.lattice(buf, size), size, prob, voc.longest)
    return out


def expected(voc: Pieces, prob: np.ndarray, found: pa.Array, count: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words, of which each occurs `count` times; prob: one for each piece."""
    out, log_prob = np.zeros(voc.number), np.log(prob)
    for at, buf, size in _blocks(found, max(1, _CELLS // (voc.longest + 1))):
        word, start, end, piece = voc.lattice(buf, size)
        before = _sums((word, start, end, piece), size, prob[:, None], voc.longest, every=True)[:, 0]
        after = _sums((word, size[word] - end, size[word] - start, piece), size, prob[:, None], voc.longest, every=True)[:, 0]
        own = np.cumsum(size + 1) - size - 1
        share = np.exp(before[own[word] + start] + log_prob[piece] + after[own[word] + size[word] - end] - before[own + size][word])
        out += np.bincount(piece, share * count[at][word], voc.number)
    return out


def learn(counts: DataFrame, rounds: int = ROUNDS, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages, and piece probabilities (pieces x languages), from a table of lang, word (binary) and count.

    The driver receives one number for each piece and language in a round, which is the size of the model.
    """
    spark, number = counts.sparkSession, pieces(_resolved(path)).number
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())  # as many as the model has columns
    start = np.exp(-1.0 * pieces(_resolved(path)).length)
    prob = np.repeat((start / start.sum())[:, None], len(langs), axis=1)

    def added(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.float64) for x in table.column("expected").to_pylist()], axis=0)
        return pa.table({"lang": table.column("lang").slice(0, 1), "slice": table.column("slice").slice(0, 1), "expected": pa.array([total.tobytes()], pa.binary())})

    for _ in range(rounds if langs else 0):
        shared = spark.sparkContext.broadcast(prob)

        @tidy
        def counted(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            voc, total = pieces(_resolved(path)), {}
            for batch in batches:
                own = batch.column(0).to_pylist()
                for lang in set(own):
                    at = np.flatnonzero(np.array([x == lang for x in own]))
                    found = expected(voc, shared.value[:, langs.index(lang)], batch.column(1).take(pa.array(at)), batch.column(2).to_numpy()[at])
                    total[lang] = total.get(lang, 0) + found
            for lang, found in total.items():
                parts = [found[k : k + _SLICE].tobytes() for k in range(0, number, _SLICE)]
                yield pa.record_batch([pa.array([lang] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["lang", "slice", "expected"])

        kind = "lang string, slice int, expected binary"
        for row in counts.mapInArrow(counted, kind).groupBy("lang", "slice").applyInArrow(added, kind).toLocalIterator():
            part = np.frombuffer(bytes(row.expected), np.float64)
            prob[row.slice * _SLICE : row.slice * _SLICE + len(part), langs.index(row.lang)] = part + 0.01
        prob = np.maximum(prob / prob.sum(0), _FLOOR)
        shared.unpersist()
    return langs, prob


def word_counts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """lang, word (binary), count: how often each word occurs in the texts of each language."""

    @tidy
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0)
            for first, end, buf, offsets in chunks(batch.column(1)):
                starts, ends, before = words(buf, offsets, _LETTERS)
                found, at = distinct(buf, starts, ends)
                names = langs.slice(first, end - first).dictionary_encode()
                own = np.repeat(names.indices.to_numpy().astype(np.int64), np.diff(before))
                pair, n = np.unique(own * max(1, len(found)) + at, return_counts=True)
                yield pa.record_batch(
                    [names.dictionary.take(pa.array(pair // max(1, len(found)))), found.take(pa.array(pair % max(1, len(found)))).cast(pa.binary()), pa.array(n)], names=["lang", "word", "n"]
                )

    rows = lean(docs).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("t"))
    return rows.mapInArrow(counted, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("count"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, rounds: int = ROUNDS, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Learns from about `sample` different texts of each language, all if there are fewer, and from all of their words.

    Texts are chosen by a hash of themselves, so that neither a key that repeats nor copies of one text are chosen
    together; equal texts of a language count once. Rows without text or lang are left out.
    """
    h = F.xxhash64("t")
    known = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("t")).dropna()
    sizes = known.groupBy("lang").agg(F.approx_count_distinct(h, 0.02).alias("n")).collect()  # one row for each column of the model
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, sample / max(1, r.n)))]) if sizes else F.create_map().cast("map<string,double>")
    chosen = known.where(F.pmod(h, F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    counts = word_counts(chosen.dropDuplicates(["lang", "t"]), "lang", "t")
    return learn(written(counts, "lexicon"), rounds, path)


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", path: str | None = None, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds `pred`, a language, and `score`, its probability among the languages with equal priors.

    A text that is null or has no letter, and any text where no language was learned, is `und` with score 0. Among
    languages that are equally likely the first by name is predicted. Columns already named so are replaced.
    """
    langs = model[0]
    shared = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model[1]))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    @tidy
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        voc, prob = pieces(_resolved(path)), shared.value
        for batch in batches:
            names, scores = [], []
            for first, end, buf, offsets in chunks(batch, 3 << 20):
                starts, ends, before = words(buf, offsets, _LETTERS)
                total = np.zeros((end - first, max(1, len(langs))))
                if len(starts) and langs:
                    found, at = distinct(buf, starts, ends)
                    likely = forward(voc, prob, found)
                    doc = np.repeat(np.arange(end - first), np.diff(before))
                    for k in range(len(langs)):
                        total[:, k] = np.bincount(doc, likely[at, k], end - first)
                best = total.argmax(1)
                odds = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                some = np.diff(before) > 0
                for i in np.flatnonzero(some).tolist():
                    own = buf[offsets[i] : offsets[i + 1]]
                    if not ((own >= 97) & (own <= 122)).any():
                        some[i] = any(c.isalpha() for c in own.tobytes().decode("utf-8", "replace"))
                some &= bool(langs)
                names += [langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                scores += np.where(some, odds, 0.0).tolist()
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    own = fresh(df, "_judged")
    both = lean(df).withColumn(own, judged(F.col(f"`{text}`").cast("string")))
    return both.withColumn(pred, F.col(own)["lang_pred"]).withColumn(score, F.col(own)["score"]).drop(own)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts every document's language; learns from three quarters of the documents, by crc32 of doc_id.

    Null texts and texts without a letter are `und`; without any labelled text all are. Rows that share a doc_id, or
    have none, are judged one by one.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 4) == 2
    model = fit(docs.where(~held_out))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
