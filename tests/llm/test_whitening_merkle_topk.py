"""Whitening, Merkle manifest and top-k search against brute force, with nulls, ties, repeats, empty tables and other shapes."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfline.llm import merkle, topk, vectors, whitening

VECTORS = "vec_id long, embedding array<float>, label int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def folder_of(tmp_path_factory, df, table):
    path = str(tmp_path_factory.mktemp("sf"))
    df.write.parquet(f"{path}/{table}.parquet")
    return path


@pytest.fixture(scope="module")
def vecs():
    r = np.random.default_rng(3)
    rows = [(i * 10, [float(x) for x in r.normal(0, [0.5, 0.3, 0.2, 0.1, 0.05, 0.01]).astype(np.float32)], 1) for i in range(150)]
    rows += [(5000 + i, rows[3][1], 2) for i in range(60)]  # one common vector
    rows += [(700, rows[4][1], 3), (None, rows[5][1], 3), (7, None, 0), (8, [0.1, None, 0.0, 0.0, 0.0, 0.0], 0), (9, [float("nan")] * 6, 0), (11, [float("inf")] + [0.0] * 5, 0)]
    return rows + [(12, [0.25, -0.25], 4), (200, [], 4), (7, None, 0)]


def whole(rows, scale, dims=6):
    ok = [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    return ok, np.array([[int(np.floor(scale * float(np.float32(c)))) for c in r[1]] + [0] * (dims - len(r[1])) for r in ok], np.int64)


# Whitening


def test_whitened_rows_are_those_of_an_eigensolver(spark, vecs, tmp_path_factory):
    got = whitening.op11_whitening(spark, folder_of(tmp_path_factory, spark.createDataFrame(vecs, VECTORS).repartition(5), "embeddings"))
    rows = got.collect()
    ok, x = whole(vecs, 256)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    cov = (fit - s / n).T @ (fit - s / n) / n
    values, vectors_ = (a[..., ::-1][..., :4] for a in np.linalg.eigh(cov))
    z = (x - s / n) @ vectors_ / np.sqrt(values)
    assert len(rows) == 4 * len(ok) and {r.n for r in rows} == {n} and max(r.identity_error for r in rows) < 1e-9
    for c in range(1, 5):
        mine = sorted((r.vec_id is None, r.vec_id or 0, r.deviation, r.whitened) for r in rows if r.component == c)
        sign = np.sign(sum(r.whitened * z[[o[0] for o in ok].index(r.vec_id), c - 1] for r in rows if r.component == c and r.vec_id is not None and r.vec_id < 150 and r.vec_id != 12))
        want = sorted((o[0] is None, o[0] or 0, int(((n * v - s) ** 2).sum()), sign * y[c - 1]) for o, v, y in zip(ok, x, z, strict=True))
        assert [m[:3] for m in mine] == [w[:3] for w in want]
        assert np.allclose([m[3] for m in mine], [w[3] for w in want], atol=1e-9)
        assert np.allclose({r.explained for r in rows if r.component == c}.pop(), values[c - 1] / np.trace(cov), rtol=1e-9)


def test_inertia_counts_eigenvalues():
    r = np.random.default_rng(1)
    for d in (1, 2, 5, 17):
        a = r.normal(size=(d, d))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in [*(values[:-1] + values[1:]) / 2, values[0] - 1, values[-1] + 1, 0.0]:
            assert whitening.above(a, shift) == (values > shift).sum()
    hollow = np.array([[0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 0.0]])  # no usable pivot on the diagonal
    assert whitening.above(hollow, 0.0) == 1


@pytest.mark.parametrize("values", [[9, 5, 4, 1, 0.5], [5, 5, 5, 2, 1], [7, 7 * (1 + 1e-9), 3, 3, 3], [3, 0, 0, 0, 0], [0] * 5, [1e12, 1, 1e-9, 0, 0]])
def test_leading_vectors_whatever_their_distances(values):
    q = np.linalg.qr(np.random.default_rng(5).normal(size=(5, 5)))[0]
    a = q @ np.diag(np.array(values, float)) @ q.T
    a = (a + a.T) / 2
    got, v = whitening.leading(a, 4)
    scale = max(max(values), 1e-300)
    assert np.allclose(got, sorted(values, reverse=True)[:4], atol=1e-12 * scale, rtol=0)
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-9) and np.allclose(a @ v, v * got, atol=1e-9 * scale)


def test_whitening_of_few_rows_and_other_columns(spark, tmp_path_factory):
    empty = spark.createDataFrame([], VECTORS)
    assert whitening.op11_whitening(spark, folder_of(tmp_path_factory, empty, "embeddings")).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, VECTORS)
    rows = whitening.op11_whitening(spark, folder_of(tmp_path_factory, one, "embeddings")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(rows, key=lambda r: r.component)] == [(c, 1, 0, None, 0.0, 0.0) for c in (1, 1, 1, 2, 2, 2)]
    assert whitening.op11_whitening(spark, folder_of(tmp_path_factory, spark.createDataFrame([(1, [], 0)], VECTORS), "embeddings")).collect() == []
    odd = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.0, 4.0], None), (3, None, "y"), (4, [1e30, 0.0], "z")], "whitened int, `_made` array<double>, x string")
    model = whitening.fit(odd, "_made")
    got = whitening.transform(odd, model, "_made", out="out")
    assert got.columns == ["whitened", "_made", "x", "out", "deviation"]
    by = {r.whitened: r for r in got.collect()}
    assert by[3].out is None and by[3].deviation is None and by[4].deviation is None and by[1].deviation is None and model.n == 3


# Merkle manifest


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def field(v):
    return b"-" if v is None else str(len(str(v).encode())).encode() + b":" + str(v).encode()


def levels_of(leaves, arity):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
    return out


def way(levels, i, arity):
    for level in levels[:-1]:
        first = i // arity * arity
        yield level[first:i], level[i + 1 : first + arity]
        i //= arity


def expected(rows, arity, tampers=lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 0):
    trees = {}
    for i, text, lang, source, n in rows:
        leaf, bad = (sha(b"".join(map(field, (i, source, lang, m, text)))) for m in (n, n + 1 if n is not None and tampers(i) else n))
        trees.setdefault(lang, []).append(((i is not None, i or 0), leaf, i, bad))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: levels_of([t[1] for t in sorted(trees[x], key=lambda t: t[:2])], arity) for x in langs}
    top, out = levels_of([built[x][-1][0] for x in langs], arity), []
    for at, x in enumerate(langs):
        for k, (_, leaf, i, node) in enumerate(sorted(trees[x], key=lambda t: t[:2])):
            path = [*way(built[x], k, arity), *way(top, at, arity)]
            for left, right in path:
                node = sha("".join(left) + node + "".join(right))
            out.append((i, leaf, built[x][-1][0], top[-1][0], sha("".join(s for a, b in path for s in a + b)), node, node == top[-1][0]))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def documents():
    out = [(i, f"text {i} " + "é日" * (i % 5), "en" if i % 3 else ("fr" if i % 2 else None), "a" if i % 4 else None, i if i % 11 else None) for i in range(260)]
    out += [(i, None, "de", None, None) for i in (7, 7, 8)] + [(None, "", "en", "b", 3), (None, "", "en", "b", 3), (None, None, None, None, None)]
    return out + [(300, "one alone", "é", "a", 9), (301, "word " * 40_000, "en", "a", 2**63 - 1), (302, "x", "zz", "a", 0), (303, "y", "zz", "a", 0)] + [(304, "same", "en", "a", 4)] * 70


def test_manifest_is_that_of_plain_trees(spark, documents, tmp_path_factory):
    got = merkle.op12_merkle(spark, folder_of(tmp_path_factory, spark.createDataFrame(documents, DOCS).repartition(6), "documents"))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = expected(documents, 2)
    assert sorted(map(tuple, got.collect()), key=repr) == want and {w[-1] for w in want} == {True, False}


@pytest.mark.parametrize(("arity", "levels"), [(2, 1), (2, 2), (3, 1), (5, 2)])
def test_trees_of_many_tiers(spark, documents, arity, levels):
    docs = spark.createDataFrame([(*d, "extra") for d in documents[:90]], f"{DOCS}, digest string")
    done = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", F.struct("doc_id"), arity, levels)
    got = done.select("own.doc_id", "digest", "subroot", "root", merkle.proof(F.col("path")), merkle.folded(F.col("digest"), F.col("path")), F.lit(True)).collect()
    assert sorted(map(tuple, got), key=repr) == expected(documents[:90], arity, lambda i: False)


def test_manifest_of_nothing_and_of_one(spark, tmp_path_factory):
    assert merkle.op12_merkle(spark, folder_of(tmp_path_factory, spark.createDataFrame([], DOCS), "documents")).collect() == []
    one = [(14, "a", "en", "s", 1)]
    got = merkle.op12_merkle(spark, folder_of(tmp_path_factory, spark.createDataFrame(one, DOCS), "documents")).collect()
    assert list(map(tuple, got)) == expected(one, 2) and got[0].proof_sha256 == sha("") and got[0].leaf == got[0].root


# Top-k search


def brute(rows, k=10, asks=lambda i: i is not None and i % 100 == 0):
    ok, x = whole(rows, topk.SCALE)
    out = []
    for at, r in enumerate(ok):
        if asks(r[0]):
            scored = sorted((-int(x[at] @ x[j]), o[0] is None, o[0] or 0) for j, o in enumerate(ok) if j != at)
            out += [(r[0], rank + 1, None if s[1] else s[2], -s[0]) for rank, s in enumerate(scored[:k])]
    return sorted(out, key=repr)


def test_best_rows_are_those_of_all_scores(spark, vecs, tmp_path_factory):
    got = topk.op13_topk(spark, folder_of(tmp_path_factory, spark.createDataFrame(vecs, VECTORS).repartition(3), "embeddings"))
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and sorted(map(tuple, got.collect()), key=repr) == brute(vecs)


@pytest.mark.parametrize(("run", "block", "tile", "k"), [(16, 3, 40, 3), (64, 7, 1000, 1), (7, 100, 9, 400)])
def test_tiles_and_runs_of_any_size_find_the_same(spark, vecs, monkeypatch, run, block, tile, k):
    for name, value in (("RUN", run), ("BLOCK", block), ("TILE_ROWS", tile), ("TILE_QUERIES", 4), ("LEAST_ROWS", 1000)):
        monkeypatch.setattr(topk, name, value)
    df = spark.createDataFrame([(*v, "x") for v in vecs], "key long, v array<float>, score int, rank string")
    got = topk.search(df, "key", "v", F.col("key") % 100 == 0, k)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(vecs, k)


def test_bounds_leave_out_most_pairs_and_no_winner():
    r = np.random.default_rng(2)
    rows = np.floor(r.normal(0, 128, (2048, 16)) * np.exp(-np.arange(16) / 2))
    queries, k = rows[:20], 5
    own = np.array([(i, i) for i in range(20)])
    scores = rows @ queries.T
    scores[own[:, 0], own[:, 1]] = -np.inf
    bar = np.sort(scores, axis=0)[-k]
    a, b = topk.pruned(rows, np.sort(rows, axis=0), queries, own, np.full(20, -np.inf), k, 0.0)
    assert {(i, j) for i, j in zip(*np.nonzero(scores >= bar), strict=True)} <= set(zip(a.tolist(), b.tolist(), strict=True)) and len(a) < 0.1 * scores.size


def test_scores_beyond_exact_doubles(spark):
    big = [(i * 100, [1.0e6 + i % 7 / 1024, -1.5e6, float(i)], 0) for i in range(40)]
    df = spark.createDataFrame(big, "vec_id long, v array<double>, label int")
    got = topk.search(df, "vec_id", "v", F.col("vec_id") % 100 == 0, 5).collect()
    x = [[int(np.floor(1024 * c)) for c in v] for _, v, _ in big]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    for i, (key, _, _) in enumerate(big):
        want = sorted((-min(dot(x[i], x[j]), 2**63 - 1), big[j][0]) for j in range(40) if j != i)[:5]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == key] == want


def test_search_in_nothing(spark, tmp_path_factory):
    assert topk.op13_topk(spark, folder_of(tmp_path_factory, spark.createDataFrame([], VECTORS), "embeddings")).collect() == []
    assert topk.op13_topk(spark, folder_of(tmp_path_factory, spark.createDataFrame([(100, [1.0], 0)], VECTORS), "embeddings")).collect() == []


def test_usable_vectors_and_whole_numbers(spark):
    df = spark.createDataFrame([(1, [0.5, -0.001]), (2, None), (3, [None]), (4, []), (5, [1e300, -1e300])], "i int, v array<double>")
    rows = df.select("i", vectors.usable(F.col("v")).alias("u"), vectors.integers(F.col("v"), 256).alias("x")).collect()
    assert [r.u for r in rows] == [True, False, False, True, True] and rows[0].x == [128, -1] and rows[4].x == [vectors.LIMIT, -vectors.LIMIT]
