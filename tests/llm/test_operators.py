"""Each operator against a brute-force version on small tables with nulls, blanks, ties, repeats and long texts."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from shelfline.llm import bpe, common, decontaminate, langid, licenses, minhash, ngram_lm, ranks, secrets, sharding, simhash, urls
from shelfline.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

EN = "the quick brown fox jumps over the lazy dog and runs into the green forest near the river bank today"
FR = "le renard brun saute par dessus le chien paresseux et court dans la forêt verte près de la rivière"
LONG = " ".join(f"word{i % 97} other{i % 89}" for i in range(30_000))


@pytest.fixture(scope="module")
def rows():
    out = [(0, EN, "en", "a"), (1, EN, "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \t\n ", "fr", "b"), (5, FR, "fr", None), (6, "12 34 !!", "fr", "b")]
    out += [(7, LONG, "en", "a"), (7, LONG, "en", "a"), (8, EN.upper() + " PASSWORD='abcd1234efgh'", "en", "a"), (9, "ééé 日本語 😀 " * 40, None, "c"), (None, "no key here at all, only words", "en", "a"), (None, None, None, None)]
    out += [(20 + i, (EN if i % 2 else FR) + f" number{i}", "en" if i % 2 else "fr", "abc"[i % 3]) for i in range(60)]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def folder_of(tmp_path_factory, docs, name="sf"):
    path = str(tmp_path_factory.mktemp(name))
    docs.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def folder(tmp_path_factory, docs):
    return folder_of(tmp_path_factory, docs)


@pytest.fixture(scope="module")
def empty_folder(tmp_path_factory, empty):
    return folder_of(tmp_path_factory, empty, "none")


# Shared pieces


def test_words_are_told_apart_by_their_bytes():
    one = "0"
    for _ in range(10):
        one += one.translate(str.maketrans("01", "10"))
    one = one.translate(str.maketrans("01", "ab"))
    two = one.translate(str.maketrans("ab", "ba"))  # a polynomial modulo a power of two hashes both alike
    buf = np.frombuffer(f"{one} {two} {one}".encode(), np.uint8)
    starts, ends, _ = common.words(buf, np.array([0, len(buf)]), common.separators("space"))
    found, at = common.distinct(buf, starts, ends)
    assert found.to_pylist() == [one.encode(), two.encode()] and at.tolist() == [0, 1, 0]
    h = common.span_hashes(buf, starts, ends)
    assert h[0] == h[2] == xxhash.xxh64_intdigest(one) != h[1]
    short = np.frombuffer(b"abcdefgh abcdefghi x abcdefgh " + b"y" * 512, np.uint8)
    starts, ends, _ = common.words(short, np.array([0, len(short)]), common.separators("space"))
    h = common.span_hashes(short, starts, ends)
    assert h[0] == h[3] and len(set(h.tolist())) == 4 and h[2] == common.span_hashes(short[19:20], np.array([0]), np.array([1]))[0]


def test_components_of_a_path_a_star_and_a_pair(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1: encoding


def test_encoding_is_that_of_the_library(docs, rows):
    voc = bpe.vocabulary(public_tokenizers.path(bpe.VOCABULARY))
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=voc.ranks, special_tokens={})
    texts = [r[1] or "" for r in rows] + ["a" * 5000, "ab" * 700 + " <|endoftext|>", "x" * 513, "\n\n \n", "aaaabbbb" * 9]
    for t in texts:
        voc.learn(set(re.findall(r"(?s).+", t)) and set(__import__("regex").findall(public_tokenizers.PATTERN, t)))
        ids = b"".join(voc.found[m] for m in __import__("regex").findall(public_tokenizers.PATTERN, t))
        assert np.frombuffer(ids, "<u4").tolist() == want.encode_ordinary(t)


def test_decoding_returns_every_text(docs):
    got = bpe.decode(bpe.encode(docs.withColumn("token_ids", F.lit("taken"))))
    assert got.where("NOT decoded <=> cast(coalesce(text, '') as binary)").count() == 0
    assert set(docs.columns) <= set(got.columns) and got.count() == docs.count()


def test_long_matches_have_trees_of_any_depth(monkeypatch):
    voc = bpe.vocabulary(public_tokenizers.path(bpe.VOCABULARY))
    for m in (b"ab" * 3000, "größe".encode() * 150, b"q" * 600):
        assert list(voc._encode_long(m)) == voc._encode_block([m], 1 << (len(m) - 1).bit_length())[0].tolist()
    monkeypatch.setattr(bpe, "_CACHE_BYTES", 10_000)
    full = bpe.Vocabulary(public_tokenizers.path(bpe.VOCABULARY))
    for k in range(20):
        full.learn({"x" * 1000 + str(k)})
        assert full.size <= 8000


def test_encoding_query(spark, folder, empty_folder, rows):
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(public_tokenizers.path(bpe.VOCABULARY)).ranks, special_tokens={})
    ids = [(i, np.array(want.encode_ordinary(t or ""), "<u4")) for i, t, *_ in rows]
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.op1_bpe(spark, folder).collect()) == Counter((i, len(x), hashlib.sha256(x.tobytes()).hexdigest()) for i, x in ids)
    got = {r.doc_id: r for r in bpe.op1_bpe(spark, folder).collect()}
    assert got[2].n_tokens == 0 and got[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[0].decoded_sha256 == hashlib.sha256(EN.encode()).hexdigest()
    assert bpe.op1_bpe(spark, empty_folder).count() == 0


# 2: language model


def brute_counts(rows):
    c = Counter()
    for i, t, *_ in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            c.update((t or "").encode().lower().split())
            c[None] += 1
    return c


def test_base_scores_are_exact(spark, folder, rows):
    c = brute_counts(rows)
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, *_ in rows:
        toks = [*(t or "").encode().lower().split(), None]
        score = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in toks)
        want[i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, len(toks), sum(c[x] > 0 for x in toks), n, round(score, 4)] += 1
    got = ngram_lm.op2_lm(spark, folder).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score <= 0 for r in got)


def test_base_scores_do_not_depend_on_what_is_broadcast(spark, docs):
    counts = ngram_lm.word_counts(docs)
    one, two = (
        {r.doc_id: r.base_score for r in ngram_lm.base_scores(docs, counts, F.lit(1000), F.lit(100), F.lit(5), frequent=k).collect()} for k in (0, 10_000)
    )
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)


def test_filters_hold_every_count_and_few_others(spark):
    h = np.random.default_rng(0).integers(0, 1 << 63, 20_000).astype(np.uint64)
    level = np.arange(20_000) % 12 + 1
    bits = np.zeros(1 << 17, np.uint8)  # 8 bits an entry
    ngram_lm._enter(bits, h, level)
    found = ngram_lm._probe(bits, h, 1 << 20)
    assert (found >= level).all() and (found == level).mean() > 0.95
    assert (ngram_lm._probe(bits, h + np.uint64(1), 1 << 20) > 0).mean() < 0.05


def brute_score(rows, texts, n, v):
    """Scores from quantised counts, without filters."""
    c = Counter()
    for text in rows:
        toks = ["<s>", *(text or "").translate(LOW).split(), "</s>"]
        c.update(toks)
        c.update(itertools.pairwise(toks))
    step = lambda n: float(ngram_lm._count(ngram_lm._level(np.array([n])))[0]) if n else 0.0
    for text in texts:
        toks, want = ["<s>", *(text or "").translate(LOW).split(), "</s>"], 0.0
        for a, b in itertools.pairwise(toks):
            cv, cw = step(c[a]), step(c[b])
            want += math.log10((min(step(c[a, b]), cv, cw) + ngram_lm.MU * min(1, (cw + 1) / (n + v + 1))) / (cv + ngram_lm.MU))
        yield want


def test_levels_stand_for_counts_like_theirs():
    n = np.arange(1, 5000)
    assert (ngram_lm._count(ngram_lm._level(n))[:3] == [1, 2, 3]).all()
    assert (np.abs(ngram_lm._count(ngram_lm._level(n)) / n - 1) < 0.34).all()


@pytest.mark.parametrize("filter_bits", [1 << 26, 1 << 13])
def test_scores_are_those_of_the_counts_whatever_is_broadcast(spark, docs, rows, filter_bits):
    model = ngram_lm.fit(docs, 10_000, 500, filter_bits=filter_bits)
    own = docs.withColumn("score", F.lit("taken")).withColumn("_row", F.lit("mine")).withColumn("pack", F.lit(1))
    got = ngram_lm.model_scores(own, model).collect()
    assert set(got[0].asDict()) == set(own.columns) and {r._row for r in got} == {"mine"}
    assert len(got) == len(rows) and (filter_bits > 1 << 20 or model.least > ngram_lm.LEAST_LEVEL)
    by = {r.text: r.score for r in got}
    # A chance hit in a filter lifts a count by a level, so scores are near the exact ones, not equal.
    for text, score in zip(by, brute_score([r[1] for r in rows], list(by), 10_000, 500), strict=True):
        assert by[text] == pytest.approx(score, rel=0.02 if filter_bits > 1 << 20 else 0.2), text


def test_ngrams_are_hashed_to_their_places_and_probed_once(spark, docs, rows):
    """What the broadcast filter holds of a pack comes with the answers, so that scoring neither sorts hashes nor probes again."""
    assert common._lowered(np.arange(256, dtype=np.uint8)).tobytes() == bytes(range(256)).lower()
    texts = pa.array([*(r[1] for r in rows), None, "", "one", "one one"], pa.string())
    _, _, buf, offsets = next(common.chunks(texts, 1 << 60))
    before, tokens, previous = ngram_lm._token_hashes(buf, offsets)
    every, (cuts, n, at) = ngram_lm._different(texts), ngram_lm._grams(texts)
    assert n == len(every) == len(set(every.tolist())) and (np.sort(every) == every).all()
    assert (cuts == before + np.arange(len(texts) + 1)).all()
    assert (every[at] == [ngram_lm._unigram(tokens), ngram_lm._unigram(previous), ngram_lm._bigram(previous, tokens)]).all()
    for level in (np.arange(19) % 4 * 53, np.zeros(9, np.int64), np.zeros(0, np.int64)):
        assert (ngram_lm._unmarked(np.frombuffer(ngram_lm._marks(level), np.uint8), len(level)) == level).all()
    model, packs = ngram_lm.fit(docs, 10_000, 500), ngram_lm.packed(docs, size=1 << 10)
    came = {r.pack: r.levels for r in ngram_lm.answers(packs, model, spark.sparkContext.broadcast(model_of(model))).where("segment < 0").collect()}
    asked = packs.select("pack", F.col("rows")["text"].alias("t")).collect()
    assert len(asked) == len(came) > 1
    for r in asked:
        h = ngram_lm._different(pa.array(r.t, pa.string()))
        level = model_of(model).frequent(h)
        assert (ngram_lm._unmarked(np.frombuffer(came[r.pack], np.uint8), len(h)) == level).all()
        assert (model.frequent(h) == level).all() and (model.frequent(h) == level).all()  # found before or not


def test_levels_found_before_are_those_of_the_filter():
    """Every two hashes share a slot; the filter's own answers count, also the second time."""
    h = np.random.default_rng(1).integers(0, 1 << 64, 20_000, np.uint64)
    h = np.sort(np.concatenate([h, h ^ np.uint64(2)]))
    level, bits = np.arange(40_000) % 14 + 1, np.zeros(1 << 20, np.uint8)
    part = len(bits) // ngram_lm._PARTS
    for k in range(ngram_lm._PARTS):
        own = h >> np.uint64(58) == k
        ngram_lm._enter(bits[k * part : (k + 1) * part], h[own], level[own], 4)
    model = ngram_lm.Model(1, 1, 256, bits, 6, None)
    once = model.frequent(h)
    assert (once[level >= 6] >= level[level >= 6]).all() and (once >= 6).mean() == pytest.approx((level >= 6).mean(), abs=0.02)
    assert model.known is not None and (model.frequent(h) == once).all() and (model.frequent(h[::7]) == once[::7]).all()


def model_of(m):
    return ngram_lm.Model(m.tokens, m.vocabulary, m.segments, m.bits, m.least, None)


def test_known_text_scores_above_shuffled_words(spark, docs):
    model = ngram_lm.fit(docs, 10_000, 500)
    pair = spark.createDataFrame([(0, EN), (1, " ".join(sorted(EN.split())))], "k int, text string")
    a, b = (r.score for r in sorted(ngram_lm.model_scores(pair, model).collect(), key=lambda r: r.k))
    assert a > b


def test_language_model_of_nothing(spark, empty_folder):
    assert ngram_lm.op2_lm(spark, empty_folder).count() == 0


# 3: language ID


def brute_sum(voc, prob, word):
    """Sum over all segmentations, by its first piece."""
    known = {name: prob[i] for i, name in enumerate(voc.names)}
    after = [np.zeros(prob.shape[1]) for _ in range(len(word))] + [np.ones(prob.shape[1])]
    for i in range(len(word) - 1, -1, -1):
        after[i] = sum(known[word[i:j]] * after[j] for j in range(i + 1, len(word) + 1) if word[i:j] in known)
    return after[0]


@pytest.fixture(scope="module")
def voc():
    return langid.pieces(public_tokenizers.path(langid.VOCABULARY))


def test_forward_sums_all_segmentations(voc):
    prob = np.random.default_rng(1).random((voc.number, 2)) * 0.01
    known = {name: prob[i] for i, name in enumerate(voc.names)}
    word, total = "forêt".encode(), np.zeros(2)
    for n in range(len(word)):
        for cuts in itertools.combinations(range(1, len(word)), n):
            marks = [0, *cuts, len(word)]
            own = [word[a:b] for a, b in itertools.pairwise(marks)]
            if all(x in known for x in own):
                total += np.prod([known[x] for x in own], axis=0)
    words = [word, b"", b"a", b"x" * 200, max(voc.names, key=len), "日本語の文には空白がない".encode() * 5, b"internationalization" * 4]
    got = langid.forward(voc, prob, common.pa.array(words, common.pa.large_binary()))
    assert np.exp(got[0]) == pytest.approx(total)
    for k, w in enumerate(words):
        assert got[k] == pytest.approx(np.log(brute_sum(voc, prob, w))), w
    long = b"abcdefghij" * 3000
    ten, many = langid.forward(voc, prob, common.pa.array([long[:30000], long[:15000]], common.pa.large_binary()))
    assert np.isfinite(ten).all() and ten == pytest.approx(2 * many, rel=0.01)


def test_expected_counts_are_those_of_all_segmentations(voc):
    prob = np.random.default_rng(2).random(voc.number) * 0.01
    words, count = [b"the", b"there", "été".encode(), b"q" * 40], np.array([3, 1, 2, 5])
    want = np.zeros(voc.number)
    for w, n in zip(words, count, strict=True):
        whole = brute_sum(voc, prob[:, None], w)[0]
        for i, j in itertools.combinations(range(len(w) + 1), 2):
            if w[i:j] in set(voc.names[k] for k in (np.searchsorted(np.array(voc.names, object), w[i:j]),) if k < voc.number):
                k = voc.names.index(w[i:j])
                parts = [brute_sum(voc, prob[:, None], x)[0] if x else 1.0 for x in (w[:i], w[j:])]
                want[k] += n * parts[0] * prob[k] * parts[1] / whole
    assert langid.expected(voc, prob, common.pa.array(words, common.pa.large_binary()), count) == pytest.approx(want)


def test_learning_is_that_of_one_process(spark, voc):
    counts = [("en", b"the", 5), ("en", b"there", 2), ("fr", b"le", 4), ("fr", "forêt".encode(), 1)]
    langs, got = langid.learn(spark.createDataFrame(counts, "lang string, word binary, count long").repartition(3), rounds=2)
    assert langs == ["en", "fr"]
    for k, lang in enumerate(langs):
        own = [(w, n) for x, w, n in counts if x == lang]
        p = np.exp(-1.0 * voc.length)
        p /= p.sum()
        for _ in range(2):
            p = langid.expected(voc, p, common.pa.array([w for w, _ in own], common.pa.large_binary()), np.array([n for _, n in own])) + 0.01
            p = np.maximum(p / p.sum(), langid._FLOOR)
        assert got[:, k] == pytest.approx(p)


def test_sample_is_bounded_by_different_texts(spark):
    rows = [("same text here", "en", None)] * 500 + [(f"texte numero {i} {'abc'[i % 3]}", "fr", None) for i in range(30)] + [("ein wort", "de", 1)]
    df = spark.createDataFrame(rows, "text string, lang string, doc_id long")
    assert langid.fit(df, sample=5)[0] == ["de", "en", "fr"]


def test_languages_of_held_out_texts(spark, folder, empty_folder):
    got = [r for r in langid.op3_langid(spark, folder).collect()]
    assert len(got) == 73
    by = {r.doc_id: r for r in got}
    assert by[0].lang_pred == "en" and by[5].lang_pred == "fr"
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (2, 3, 4, 6))
    assert all(0 <= r.score <= 1 for r in got) and by[9].lang_pred in ("en", "fr")
    assert langid.op3_langid(spark, empty_folder).count() == 0


# 4: secrets

BASE = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile("[0-9a-f]+"), 0, 32),
}


def brute_base(text):
    found = []
    for k, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        found += [(m.start(), k, m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def test_secrets_are_those_of_the_rules(spark):
    texts = [None, "", "token: secret: longvalue123", "TOKEN = \"abcdefgh\" é😀 password=12345678", "AKIA1234 AKIA1234567890AB", "x" * 9 + "0123456789abcdef" * 3, "apikey='a' api_key:=b secret=ABCDEFGHI", "ſecret=abcdefghij toKen=abcdefghij"]
    got = secrets.scan(spark.createDataFrame([(i, t, "taken") for i, t in enumerate(texts)], "doc_id long, text string, _key string")).collect()
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in BASE] == brute_base(r.text or ""), r.text
        assert r._key == "taken"


def test_further_rules_and_redaction(spark):
    text = "a ghp_" + "A1" * 18 + " b -----BEGIN RSA PRIVATE KEY----- c"
    one = spark.createDataFrame([(text,), (None,)], "text string")
    got = secrets.redact(secrets.scan(one)).collect()
    by = {r.text for r in got}
    assert by == {"a [SECRET] b [SECRET] c", None}


def test_trigram_queries_hold_for_their_matches():
    assert secrets.trigram_query("[0-9a-f]{32,}") == []
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [[["aki", "kia"]]]
    assert secrets.trigram_query("abcd|xyz") == [[["abc", "bcd"], ["xyz"]]]


def test_secrets_of_nothing(spark, empty_folder, folder):
    assert secrets.op4_secrets(spark, empty_folder).count() == 0
    assert secrets.op4_secrets(spark, folder).count() == 73


# 5: licences


def test_phrases_are_found_at_their_words(spark):
    texts = [None, "", "--", "CC-BY cc by, cc", "The GNU General Public License and Apache  License; MIT\nlicense", "license mit", "x " * 50 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string")
    got = licenses.scan(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[r.doc_id] or "").translate(LOW))
        want = sorted((k, label) for phrase, label in licenses.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        assert (r.n_words, [(p.start, p.label) for p in r.places if p.is_phrase]) == (len(words), want)
        if r.doc_id == 6:
            assert [(p.start, p.label) for p in r.places if not p.is_phrase] == [(50, "mit")]


def brute_places(text, idf, rare):
    """Templates by comparing words, without an index."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOW))
    entries = licenses.catalogue()
    place = {w: i for i, w in enumerate(sorted(idf, key=lambda w: (-idf[w], w)))}
    chosen = {e[0]: sorted(range(len(e[3])), key=lambda p: (place[e[3][p]], p))[: 1 if e[2] else max(2, len(e[3]) * 3 // 5)] for e in entries}
    listed = {e[3][p] for e in entries for p in chosen[e[0]]}
    own = sorted(place[w] for w in set(words) & listed)
    cut = own[rare - 1] if len(own) > rare else len(idf)
    out = []
    for i, label, is_phrase, tw, keys, share in entries:
        looked = [p for p in chosen[i] if is_phrase or place[tw[p]] <= cut]
        for start in range(1 - len(tw), len(words)):
            votes = sum(0 <= start + p < len(words) and words[start + p] == tw[p] for p in looked)
            there = " " + " ".join(words[max(0, start) : max(0, start + len(tw))]) + " "
            if votes and votes >= math.ceil(share * len(looked)) and all(" " + " ".join(k) + " " in there for k in keys):
                out.append((start, label, is_phrase, round(votes / len(looked), 9)))
    return sorted(out)


@pytest.mark.parametrize("rare", [licenses.RARE, 6])
def test_notices_are_those_of_a_scan_without_index(spark, rare):
    all_ = [t.text for t in licenses.TEMPLATES]
    texts = [*all_, " filler words ".join(all_), "of the and " * 300 + all_[0] + " or any " * 7000 + all_[2], all_[1].replace("compliance", "zzz"), " ".join(all_[5].split()[3:]), LONG, "cc by " * 40]
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, _x string")
    idf = licenses.rarity(df.select(licenses.words_of(F.col("text")).alias("w")), sorted({w for e in licenses.catalogue() for w in e[3]}))
    for r in licenses.scan(df, rare=rare).collect():
        assert sorted((p.start, p.label, p.is_phrase, round(p.score, 9)) for p in r.places) == brute_places(texts[r.doc_id], idf, rare), r.doc_id


def test_licences_of_nothing(spark, empty_folder, folder):
    assert licenses.op5_licenses(spark, empty_folder).count() == 0
    assert licenses.op5_licenses(spark, folder).count() == 73


# 6: URLs


def brute_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
    fits = [(len(h + p), v, h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, urls.DEFAULT, None))
    return host, path, best[2], best[1]


def test_longest_rule_wins(spark):
    seen = [None, "", "no scheme", "http://A.example.NET/en/1?x", "http://example.net/en", "https://x.net", "https://x.net/", "http://a.org/fr/#y", "http://org/fr/", "ftp://example.com/de/a/b", "http://badexample.com/de/", "http://x.net/" + "a/" * 300, "http://a.b.c.example.com/de/?"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(seen * 2)], "page_id long, url string, rule string")
    got = urls.judge(df, urls.rule_table(spark)).collect()
    assert len(got) == 2 * len(seen)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute_rule(r.url)
    assert urls.judge(df.limit(0), urls.rule_table(spark)).count() == 0


def test_filter_lets_all_listed_keys_pass_whatever_its_size(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.net/p/") for i in range(200)], "page_id long, url string")
    rules = spark.createDataFrame([("block", f"h{i}.net", "/p/") for i in range(0, 200, 2)], "verdict string, host string, path string")
    for blocks, most in ((1, 1), (7, 1024), (1024, 512), (None, 0)):
        assert urls.judge(df, rules, blocks=blocks, most=most).where("verdict = 'block'").count() == 100
    assert urls.blocks_for(10) == urls.LEAST_BLOCKS and urls.blocks_for(2_000_000) == 1 << 19


def test_rules_may_end_within_a_part_of_a_path(spark):
    df = spark.createDataFrame([(i, f"http://a.net{p}") for i, p in enumerate(["/private", "/privates/x", "/priv", "/public/prix", "", "/"])], "page_id long, url string")
    rules = spark.createDataFrame([("block", "net", "/priv"), ("allow", "a.net", "/private"), ("block", "net", "/public/pri"), (None, "net", "")], "verdict string, host string, path string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, rules).collect()}
    assert got == {0: ("a.net/private", "allow"), 1: ("a.net/private", "allow"), 2: ("net/priv", "block"), 3: ("net/public/pri", "block"), 4: (None, "allow"), 5: (None, "allow")}


# 7: decontamination


def test_seeds_find_items_of_every_length_with_every_allowed_substitution():
    for n in range(1, decontaminate.WINDOW + 1):
        if n < decontaminate.SPAN:
            masks = [[range(a, a + k)] for a, k in decontaminate.short_seeds(n)]
        else:
            masks = [[[s + o for o in m] for s in range(n - m[-1])] for m in decontaminate.MASKS]
        for r in range(n - math.ceil(n * decontaminate.SIMILARITY - 1e-9) + 1):
            for wrong in itertools.combinations(range(n), r):
                assert any(not set(seed) & set(wrong) for m in masks for seed in m), (n, wrong)


def test_items_with_substitutions_are_those_of_the_sql(spark):
    noise = " ".join(f"n{i}" for i in range(30))
    bench, docs = [], []
    for n in range(1, 14):
        item = [f"i{n}x{i}" for i in range(n)]
        bench.append((n, " ".join(item)))
        for i, j in itertools.combinations_with_replacement(range(n), 2):
            text = " ".join("zz" if k in (i, j) else w for k, w in enumerate(item))
            docs += [(f"{n} {i} {j}", text), (f"{n} {i} {j} within", f"{noise} {text} {noise}")]
        docs += [(f"{n} cut", " ".join(item[1:])), (f"{n} cut end", " ".join(item[:-1]) + " " + noise), (f"{n} cut start", " ".join([*item[1:], noise])), (f"{n} end", f"{noise} {' '.join(item[:-1])}")]
    docs, bench = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(bench, "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("benchmark", bench.toArrow())
    want = set(con.sql(decontaminate.op7_sql()).select(*[f'"{c}"' for c in ("doc_id", "item_id", "matched", "at")]).fetchall())
    assert {tuple(r) for r in decontaminate.overlaps(docs, bench).select("doc_id", "item_id", "matched", "at").collect()} == want
    assert {"5 0 0", "7 4 4 within", "8 0 0", "8 7 7 within", "10 1 7", "11 1 9", "8 cut", "9 end"} <= {r[0] for r in want} and "4 1 1" not in {r[0] for r in want}


def test_passages_with_substitutions_are_found(spark):
    item = " ".join(f"w{i}" for i in range(40))
    noise = " ".join(f"n{i}" for i in range(200))
    w = item.split()
    swapped = [x if i not in (22, 27) else "zz" for i, x in enumerate(w)]
    texts = {0: noise, 1: f"{noise} {item} {noise}", 2: f"{noise} {' '.join(swapped[18:31])}, {noise}", 3: " ".join(w[:12]), 9: " ".join(w[:10]), 4: None, 5: "", 6: " ".join(x if i % 4 else "q" for i, x in enumerate(w)), 7: item.upper().replace(" ", " - "), 8: " ".join(w[20:33])}
    docs = spark.createDataFrame([*texts.items(), (1, texts[1])], "doc_id long, text string")
    bench = spark.createDataFrame([(0, item), (1, item), (2, None), (3, "short item"), (4, " ".join(f"s{i}" for i in range(9)))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(docs, bench).collect()}
    assert set(got) == {(d, i) for d in (1, 2, 3, 7, 8) for i in (0, 1)}  # nobody has the short items
    assert got[1, 0].matched == 13 and got[1, 0].at == 200 and got[2, 0].matched == 11
    assert decontaminate.overlaps(docs.limit(0), bench).count() == 0 and decontaminate.overlaps(docs, bench.limit(0)).count() == 0


def test_short_items_must_stand_whole(spark):
    item = " ".join(f"s{i}" for i in range(9))
    docs = spark.createDataFrame([(0, f"a b {item} c d"), (1, item), (2, " ".join(item.split()[:6]))], "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.overlaps(docs, spark.createDataFrame([(4, item)], "item_id long, text string")).collect()} == {0, 1}


# 8: near-duplicates


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("tile", [4096, 3])
def test_classes_are_those_of_all_pairs(spark, tile):
    rng = np.random.default_rng(5)
    prints = [0, 0, 1, 3, 0xFF] + [int(x) for x in rng.integers(0, 1 << 63, 40)]
    prints += [p ^ sum(1 << int(b) for b in rng.choice(64, int(k), replace=False)) for p, k in zip(prints[5:], rng.integers(0, 7, 40), strict=True)]
    prints += [(1 << 20) - 1 ^ 1 << i for i in range(20)]
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in sorted(set(prints))], "fingerprint long")
    root = {r.node % (1 << 64): r.root for r in components(simhash.edges(df, tile=tile)).collect()}
    names = sorted(set(prints))
    want = {p: p for p in names}

    def find(x):
        while want[x] != x:
            x = want[x]
        return x

    for a, b in itertools.combinations(names, 2):
        if (a ^ b).bit_count() <= 4:
            want[max(find(a), find(b))] = min(find(a), find(b))
    for a, b in itertools.combinations(names, 2):
        assert (find(a) == find(b)) == (root.get(a, a) == root.get(b, b))


def test_fingerprints_and_classes(spark, docs, rows, folder, empty_folder):
    got = simhash.classes(docs).collect()
    assert len(got) == len(rows)
    want = {(i, brute_print(t)) for i, t, *_ in rows}
    assert {(r.doc_id, r.fingerprint % (1 << 64)) for r in got} == want
    of = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert of[1] == 0 and of[2] == of[3] == of[4] == 2 and of[7] == 7
    assert simhash.op8_simhash(spark, folder).count() == len(rows) and simhash.op8_simhash(spark, empty_folder).count() == 0


# 9: fingerprints


def brute_shingles(text):
    w = re.sub("[\t\n\x0b\x0c\r]", " ", text.lower()).split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def in_order(rows):
    """Rows (key, text) by descending key, null last, then by hash."""
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    return sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), signed(x[1])))


def test_fingerprints_of_edited_texts(spark, folder, empty_folder, rows):
    got = minhash.op9_minhash(spark, folder).collect()
    assert len(got) == len(rows) and minhash.op9_minhash(spark, empty_folder).count() == 0
    order = in_order([(i, t or "") for i, t, *_ in rows])
    of = {r.doc_id: r for r in got if r.doc_id is not None}
    prints = {hashlib.sha256(t.encode()).hexdigest(): r.fingerprint for i, t in order for r in got if r.doc_id == i and len(t) == r.n_chars}
    want = Counter()
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        h = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - h] + n[:h]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert of[0].fingerprint == of[1].fingerprint and len(of[0].fingerprint) == 2 * minhash.BINS and of[3].fingerprint == of[4].fingerprint == ""
    assert len(prints) > 60 and all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    own = Counter((r.doc_id, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9)) for r in got)
    assert own == Counter((r.doc_id, r.fingerprint, r.edited_fingerprint, round(brute_likeness(r.fingerprint, r.edited_fingerprint), 9)) for r in got)


def brute_fingerprint(text):
    """One permutation, optimal densification, low bytes; the hash is Spark's own and comes in as a table."""
    shingles, mins = text, [None] * minhash.BINS
    for h in shingles:
        b, v = h % minhash.BINS, h % (1 << 64) >> 6
        mins[b] = v if mins[b] is None else min(mins[b], v)
    full = [next(mins[j] for j in [b, *minhash._probes(minhash.BINS)[b]] if mins[j] is not None) for b in range(minhash.BINS)]
    return "".join(f"{x & 255:02x}" for x in full)


def brute_likeness(a, b):
    if not a or not b:
        return float(a == b)
    same = sum(a[i : i + 2] == b[i : i + 2] for i in range(0, len(a), 2)) / minhash.BINS
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def test_fingerprints_are_those_of_single_bins(spark):
    texts = ["one two three", "a b c d e f g", EN, EN + " and more of it " * 9]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, text string")
    got = {r.k: r.fingerprint for r in minhash.fingerprints(df, ["k"]).collect()}
    for i, t in enumerate(texts):
        w = t.lower().split()
        rows = [(min(len(w), 5), *(w[k : k + 5] + [None] * 5)[:5]) for k in range(max(1, len(w) - 4))]
        h = spark.createDataFrame(rows, "n int, a string, b string, c string, d string, e string").select(F.xxhash64("n", "a", "b", "c", "d", "e").alias("h")).collect()
        assert got[i] == brute_fingerprint([r.h for r in h])


def test_runs_meet_across_their_borders(spark):
    rows = [(i, f"t{i}") for i in range(50)] + [(7, f"x{i}") for i in range(40)] + [(None, f"y{i}") for i in range(60)] + [(3, "same")] * 30 + [(None, "same")] * 40
    df = spark.createDataFrame(rows, "k long, t string").withColumn("h", F.xxhash64("t"))
    for cuts in (1000, 5, 1):
        ordered = minhash.runs(df, "k", "h", run=6, cuts=cuts)
        sizes = [r["count"] for r in ordered.groupBy("_run").count().collect()]
        assert sum(sizes) == len(rows) and max(sizes) <= {1000: 24, 5: 60, 1: 220}[cuts]
        got = minhash.following(ordered, "t", [F.col("k").desc_nulls_last(), F.col("h")], F.struct("k", F.bitwise_not("h")), "next_t").collect()
        assert Counter((r.k, r.t) for r in got) == Counter(rows) and Counter(r.next_t for r in got) == Counter(t for _, t in rows)
        alone = [(k, t) for k, t in in_order(set(rows))]
        follow = {(k, t): alone[(i + 1) % len(alone)][1] for i, (k, t) in enumerate(alone)}
        for r in got:
            assert r.next_t in (follow[r.k, r.t], r.t) or (r.k, r.t) in ((3, "same"), (None, "same")) or follow[r.k, r.t] == "same" or r.next_t == "same"
    one = spark.createDataFrame([(1, "only")], "doc_id long, text string")
    assert [r.next_text for r in minhash.with_next(one, "doc_id", "text").collect()] == ["only"]


def test_likeness_is_close_to_jaccard(spark):
    rng = np.random.default_rng(2)
    base = [f"v{x}" for x in rng.integers(0, 10**9, 400)]
    texts = [" ".join(base[k:] + [f"u{x}" for x in rng.integers(0, 10**9, k)]) for k in (0, 20, 100, 200, 400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, text string")
    prints = {r.k: r.fingerprint for r in minhash.fingerprints(df, ["k"]).collect()}
    pairs = spark.createDataFrame([(i, prints[0], prints[i]) for i in range(5)], "k long, a string, b string")
    for r in pairs.select("k", minhash.likeness(F.col("a"), F.col("b")).alias("x")).collect():
        a, b = brute_shingles(texts[0]), brute_shingles(texts[r.k])
        assert abs(r.x - len(a & b) / len(a | b)) < 0.2


# 10: shards


def test_shards_match_the_mixture(spark, docs, rows, folder, empty_folder):
    got = sharding.op10_sharding(spark, folder).collect()
    assert len(got) == len(rows) and sharding.op10_sharding(spark, empty_folder).count() == 0
    n = Counter(r.shard for r in got)
    assert set(n) == set(range(40)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    for r in got:
        if r.doc_id == 2:
            assert (r.size, r.text_crc32) == (16, 0)


def test_every_shard_has_its_share_of_each_source(spark):
    df = spark.createDataFrame([(i, "big" if i % 3 else "small", None) for i in range(3000)], "doc_id long, source string, shard string")
    got = sharding.assign(df, ["doc_id"], shards=10)
    share = [r.n for r in got.groupBy("shard").agg(F.count_if(F.col("source") == "small").alias("n")).collect()]
    assert len(share) == 10 and all(abs(n - 100) <= 1 for n in share)
    other = {r.doc_id: r.shard for r in sharding.assign(df, ["doc_id"], shards=10, seed=8).collect()}
    assert other != {r.doc_id: r.shard for r in got.collect()}


def test_columns_of_any_name_stay(spark):
    names = ["_key", "_t", "_row", "_judged", "_hash", "_run", "_place", "__h", "__b", "__k0", "_x", "pack", "rows", "h"]
    rows = [(i, f"{EN if i % 2 else FR} more {i}", "en" if i % 2 else "fr", "a", 0, *names) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA + "".join(f", {n} string" for n in names))
    same = lambda out: [tuple(r[n] for n in names) for r in out.select(*names).distinct().collect()] == [tuple(names)]
    assert same(bpe.decode(bpe.encode(df))) and same(ngram_lm.model_scores(df, ngram_lm.fit(df, 300, 60))) and same(langid.predict(df, langid.fit(df)))
    assert same(secrets.scan(df)) and same(sharding.assign(df, ["doc_id"], shards=3)) and same(simhash.fingerprints(df))
    bench = spark.createDataFrame([(0, EN)], "item_id long, text string")
    assert licenses.scan(df).count() == simhash.classes(df).count() == minhash.with_next(df, "doc_id", "text").count() == 12
    assert {r.doc_id for r in decontaminate.overlaps(df, bench).collect()} == {1, 3, 5, 7, 9, 11}


# Long licence texts; ranks


@pytest.mark.parametrize("n", [65, 130, 1000])
def test_a_whole_licence_text_of_any_length_is_found(spark, n):
    words = [f"w{i * i % 47}" if i % 3 else f"term{i}" for i in range(n)]
    long_ = licenses.Template("long", " ".join(words), (" ".join(words[n // 2 : n // 2 + 4]),))
    broken = words[: n // 2] + ["zzz"] * 5 + words[n // 2 + 5 :]
    texts = [" ".join(words), "before it " + " ".join(words) + " and behind", " ".join(broken), " ".join(words[: n // 3]), "w1 w4 w9"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])] * 2, "doc_id long, text string")
    got = licenses.scan(df, templates=(*licenses.TEMPLATES, long_)).collect()
    assert sorted(r.doc_id for r in got) == [0, 0, 0, 1, 2, 3, 4]
    by = {r.doc_id: [(p.start, p.label, p.score) for p in r.places] for r in got}
    assert by[0] == [(0, "long", 1.0)] and by[1] == [(2, "long", 1.0)] and by[2] == by[3] == by[4] == []


def test_ranks_are_those_of_a_sort(spark, monkeypatch):
    rows = [(None if i % 7 == 0 else "big" if i % 3 else f"s{i}", i * 37 % 101, None if i % 5 else i) for i in range(600)] + [("big", 1, 1)] * 300
    df = spark.createDataFrame(rows, "source string, a long, b long").repartition(5)
    got = ranks.ranked(df, ["source"], ["a", "b"], "r", "n").collect()
    assert len(got) == 900
    for source in {r.source for r in got}:
        own = sorted((r.r, r.n, r.a, r.b) for r in got if r.source == source)
        assert [o[0] for o in own] == [*range(len(own))] and {o[1] for o in own} == {len(own)}
        assert [o[2:] for o in own] == sorted([(r[1], r[2]) for r in rows if r[0] == source], key=lambda x: (x[0], x[1] is not None, x[1] or 0))


def test_sharding_is_a_sort_by_fraction(spark):
    """Many sources of one row, one of a third of all rows that are equal, and none."""
    rows = [(i, f"site{i}") for i in range(400)] + [(1000, "same")] * 300 + [(2000 + i, "mid") for i in range(150)] + [(None, None)] * 50
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, source string"), ["doc_id"], shards=9).collect()
    assert sorted(r.rank for r in got) == [*range(900)]
    size, seen, order = Counter(r.source for r in got), Counter(), []
    names = spark.createDataFrame([(s,) for s in size], "source string")
    phase = {r.source: (r.h % sharding.PHASES + 0.5) / sharding.PHASES for r in names.select("source", F.xxhash64(F.lit(sharding.SEED), "source", F.col("source").isNull()).alias("h")).collect()}
    for r in sorted(got, key=lambda r: r.rank):
        order.append((seen[r.source] + phase[r.source]) / size[r.source])
        seen[r.source] += 1
        assert r.shard == r.rank * 9 // 900 and r.slot == r.rank - r.shard * 100
    assert order == sorted(order)
    for shard in range(9):
        own = Counter(r.source for r in got if r.shard == shard)
        assert all(abs(own[s] - size[s] / 9) <= 6 for s in ("same", "mid", None)) and 30 <= sum(n for s, n in own.items() if s and s.startswith("site")) <= 60
