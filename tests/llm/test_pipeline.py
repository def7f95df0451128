"""The pipeline's stages against brute force, each on its own input, on a small corpus."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import xxhash

from shelfline.llm import bpe, langid, secrets

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

EN = "the quick brown fox jumps over the lazy dog and runs into the green forest near the river bank today"
FR = "le renard brun saute par dessus le chien paresseux et court dans la forêt verte près de la rivière"
ITEM = " ".join(f"bench{i}" for i in range(20))


def letters(text):
    return [w.encode() for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))]


def brute_language(rows):
    """EM in one process; then the likelihood of each word by its first piece."""
    voc = langid.pieces(public_tokenizers.path(langid.VOCABULARY))
    train = {(r.lang, r.text) for r in rows if r.lang and r.text is not None and zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 != 2}
    prob = {}
    for lang in sorted({x for x, _ in train}):
        n = Counter(w for x, t in train if x == lang for w in letters(t))
        p = np.exp(-1.0 * voc.length)
        p /= p.sum()
        for _ in range(langid.ROUNDS):
            p = langid.expected(voc, p, pa.array([*n], pa.large_binary()), np.array([*n.values()])) + 0.01
            p = np.maximum(p / p.sum(), langid._FLOOR)
        prob[lang] = dict(zip(voc.names, p.tolist(), strict=True))

    def log(word, own):
        after = [0.0] * len(word) + [1.0]
        for i in range(len(word) - 1, -1, -1):
            after[i] = sum(own[word[i:j]] * after[j] for j in range(i + 1, min(len(word), i + voc.longest) + 1) if word[i:j] in own)
        return math.log(after[0])

    for r in rows:
        if any(c.isalpha() for c in r.text or ""):
            total = {lang: sum(log(w, own) for w in letters(r.text)) for lang, own in prob.items()}
            best = max(total, key=lambda x: (total[x], [-ord(c) for c in x]))
            if 1 / sum(math.exp(t - total[best]) for t in total.values()) >= cp.LEAST_SCORE:
                yield r.doc_id, r.text, r.lang or best


def brute_first(rows):
    def print_(text):
        w = (text or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, signed(r.text))
    left, out = [(print_(r.text), r) for r in rows], []
    while left:
        group = [left.pop()]
        for p, _ in group:
            group += [x for x in left if (x[0] ^ p).bit_count() <= 4]
            left = [x for x in left if (x[0] ^ p).bit_count() > 4]
        out.append(min((r for _, r in group), key=key))
    return [(r.doc_id, r.text) for r in out]


def brute_clean(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
    for r in rows:
        own, bad = words(r.text), False
        for item in map(words, items):
            n = min(13, len(item))
            for at in range(len(item) - n + 1):
                for start in range(1 - n, len(own)):
                    same = sum(0 <= start + k < len(own) and own[start + k] == item[at + k] for k in range(n))
                    bad |= same >= math.ceil(0.8 * n - 1e-9)
        if not bad:
            yield r.doc_id, r.text


def brute_masked(text):
    spans = sorted((m.start(), m.end()) for rule in secrets.RULES for m in re.finditer(rule.pattern, text, re.A) if len(m[rule.group]) >= rule.least)
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_stages(spark, tmp_path):
    rows = [(i, f"{EN if i % 2 else FR} alpha{i} beta{i} gamma{i} delta{i} epsilon{i} zeta{i} eta{i} theta{i} iota{i} kappa{i}", "en" if i % 2 else "fr", "s", 0) for i in range(40)]
    rows += [(100, None, "en", "s", 0), (101, "123 456", "en", "s", 0), (102, rows[3][1], None, "s", 0), (None, rows[4][1], "fr", "s", 0), (103, f"{EN} {ITEM} and so on", "en", "s", 0)]
    rows += [(104, "my password=abcd1234efgh is not for you or anybody else in the green forest", "en", "s", 0), (None, "a text without any key that is unlike all of the other texts in here", "en", "s", 0)]
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = ["_key", "_first", "_spans", "_pred", "score", "lang_pred", "_rules"]
    spark.createDataFrame([(*r, *extra) for r in rows], schema + "".join(f", {n} string" for n in extra)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, folder)
        if k < len(cp.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *extra]
        docs.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        seen.append(docs.collect())
    given = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert Counter((r.doc_id, r.text, r.lang) for r in seen[0]) == Counter(brute_language(given))
    assert Counter((r.doc_id, r.text) for r in seen[1]) == Counter(brute_first(seen[0]))
    assert Counter((r.doc_id, r.text) for r in seen[2]) == Counter(brute_clean(seen[1], [ITEM]))
    assert Counter((r.doc_id, r.text) for r in seen[3]) == Counter((r.doc_id, brute_masked(r.text)) for r in seen[2])
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(public_tokenizers.path(bpe.VOCABULARY)).ranks, special_tokens={})
    ids = [(r, np.array(library.encode_ordinary(r.text), "<u4").tobytes()) for r in seen[3]]
    want = Counter((r.doc_id, r.lang, r.source, x, len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r, x in ids)
    assert Counter((r.doc_id, r.lang, r.source, bytes(r.token_ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in seen[4]) == want
    ids = [sorted((r.doc_id for r in rows_ if r.doc_id is not None)) for rows_ in seen]
    clean = [*range(40)]
    assert all(r[n] == n for rows_ in seen[:-1] for r in rows_ for n in extra)
    assert ids[0] == [*clean, 102, 103, 104]
    assert ids[1] == [*clean, 103, 104] and sum(r.doc_id is None for r in seen[1]) == 1
    assert ids[2] == [*clean, 104] == ids[3] == ids[4]
    masked = next(r for r in seen[3] if r.doc_id == 104)
    assert "abcd1234efgh" not in masked.text and masked.n_chars == len(masked.text)
    assert len(seen[4]) == 42 and len(cp.run(spark, folder).collect()) == 42


def test_pipeline_of_nothing(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert cp.run(spark, folder).count() == 0
