"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, langid, licenses, merkle, minhash, ngram_lm, secrets, sharding, simhash, topk, urls, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_ngram_lm": ngram_lm.op2_lm,
        "op3_langid": langid.op3_langid,
        "op4_secrets": secrets.op4_secrets,
        "op5_licenses": licenses.op5_licenses,
        "op6_urls": urls.op6_urls,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_simhash": simhash.op8_simhash,
        "op9_minhash": minhash.op9_minhash,
        "op10_sharding": sharding.op10_sharding,
        "op11_whitening": whitening.op11_whitening,
        "op12_merkle": merkle.op12_merkle,
        "op13_topk": topk.op13_topk,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_secrets": secrets.op4_sql(),
        "op6_urls": urls.op6_sql(),
        "op7_decontaminate": decontaminate.op7_sql(),
        "op12_merkle": merkle.op12_sql(),
        "op13_topk": topk.op13_sql(),
    }
