"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, chat, decontamination, exact_dedup, html, jaccard_join, lm, merkle, packing, secrets, sharding, toxicity, whitening


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_shards": sharding.op1_shards,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_secret_scan": secrets.op3_secret_scan,
        "op4_lm_score": lm.op4_lm_score,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_ngram_jaccard": jaccard_join.op6_ngram_jaccard,
        "op7_bpe": bpe.op7_bpe,
        "op8_html": html.op8_html,
        "op9_decontamination": decontamination.op9_decontamination,
        "op10_chat": chat.op10_chat,
        "op11_whitening": whitening.op11_whitening,
        "op12_packing": packing.op12_packing,
        "op13_merkle": merkle.op13_merkle,
    }


def oracle_sql() -> dict:
    return {
        "op5_exact_dedup": exact_dedup.SQL,
        "op6_ngram_jaccard": jaccard_join.SQL,
        "op9_decontamination": decontamination.SQL,
        "op13_merkle": merkle.SQL,
    }
