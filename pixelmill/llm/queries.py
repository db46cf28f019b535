"""The corpus queries: each operator over its whole table, with production parameters.

None is expressible in SQL at the size of whole tables, so each is tested against a
brute-force version, a public library or held-out accuracy in ``tests/llm``.
"""

from __future__ import annotations

from pixelmill.llm import bpe, decontaminate, embedding_dedup, pii, quality, simhash, substring_dedup, suffix_dedup, token_counts, url_filter


def queries():
    return {
        "op1_suffix_dedup": suffix_dedup.op1,
        "op2_decontaminate": decontaminate.op2,
        "op3_substring_dedup": substring_dedup.op3,
        "op4_url_filter": url_filter.op4,
        "op5_bpe": bpe.op5,
        "op6_token_counts": token_counts.op6,
        "op7_pii": pii.op7,
        "op8_quality": quality.op8,
        "op9_simhash": simhash.op9,
        "op10_embedding_dedup": embedding_dedup.op10,
    }


def oracle_sql():
    return {}
