"""Queries and SQL of the training-data operators."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, huffman, mainhtml, maxent, mixing, quality, simhash, topk, toxicity, urlfilter

QUERIES = {
    "op1_token_output": huffman.query,
    "op2_maxent_score": maxent.query,
    "op3_html_text": mainhtml.query,
    "op4_url_filter": urlfilter.query,
    "op5_quality": quality.query,
    "op6_simhash_near_dedup": simhash.query,
    "op7_decontaminate": decontaminate.query,
    "op8_toxicity": toxicity.query,
    "op9_mix_sources": mixing.query,
    "op10_topk_codes": topk.query,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {"op4_url_filter": urlfilter.SQL, "op10_topk_codes": topk.SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
