"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import additive, chat, divergence, flatgraph, language, mixing, packing, pii, simhash, tokens, toxicity, urls, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        additive.op1_additive_quantisation, tokens.op2_token_counts, mixing.op3_source_mixing, toxicity.op4_toxicity, pii.op5_pii_spans,
        urls.op6_url_filters, packing.op7_harmonic_packing, chat.op8_perspective_rotation, simhash.op9_simhash_near_dedup, flatgraph.op10_flat_graph_dedup,
        divergence.op11_source_divergence, language.op12_language_id, whitening.op13_embedding_whitening,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filters": urls.SQL, "op8_perspective_rotation": chat.SQL, "op11_source_divergence": divergence.SQL}
