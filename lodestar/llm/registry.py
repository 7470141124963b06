"""Queries of this subpackage: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from lodestar.llm import decontaminate, embed_dedup, html_extract, jaccard_join, language_id, merkle, mixing, quality_mil, secret_scan, substring_dedup, token_align, token_store, url_filter

QUERIES = {
    "op1_html_extraction": (html_extract.op1_html_extraction, None),
    "op10_decontamination": (decontaminate.op10_decontamination, decontaminate.OP10_SQL),
    "op2_secret_scan": (secret_scan.op2_secret_scan, None),
    "op3_jaccard_join": (jaccard_join.op3_jaccard_join, jaccard_join.OP3_SQL),
    "op5_embedding_dedup": (embed_dedup.op5_embedding_dedup, embed_dedup.OP5_SQL),
    "op6_url_filter": (url_filter.op6_url_filter, url_filter.OP6_SQL),
    "op7_quality_classifier": (quality_mil.op7_quality_classifier, None),
    "op9_language_id": (language_id.op9_language_id, None),
    "op4_mixing": (mixing.op4_mixing, None),
    "op11_token_output": (token_store.op11_token_output, None),
    "op12_tokenizer_alignment": (token_align.op12_tokenizer_alignment, None),
    "op13_merkle_manifest": (merkle.op13_merkle_manifest, merkle.OP13_SQL),
    "op8_substring_dedup": (substring_dedup.op8_substring_dedup, None),
}
