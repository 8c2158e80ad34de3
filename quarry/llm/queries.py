"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bottomk, chat_format, curriculum, html_blocks, media, mixlm, positional, quality, secret_scan, token_store

QUERIES = {
    "op1_html_extraction": html_blocks.query,
    "op2_source_mixing": curriculum.query,
    "op3_quality_classifier": quality.query,
    "op4_benchmark_decontamination": positional.query,
    "op5_token_orc": token_store.query,
    "op6_minhash_near_dedup": bottomk.query,
    "op7_secret_scan": secret_scan.query,
    "op8_media_columns": media.query,
    "op9_lm_scoring": mixlm.query,
    "op10_chat_formatting": chat_format.query,
}
ORACLE: dict[str, str] = {"op2_source_mixing": curriculum.SQL, "op10_chat_formatting": chat_format.SQL}
