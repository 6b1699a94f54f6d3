"""The subpackage's queries and, where SQL can express them, their oracles."""

from __future__ import annotations

import importlib

#: Query and the module that has it; a module's ORACLE, if any, is the query's SQL.
MODULES = {
    "op1_prefix_hash": "prefix_hash",
    "op2_license_scan": "license_scan",
    "op3_shard_ring": "shard_ring",
    "op4_url_filter": "url_filter",
    "op5_toxicity": "toxicity",
    "op6_source_mix": "source_mix",
    "op7_pii_surrogates": "pii",
    "op8_avi_mjpeg": "avi_mjpeg",
    "op9_sentencepiece": "piece_bpe",
    "op10_simhash": "simhash",
}


def llm_queries() -> dict:
    return {name: getattr(importlib.import_module(f"notegrain.llm.{m}"), name) for name, m in MODULES.items()}


def llm_oracles() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"notegrain.llm.{m}"), "ORACLE", None) for name, m in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
