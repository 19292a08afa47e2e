"""The queries of the training-data operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

import importlib

#: Query name -> module of this subpackage with a function of that name.
MODULES = {
    "op1_url_filters": "url_filters",
    "op2_sentencepiece": "sentencepieces",
    "op3_html_extraction": "html_regions",
    "op4_language_id": "language_mixture",
    "op5_license_scans": "license_digests",
    "op6_decontamination": "benchmark_wand",
    "op7_order_minhash": "order_minhash",
    "op8_quality_classifier": "quality_neighbours",
    "op9_secret_scans": "secret_scans",
    "op10_media_columns": "transport_streams",
    "op11_phrases": "suffix_phrases",
    "op12_clustering": "centroid_clusters",
    "op13_mixture": "source_mixture",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"fintally.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"fintally.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
