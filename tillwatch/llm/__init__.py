"""Operators for training-data pipelines, and their registered queries."""

from __future__ import annotations

from importlib import import_module

#: Query name to module; each module has a function of the query's name, and OPn_SQL where SQL can say it.
MODULES = {
    "op1_topk_search": "cover_tree",
    "op2_mix_sources": "mix",
    "op3_language_id": "language",
    "op4_toxicity": "toxicity",
    "op5_quality": "quality",
    "op6_byte_bpe": "bpe",
    "op7_simhash": "simhash",
    "op8_secrets": "secrets",
    "op9_media": "media",
    "op10_substrings": "substrings",
    "op11_packing": "packing",
    "op12_infill": "infill",
    "op13_vector_codes": "codes",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__name__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__name__}.{module}"), name.split("_")[0].upper() + "_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
