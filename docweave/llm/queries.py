"""The queries of this subpackage, one for each operator."""

from __future__ import annotations

import importlib

#: Query name: module and function.
_QUERIES = {
    "op1_ann": ("ann", "op1_ann"),
    "op2_decontaminate": ("decontaminate", "op2_decontaminate"),
    "op3_pii": ("pii", "op3_pii"),
    "op4_substring_dedup": ("substring_dedup", "op4_substring_dedup"),
    "op5_sharding": ("sharding", "op5_sharding"),
    "op6_toxicity": ("toxicity", "op6_toxicity"),
    "op7_near_dup": ("near_dup", "op7_near_dup"),
    "op8_packing": ("packing", "op8_packing"),
    "op9_token_orc": ("orc_tokens", "op9_token_orc"),
    "op10_token_counts": ("token_counts", "op10_token_counts"),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), function) for name, (module, function) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from .sharding import OP5_SQL

    return {"op5_sharding": OP5_SQL}
