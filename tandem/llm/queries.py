"""The registered queries of this subpackage, one for each numbered operator, and SQL for those that SQL expresses."""

from __future__ import annotations

import importlib

#: Query, its module and, where SQL expresses it, the name of the SQL there.
TABLE = {
    "op5_winnowed_lines": ("linededup", "SQL"),
    "op9_preference_pairs": ("preference", "SQL"),
    "op6_redirect_rules": ("urlrules", "SQL"),
    "op10_jaccard_components": ("jaccard", "SQL"),
    "op7_weak_pii": ("pii", None),
    "op2_divergence_rules": ("divergence", "SQL"),
    "op4_toxicity_crf": ("toxicity", None),
    "op1_benchmark_leaks": ("decontaminate", "SQL"),
    "op3_source_mix": ("mixing", "SQL"),
    "op8_histogram_shards": ("sharding", None),
    "op11_sibling_manifest": ("manifest", "SQL"),
    "op12_importance_draw": ("importance", "SQL"),
    "op13_rank_array_bpe": ("bpe", None),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f".{module}", __package__), name) for name, (module, _) in TABLE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f".{module}", __package__), sql) for name, (module, sql) in TABLE.items() if sql}
