"""The queries of this subpackage and the SQL that says the same, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name and the module that holds its ``query`` function and, where SQL can say it, ``SQL``.
MODULES = {
    "op1_imatch_fingerprints": "op1_imatch",
    "op2_bpe_token_count": "op2_bpe_count",
    "op3_embedding_near_dedup": "op3_covertree",
    "op4_ngram_jaccard_join": "op4_jaccard",
    "op5_token_records": "op5_records",
    "op6_language_id": "op6_langid",
    "op7_source_mixing": "op7_mixing",
    "op8_rendezvous_shards": "op8_sharding",
    "op10_substring_dedup": "op10_substrings",
    "op9_bestfit_packing": "op9_packing",
    "op11_maxscore_search": "op11_maxscore",
    "op12_quality_rules": "op12_quality",
    "op13_periodic_runs": "op13_periodic",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    modules = {name: import_module(f"{__package__}.{module}") for name, module in MODULES.items()}
    return {name: m.SQL for name, m in modules.items() if getattr(m, "SQL", None)}
