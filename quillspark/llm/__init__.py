"""Operators of training-data pipelines and their registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "op01_lm_scoring", "op02_jaccard_join", "op03_url_filter", "op04_decontamination", "op05_quality_rules", "op06_pii", "op07_quality_classifier", "op08_packing", "op09_language_id", "op10_token_counts",
    "op11_centroid_clustering", "op12_merkle_manifest", "op13_simhash_dedup",
)


def queries() -> dict:
    """The query ``opN_<name>`` of every module, and ``pipeline``."""
    found = {}
    for name in MODULES:
        module = import_module(f"quillspark.llm.{name}")
        found |= {k: v for k, v in vars(module).items() if k.startswith(f"op{int(name[2:4])}_") and callable(v)}
    import corpus_pipeline

    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    found = {}
    for name in MODULES:
        found |= getattr(import_module(f"quillspark.llm.{name}"), "ORACLE_SQL", {})
    return found
