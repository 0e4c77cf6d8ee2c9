"""Query name -> builder, and query name -> DuckDB SQL where SQL can say it."""

from __future__ import annotations

import corpus_pipeline

from . import oracle, queries

LLM_QUERIES = {name: getattr(queries, name) for name in (
    "op1_token_counts",
    "op2_sharding",
    "op3_decontam",
    "op4_toxicity",
    "op5_simhash",
    "op6_quality_rules",
    "op7_pii",
    "op8_licences",
    "op9_mixing",
    "op10_secrets",
    "op11_alignment",
    "op12_hard_negatives",
    "op13_sentencepiece",
)} | {"pipeline": corpus_pipeline.run}

LLM_SQL: dict[str, str] = {
    "op3_decontam": oracle.decontam_sql(),
    "op8_licences": oracle.licences_sql(),
    "op9_mixing": oracle.mixing_sql(),
    "op10_secrets": oracle.secrets_sql(),
    "op12_hard_negatives": oracle.hard_negatives_sql(),
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
