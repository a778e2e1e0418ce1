"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from loanscope.llm import (
    decontamination, embeddings, jaccard, language, mixing, negatives, passages, prefixes, quality, secrets, sharding, suffixes, tokens)

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_language": language.op3_language,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_passages": passages.op5_passages,
    "op6_mixing": mixing.op6_mixing,
    "op7_embeddings": embeddings.op7_embeddings,
    "op8_secrets": secrets.op8_secrets,
    "op9_quality": quality.op9_quality,
    "op10_suffixes": suffixes.op10_suffixes,
    "op11_negatives": negatives.op11_negatives,
    "op12_tokens": tokens.op12_tokens,
    "op13_prefixes": prefixes.op13_prefixes,
}
SQL = {
    "op2_decontamination": decontamination.OP2_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op8_secrets": secrets.OP8_SQL,
    "op11_negatives": negatives.OP11_SQL,
    "op13_prefixes": prefixes.OP13_SQL,
}
