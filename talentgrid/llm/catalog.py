"""Registry of this subpackage's queries and their SQL."""

from __future__ import annotations

from . import (
    op01_quality,
    op02_substring,
    op03_toxicity,
    op04_packing,
    op05_simhash,
    op06_decontaminate,
    op07_chat,
    op08_tokenfile,
    op09_html,
    op10_sharding,
    op11_collocations,
    op12_url_filter,
    op13_hard_negatives,
)

QUERIES = {
    "op1_quality_rules": op01_quality.op1_quality_rules,
    "op2_substring_dedup": op02_substring.op2_substring_dedup,
    "op3_toxicity": op03_toxicity.op3_toxicity,
    "op4_best_fit_packing": op04_packing.op4_best_fit_packing,
    "op5_simhash_dedup": op05_simhash.op5_simhash_dedup,
    "op6_decontaminate": op06_decontaminate.op6_decontaminate,
    "op7_chat_format": op07_chat.op7_chat_format,
    "op8_token_files": op08_tokenfile.op8_token_files,
    "op9_html_extract": op09_html.op9_html_extract,
    "op10_sharding": op10_sharding.op10_sharding,
    "op11_collocations": op11_collocations.op11_collocations,
    "op12_url_filter": op12_url_filter.op12_url_filter,
    "op13_hard_negatives": op13_hard_negatives.op13_hard_negatives,
}

ORACLES = {
    "op1_quality_rules": op01_quality.oracle,
    "op2_substring_dedup": op02_substring.oracle,
    "op6_decontaminate": op06_decontaminate.oracle,
    "op7_chat_format": op07_chat.oracle,
    "op11_collocations": op11_collocations.oracle,
    "op12_url_filter": op12_url_filter.oracle,
    "op13_hard_negatives": op13_hard_negatives.oracle,
}


def queries() -> dict:
    """Name to callable, each over its whole intended table."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL, where SQL can express the operator."""
    return {k: f() for k, f in ORACLES.items()}
