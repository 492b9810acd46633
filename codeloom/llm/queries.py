"""The queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op5_exact, op7_sharding, op10_rules
from .op1_quality import op1_quality_classifier
from .op2_bpe import op2_byte_bpe
from .op3_passages import op3_substring_dedup
from .op4_pii import op4_pii_surrogates
from .op5_exact import op5_exact_dedup
from .op6_packing import op6_best_fit_packing
from .op7_sharding import op7_lookup_sharding
from .op8_near import op8_minhash_near_dedup
from .op9_secrets import op9_secret_scan
from .op10_rules import op10_quality_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_lookup_sharding": op7_lookup_sharding,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_rules": op10_quality_rules,
}

#: DuckDB SQL by query; the others are tested against brute force, round trips or held-out accuracy in tests/llm.
SQL: dict[str, str] = {
    "op5_exact_dedup": op5_exact.SQL,
    "op7_lookup_sharding": op7_sharding.sql(),
    "op10_quality_rules": op10_rules.sql(),
}
