"""The ``opN_<name>`` queries: each applies its operator to its whole table."""

from __future__ import annotations

from . import bpe, exact_dedup, lm_score, mixing, near_dedup, prefix_trie, quality_gam, quality_rules, secrets, spelling, substring_dedup, suffix_dedup, token_counts
from .common import documents, labels

QUERIES = {
    "op1_token_counts": lambda spark, sf: token_counts.op1(documents(spark, sf)),
    "op2_near_dedup": lambda spark, sf: near_dedup.op2(documents(spark, sf)),
    "op3_mixing": lambda spark, sf: mixing.op3(documents(spark, sf)),
    "op4_lm_score": lambda spark, sf: lm_score.op4(documents(spark, sf)),
    "op5_exact_dedup": lambda spark, sf: exact_dedup.op5(documents(spark, sf)),
    "op6_secrets": lambda spark, sf: secrets.op6(documents(spark, sf)),
    "op7_quality_gam": lambda spark, sf: quality_gam.op7(documents(spark, sf), labels(spark, sf)),
    "op8_substring_dedup": lambda spark, sf: substring_dedup.op8(documents(spark, sf)),
    "op9_quality_rules": lambda spark, sf: quality_rules.op9(documents(spark, sf), labels(spark, sf)),
    "op10_bpe": lambda spark, sf: bpe.op10(documents(spark, sf)),
    "op11_suffix_dedup": lambda spark, sf: suffix_dedup.op11(documents(spark, sf)),
    "op12_prefix_trie": lambda spark, sf: prefix_trie.op12(prefix_trie.conversations(spark, sf)),
    "op13_spelling": lambda spark, sf: spelling.op13(documents(spark, sf)),
}

ORACLES = {
    "op3_mixing": mixing.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_spelling": spelling.ORACLE,
}
