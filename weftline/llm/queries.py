"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import (
    bpe_automaton, centroids, chat_quotes, maxent_lm, mixing, quality_rules, sharding, simhash, token_count, token_files, topk_search,
    suffix_dedup, vector_codes,
)
from weftline.llm.common import read_table


def _over(table: str, query: Callable[..., DataFrame], *more: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(*[read_table(spark, sf_dir, t) for t in (table, *more)])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": _over("documents", sharding.query),
    "op2_topk_search": _over("embeddings", topk_search.query),
    "op3_source_mixing": _over("documents", mixing.query),
    "op4_token_counts": _over("documents", token_count.query),
    "op5_chat_quotes": _over("conversations", chat_quotes.query),
    "op6_quality_rules": _over("documents", quality_rules.query, "labels"),
    "op7_token_files": _over("documents", token_files.query),
    "op8_bpe_automaton": _over("documents", bpe_automaton.query),
    "op9_simhash": _over("documents", simhash.query),
    "op10_maxent_lm": _over("documents", maxent_lm.query),
    "op11_vector_codes": _over("embeddings", vector_codes.query),
    "op12_suffix_dedup": _over("documents", suffix_dedup.query),
    "op13_centroid_clustering": _over("embeddings", centroids.query),
}

ORACLE_SQL: dict[str, str] = {
    "op2_topk_search": topk_search.ORACLE_SQL,
    "op11_vector_codes": vector_codes.ORACLE_SQL,
    "op12_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op13_centroid_clustering": centroids.ORACLE_SQL,
}
