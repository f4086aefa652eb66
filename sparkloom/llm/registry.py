"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bpe, chat, chunk_store, codes, hilbert, hilbert_search, merkle, positive_unlabelled, prefix_tree_join, revisit, string_kernel, style_tree, winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_style_tree": style_tree.op1_style_tree,
    "op2_positive_unlabelled": positive_unlabelled.op2_positive_unlabelled,
    "op3_chunk_store": chunk_store.op3_chunk_store,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_revisit": revisit.op5_revisit,
    "op6_hilbert_shards": hilbert.op6_hilbert_shards,
    "op7_winnowing": winnowing.op7_winnowing,
    "op8_string_kernel": string_kernel.op8_string_kernel,
    "op9_hilbert_search": hilbert_search.op9_hilbert_search,
    "op10_prefix_tree_join": prefix_tree_join.op10_prefix_tree_join,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_vector_codes": codes.op12_vector_codes,
    "op13_chat_format": chat.op13_chat_format,
}

ORACLE_SQL: dict[str, str] = {
    "op5_revisit": revisit.ORACLE_SQL,
    "op7_winnowing": winnowing.ORACLE_SQL,
    "op10_prefix_tree_join": prefix_tree_join.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op12_vector_codes": codes.ORACLE_SQL,
    "op13_chat_format": chat.ORACLE_SQL,
}
