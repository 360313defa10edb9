"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerleaf.llm import (
    ann, bpe, chat, language_id, line_dedup, merkle, mixing, pii, shingle_join, spotsigs, token_files, trie, warc,
)

MODULES = (language_id, ann, shingle_join, warc, bpe, mixing, pii, line_dedup, spotsigs, token_files, chat, merkle, trie)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def llm_oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in getattr(module, "ORACLES", {}).items()}
