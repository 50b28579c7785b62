"""Registered queries."""

from corpusmill.plans import chunks, data, manifest, search, upkeep, wiki
from corpusmill.plans.registry import CORE as core

core.as_type(
    "INTEGER",
    {
        "sentence_split": "n_sentences longest", "near_empty_slides": "n_words", "table_confidence": "n_rows n_cols", "source_roots": "n_exclude",
        "bm25_topk": "rank", "vector_topk": "rank", "hybrid_rrf": "rank", "search_results": "rank", "wikilinks": "ord", "broken_links": "ord", "page_relations": "ord",
        "unresolved_relations": "ord", "resolved_relations": "ord", "frontmatter_roundtrip": "n_tags n_sources n_body",
    },
)
core.as_type("BIGINT", {"manifest_alive": "n_chunks"})

__all__ = ["chunks", "core", "data", "manifest", "search", "upkeep", "wiki"]
