"""The queries of this subpackage: name -> (function, SQL or None)."""

from __future__ import annotations

from pagestrata.llm import corpus_queries as corpus
from pagestrata.llm import corpus_sql
from pagestrata.llm import native_queries as native
from pagestrata.llm import native_sql as sql
from pagestrata.plans.catalogue import Query

QUERIES = {
    "op1_best_fit_packing": Query(corpus.op1_best_fit_packing, None),
    "op9_near_duplicates": Query(corpus.op9_near_duplicates, None),
    "op2_vector_search": Query(corpus.op2_vector_search, None),
    "op3_language_id": Query(corpus.op3_language_id, None),
    "op8_cross_entropy": Query(corpus.op8_cross_entropy, None),
    "op4_pii_surrogates": Query(native.op4_pii_surrogates, None),
    "op5_repeated_strings": Query(corpus.op5_repeated_strings, sql.OP5),
    "op6_secret_scan": Query(native.op6_secret_scan, sql.OP6),
    "op7_quality_rules": Query(native.op7_quality_rules, sql.OP7),
    "op10_source_mix": Query(native.op10_source_mix, sql.OP10),
    "op12_vector_codes": Query(corpus.op12_vector_codes, corpus_sql.OP12),
    "op13_conversation_trie": Query(corpus.op13_conversation_trie, corpus_sql.OP13),
    "op11_prefix_bpe": Query(corpus.op11_prefix_bpe, None),
}
