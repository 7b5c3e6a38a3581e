"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from . import bit_sliced, decontaminate, fm, mixing, prefix_trie, rules, secrets, simhash, sstable, suffix_dedup, tool_calls, url_filter, wavelet

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_secret_scan": secrets.query,
    "op3_mix_sources": mixing.query,
    "op4_simhash_near_dedup": simhash.query,
    "op5_quality_classifier": fm.query,
    "op6_link_tool_calls": tool_calls.query,
    "op7_suffix_dedup": suffix_dedup.query,
    "op8_decontaminate": decontaminate.query,
    "op9_token_shards": sstable.query,
    "op10_quality_rules": rules.query,
    "op11_bit_sliced_search": bit_sliced.query,
    "op12_ranked_search": wavelet.query,
    "op13_prefix_trie": prefix_trie.query,
}

ORACLES = {
    "op1_url_filter": url_filter.ORACLE,
    "op3_mix_sources": mixing.ORACLE,
    "op6_link_tool_calls": tool_calls.ORACLE,
    "op11_bit_sliced_search": bit_sliced.ORACLE,
    "op12_ranked_search": wavelet.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
