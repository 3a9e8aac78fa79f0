"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from arcwise.llm import langid, mixing, phrases, pieces, quality, runs, sharding, simhash, sketches, substrings, tokencounts, topk, urls

QUERIES: dict[str, Callable] = {
    "op1_url_filter": urls.op1_url_filter,
    "op2_digest_cache": tokencounts.op2_digest_cache,
    "op3_norm_buckets": topk.op3_norm_buckets,
    "op4_lookup_sketch": sketches.op4_lookup_sketch,
    "op5_piece_trie": pieces.op5_piece_trie,
    "op6_simhash": simhash.op6_simhash,
    "op7_block_anchors": substrings.op7_block_anchors,
    "op8_systematic_mix": mixing.op8_systematic_mix,
    "op9_pu_quality": quality.op9_pu_quality,
    "op10_ring_sharding": sharding.op10_ring_sharding,
    "op11_lcp_runs": runs.op11_lcp_runs,
    "op12_gram_bayes": langid.op12_gram_bayes,
    "op13_prefix_groups": phrases.op13_prefix_groups,
}

ORACLE_SQL: dict[str, str] = {
    "op3_norm_buckets": topk.OP3_SQL,
    "op8_systematic_mix": mixing.OP8_SQL,
    "op13_prefix_groups": phrases.OP13_SQL,
}
