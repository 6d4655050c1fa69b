"""The numbered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import exact_dedup, html_text, language_id, merkle, mixing, near_dedup, near_vectors, packing, prefix_trie, sharding, token_counts, toxicity, warc

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_pack": packing.op3_pack,
    "op4_near_vectors": near_vectors.op4_near_vectors,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_mix": mixing.op6_mix,
    "op7_html_text": html_text.op7_html_text,
    "op8_language_id": language_id.op8_language_id,
    "op9_revisits": warc.op9_revisits,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_shards": sharding.op13_shards,
}

ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op4_near_vectors": near_vectors.OP4_SQL,
    "op6_mix": mixing.OP6_SQL,
    "op9_revisits": warc.OP9_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_shards": sharding.OP13_SQL,
}
