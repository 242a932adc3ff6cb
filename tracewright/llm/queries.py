"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import conversation_repair, exact_dedup, hmm, html_text, mixing, near_dedup, packing, pii, prefix_trie, quality, token_files, topk, warc_zip

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_hmm_scoring": hmm.op2_hmm_scoring,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_dom_trees": html_text.op4_dom_trees,
    "op5_weak_pii": pii.op5_weak_pii,
    "op6_impact_topk": topk.op6_impact_topk,
    "op7_warc_zip": warc_zip.op7_warc_zip,
    "op8_pu_quality": quality.op8_pu_quality,
    "op9_mixing": mixing.op9_mixing,
    "op10_minmax_near_dedup": near_dedup.op10_minmax_near_dedup,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_token_files": token_files.op12_token_files,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

SQL = {"op3_exact_dedup": exact_dedup.OP3_SQL, "op6_impact_topk": topk.OP6_SQL, "op7_warc_zip": warc_zip.OP7_SQL, "op9_mixing": mixing.mix_sql(), "op13_prefix_trie": prefix_trie.OP13_SQL}
