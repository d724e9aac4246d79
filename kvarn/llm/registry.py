"""Queries of the training-data operators, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from . import bitplanes, decontaminate, html_text, lexical, packing, pii, quotes, shards, simhash, topk, toxicity, url_rules, yinyang

QUERIES = {
    "op1_latent_decontamination": decontaminate.op1,
    "op2_best_fit_packing": packing.op2,
    "op3_size_tiered_shards": shards.op3,
    "op4_bit_planes": bitplanes.op4,
    "op5_simhash_trie": simhash.op5,
    "op6_quote_links": quotes.op6,
    "op7_bit_sliced_topk": topk.op7,
    "op8_pii_transducers": pii.op8,
    "op9_ftrl_toxicity": toxicity.op9,
    "op10_line_blocks": html_text.op10,
    "op11_yinyang_clusters": yinyang.op11,
    "op12_lexical_search": lexical.op12,
    "op13_url_rules": url_rules.op13,
    "quoted_conversations": quotes.archived,
}

ORACLES: dict[str, str] = {
    "op3_size_tiered_shards": shards.SQL,
    "op7_bit_sliced_topk": topk.SQL,
    "op10_line_blocks": html_text.SQL,
    "op11_yinyang_clusters": yinyang.SQL,
    "op12_lexical_search": lexical.SQL,
    "op13_url_rules": url_rules.SQL,
    "quoted_conversations": quotes.SQL,
}
