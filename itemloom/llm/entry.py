"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from itemloom.llm import bestfit_packing, byte_bpe, kneser_ney, packing, pii, quality_rules, reply_trees, simhash, stable_ann, token_alignment, toxicity, url_filters, whitening

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_stable_ann": stable_ann.op2_stable_ann,
    "op3_packing": packing.op3_packing,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_kneser_ney": kneser_ney.op5_kneser_ney,
    "op6_reply_trees": reply_trees.op6_reply_trees,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_url_filters": url_filters.op8_url_filters,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_pii": pii.op10_pii,
    "op11_whitening": whitening.op11_whitening,
    "op12_bestfit_packing": bestfit_packing.op12_bestfit_packing,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}
ORACLE_SQL = {"op6_reply_trees": reply_trees.OP6_SQL, "op4_quality_rules": quality_rules.OP4_SQL, "op8_url_filters": url_filters.OP8_SQL}
