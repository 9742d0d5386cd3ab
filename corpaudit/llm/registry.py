"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, html_text, jaccard, lattice, lm_score, merkle, quality, repair, sharding, topk, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_html_text": html_text.op4_html_text,
    "op5_lm_score": lm_score.op5_lm_score,
    "op6_lattice": lattice.op6_lattice,
    "op7_quality": quality.op7_quality,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_shards": sharding.op10_shards,
    "op11_repair": repair.op11_repair,
    "op12_topk": topk.op12_topk,
    "op13_merkle": merkle.op13_merkle,
}
ORACLES = {"op1_url_filter": url_filter.ORACLE_SQL, "op4_html_text": html_text.ORACLE_SQL, "op6_lattice": lattice.ORACLE_SQL, "op8_jaccard": jaccard.ORACLE_SQL, "op11_repair": repair.ORACLE_SQL, "op12_topk": topk.ORACLE_SQL, "op13_merkle": merkle.ORACLE_SQL}
