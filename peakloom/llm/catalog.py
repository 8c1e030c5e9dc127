"""The text queries, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, classifier, filter_audit, jaccard, langid, near_vectors, packing, pieces, quality_rules, secret_scan, source_divergence, topk, unit_dedup

QUERIES = {f.__name__: f for f in (
    langid.op1_language_id, pieces.op2_sentencepiece, packing.op3_packing, chat.op4_chat_format, topk.op5_topk,
    secret_scan.op6_secrets, unit_dedup.op7_unit_dedup, quality_rules.op8_quality_rules, jaccard.op9_jaccard_join,
    classifier.op10_quality, near_vectors.op11_near_vectors, filter_audit.op12_filter_audit, source_divergence.op13_source_divergence)}

ORACLE_SQL = {
    "op4_chat_format": chat.OP4_SQL, "op5_topk": topk.OP5_SQL, "op6_secrets": secret_scan.OP6_SQL,
    "op7_unit_dedup": unit_dedup.OP7_SQL, "op9_jaccard_join": jaccard.OP9_SQL, "op11_near_vectors": near_vectors.OP11_SQL, "op12_filter_audit": filter_audit.OP12_SQL,
    "op13_source_divergence": source_divergence.OP13_SQL}
