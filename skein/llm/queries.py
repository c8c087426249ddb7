"""Queries of this subpackage and their SQL; ``__spark_entry__`` adds them where it can be imported."""

from __future__ import annotations

from . import bpe, conversations, decontam, html, licenses, linededup, ngramjoin, pii, quality, sessions, sharding, substrings, tokencounts

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_line_dedup": linededup.op2_line_dedup,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_html_extraction": html.op4_html_extraction,
    "op5_ngram_join": ngramjoin.op5_ngram_join,
    "op6_token_counts": tokencounts.op6_token_counts,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_bpe": bpe.op9_bpe,
    "op10_sharding": sharding.op10_sharding,
    "op11_personal_data": pii.op11_personal_data,
    "op12_gap_sessions": sessions.op12_gap_sessions,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}
SQL = {
    "op1_license_scan": licenses.OP1_SQL,
    "op2_line_dedup": linededup.OP2_SQL,
    "op5_ngram_join": ngramjoin.OP5_SQL,
    "op7_decontamination": decontam.OP7_SQL,
    "op8_quality_rules": quality.OP8_SQL,
    "op12_gap_sessions": sessions.OP12_SQL,
}
