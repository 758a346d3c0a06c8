"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, exact_dedup, fill_middle, jaccard_join, language_id, lexical, ogg, pieces, pii, ppm, quality, secret_scan, token_counts

QUERIES = {
    "op1_ppm": ppm.op1_ppm,
    "op2_pii": pii.op2_pii,
    "op3_pieces": pieces.op3_pieces,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_quality": quality.op6_quality,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_language_id": language_id.op9_language_id,
    "op10_secret_scan": secret_scan.op10_secret_scan,
    "op11_ogg": ogg.op11_ogg,
    "op12_block_max": lexical.op12_block_max,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}

ORACLE_SQL = {
    "op4_decontamination": decontaminate.SQL,
    "op5_jaccard_join": jaccard_join.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op12_block_max": lexical.SQL,
    "op13_fill_middle": fill_middle.SQL,
}
