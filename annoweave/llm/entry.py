"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import dart_minhash, exact_dedup, html_layout, merkle, mixing, mpegts, packing, pii, secrets, sentence_pieces, spelling, token_counts, toxicity


def queries():
    return {
        "op1_secret_scan": secrets.op1,
        "op2_token_counts": token_counts.op2,
        "op3_media_columns": mpegts.op3,
        "op4_html_layout": html_layout.op4,
        "op5_exact_dedup": exact_dedup.op5,
        "op6_dart_minhash": dart_minhash.op6,
        "op7_pii": pii.op7,
        "op8_toxicity": toxicity.op8,
        "op9_mixing": mixing.op9,
        "op10_packing": packing.op10,
        "op11_merkle": merkle.op11,
        "op12_sentence_pieces": sentence_pieces.op12,
        "op13_spelling": spelling.op13,
    }


def oracle_sql():
    return {"op5_exact_dedup": exact_dedup.OP5_SQL, "op9_mixing": mixing.OP9_SQL, "op11_merkle": merkle.OP11_SQL}
