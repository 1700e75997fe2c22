"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, byte_bpe, conversations, exact_dedup, html_text, licenses, matroska, near_dedup, packing, secrets, toxicity, warc, whitening


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_near_dedup": near_dedup.op2_near_dedup,
        "op3_secret_scan": secrets.op3_secret_scan,
        "op4_bpe": bpe.op4_bpe,
        "op5_html_text": html_text.op5_html_text,
        "op6_packing": packing.op6_packing,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_matroska": matroska.op8_matroska,
        "op9_license_scan": licenses.op9_license_scan,
        "op10_warc": warc.op10_warc,
        "op11_embedding_whitening": whitening.op11_embedding_whitening,
        "op12_byte_bpe": byte_bpe.op12_byte_bpe,
        "op13_conversation_repair": conversations.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.OP1_SQL, "op10_warc": warc.OP10_SQL}
