"""Queries of the numbered operators, for ``__spark_entry__``."""

from __future__ import annotations

from strandmill.llm import bpe, conversations, curriculum, decontaminate, hard_negatives, langid, media, neardup, ppm, secret_scan, sharding, suffix_dedup, warc

QUERIES = {
    "op1_media": media.op1,
    "op2_ppm": ppm.op2,
    "op3_sharding": sharding.op3,
    "op4_suffix_dedup": suffix_dedup.op4,
    "op5_decontaminate": decontaminate.op5,
    "op8_neardup": neardup.op8,
    "op6_language": langid.op6,
    "op9_warc": warc.op9,
    "op7_mixing": curriculum.op7,
    "op10_secrets": secret_scan.op10,
    "op11_hard_negatives": hard_negatives.op11,
    "op12_bpe": bpe.op12,
    "op13_conversations": conversations.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op8_neardup": neardup.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op13_conversations": conversations.OP13_SQL,
}
