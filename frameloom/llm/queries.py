"""Queries of the corpus operators, by name, and the SQL that tells their results where SQL can."""

from __future__ import annotations

from . import chat, decontaminate, embedding_dedup, minhash, pattern_packing, pii, token_counts, token_output, toxicity, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_token_counts": token_counts.query,
    "op3_benchmark_decontamination": decontaminate.query,
    "op4_best_fit_packing": pattern_packing.query,
    "op5_toxicity": toxicity.query,
    "op6_embedding_near_dedup": embedding_dedup.query,
    "op7_pii": pii.query,
    "op8_minhash_near_dedup": minhash.query,
    "op9_chat_formatting": chat.query,
    "op10_token_output": token_output.query,
}

ORACLE_SQL = {
    "op1_warc": warc.SQL,
    "op3_benchmark_decontamination": decontaminate.SQL,
    "op6_embedding_near_dedup": embedding_dedup.SQL,
    "op9_chat_formatting": chat.SQL,
}
