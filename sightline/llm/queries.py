"""Registered queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

import corpus_pipeline
from sightline.llm import alignment, chat, decontaminate, extraction, language, minhash, packing, privacy, quality, sharding, vectors, warc, whitening

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_pii": privacy.op1_pii,
    "op2_warc": warc.op2_warc,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_sharding": sharding.op4_sharding,
    "op5_embedding_near_dedup": vectors.op5_embedding_near_dedup,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_html_extraction": extraction.op7_html_extraction,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_minhash_near_dedup": minhash.op9_minhash_near_dedup,
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op11_cross_tokenizer_alignment": alignment.op11_cross_tokenizer_alignment,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_language_id": language.op13_language_id,
}

SQL = {
    **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
    "op2_warc": warc.OP2_SQL,
    "op5_embedding_near_dedup": vectors.OP5_SQL,
    "op9_minhash_near_dedup": minhash.OP9_SQL,
    "op10_chat_formatting": chat.OP10_SQL,
}
