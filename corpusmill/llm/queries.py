"""The queries of this subpackage and the SQL that some of them are checked against."""

from __future__ import annotations

from corpusmill.llm import chat_format, click_dedup, decontamination, embedding_dedup, katz, licences, minhash_dedup, packing, quality, secrets, substring_dedup, token_counts, whitening

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_quality": quality.op4_quality,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_minhash_dedup": minhash_dedup.op6_minhash_dedup,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_lm_score": katz.op8_lm_score,
    "op9_packing": packing.op9_packing,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_license_scan": licences.op11_license_scan,
    "op12_click_dedup": click_dedup.op12_click_dedup,
    "op13_whitening": whitening.op13_whitening,
}
SQL = {"op2_chat_format": chat_format.OP2_SQL, "op10_decontamination": decontamination.OP10_SQL, "op12_click_dedup": click_dedup.OP12_SQL}
