"""Queries and SQL of the training-data operators."""

from larder.llm import decontam, fim, language, licenses, lines, lm, mixing, near_dup, pii, repair, secrets, toxicity, vector_search

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_language_id": language.op3_language_id,
    "op4_exact_top_k": vector_search.op4_exact_top_k,
    "op5_decontamination": decontam.op5_decontamination,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_minhash_dedup": near_dup.op7_minhash_dedup,
    "op8_source_mix": mixing.op8_source_mix,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_lm_score": lm.op10_lm_score,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_license_scan": licenses.op12_license_scan,
    "op13_conversation_repair": repair.op13_conversation_repair,
}
SQL = {"op4_exact_top_k": vector_search.OP4_SQL, "op9_line_dedup": lines.OP9_SQL, "op11_fill_in_middle": fim.OP11_SQL, "op12_license_scan": licenses.OP12_SQL}
