"""The queries of the corpus operators, and SQL where SQL can state their results."""

from stratalex.llm import chat_format, decontaminate, exact_dedup, jaccard_join, licenses, mixing, ppm, token_orc, toxicity, wordpiece

QUERIES = {
    "op1_lm_scoring": ppm.op1_lm_scoring,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_mixing": mixing.op3_mixing,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op10_token_counts": wordpiece.op10_token_counts,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op5_license_scans": licenses.op5_license_scans,
    "op6_token_id_output": token_orc.op6_token_id_output,
    "op7_chat_formatting": chat_format.op7_chat_formatting,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
}

ORACLE_SQL = {
    "op5_license_scans": licenses.OP5_SQL,
    "op7_chat_formatting": chat_format.OP7_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE_SQL)
