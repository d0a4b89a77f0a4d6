"""The registered queries of the training-data operators, and their oracle SQL."""

from __future__ import annotations

from tramline.llm import matroska, mixing, pieces, quality, repeats, rules, secrets, simhash, toxicity, urls

QUERIES = {
    "op1_matroska": matroska.op1_matroska,
    "op2_quality": quality.op2_quality,
    "op3_repeats": repeats.op3_repeats,
    "op4_simhash": simhash.op4_simhash,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality_rules": rules.op6_quality_rules,
    "op7_url_filter": urls.op7_url_filter,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_secrets": secrets.op9_secrets,
    "op10_mixing": mixing.op10_mixing,
    "secret_ledger_runs": secrets.secret_ledger_runs,
    "unigram_words": pieces.unigram_words,
}
ORACLES: dict[str, str] = {
    "op3_repeats": repeats.ORACLE_OP3,
    "op6_quality_rules": rules.ORACLE_OP6,
    "op7_url_filter": urls.ORACLE_OP7,
    "op9_secrets": secrets.ORACLE_OP9,
    "op10_mixing": mixing.ORACLE_OP10,
    "secret_ledger_runs": secrets.ORACLE_LEDGER_RUNS,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
