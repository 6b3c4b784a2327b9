"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import (
    bwt_dedup,
    fm_decontamination,
    license_join,
    maxent_lm,
    preference_format,
    quality_rules,
    simhash_pivots,
    source_mixing,
    token_output,
    warc,
)

_QUERIES = {
    "op1_preference_format": preference_format.op1_preference_format,
    "op2_warc": warc.op2_warc,
    "op3_maxent_lm": maxent_lm.op3_maxent_lm,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_bwt_dedup": bwt_dedup.op5_bwt_dedup,
    "op6_fm_decontamination": fm_decontamination.op6_fm_decontamination,
    "op7_simhash_pivots": simhash_pivots.op7_simhash_pivots,
    "op8_source_mixing": source_mixing.op8_source_mixing,
    "op9_token_output": token_output.op9_token_output,
    "op10_license_join": license_join.op10_license_join,
}
_SQL = {
    "op1_preference_format": preference_format.ORACLE_SQL,
    "op2_warc": warc.ORACLE_SQL,
    "op4_quality_rules": quality_rules.ORACLE_SQL,
    "op6_fm_decontamination": fm_decontamination.ORACLE_SQL,
    "op10_license_join": license_join.ORACLE_SQL,
}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)
