"""The queries of this folder and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import decontamination, language, licenses, line_dedup, near_dedup, packing, reputation, secrets, winnow, wrappers

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_licenses": licenses.op2_licenses,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_url_filter": reputation.op4_url_filter,
    "op5_html_text": wrappers.op5_html_text,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_language_id": language.op7_language_id,
    "op8_winnowing": winnow.op8_winnowing,
    "op9_packing": packing.op9_packing,
    "op10_near_dedup": near_dedup.op10_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op4_url_filter": reputation.ORACLE_SQL,
}
