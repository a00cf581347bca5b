"""The queries of the operators and their SQL, added to the registry by __spark_entry__.py."""

from __future__ import annotations

from attestor.llm import ann, decontam, html_text, langid, licenses, linededup, pieces, pii, sharding, simhash

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_language_id": langid.op3_language_id,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op5_simhash": simhash.op5_simhash,
    "op6_licenses": licenses.op6_licenses,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_personal_data": pii.op8_personal_data,
    "op9_neighbours": ann.op9_neighbours,
    "op10_html_text": html_text.op10_html_text,
}
ORACLE: dict[str, str] = {"op4_line_dedup": linededup.SQL, "op7_decontamination": decontam.SQL}
