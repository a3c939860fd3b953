"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quern.llm import chat_format, decontaminate, exact_dedup, html_extract, license_scan, packing, pii, sharding, simhash, toxicity

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_packing": packing.op2_packing,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_simhash": simhash.op8_simhash,
    "op9_pii": pii.op9_pii,
    "op10_sharding": sharding.op10_sharding,
}
ORACLE_SQL = {
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_chat_format": chat_format.ORACLE,
    "op10_sharding": sharding.ORACLE,
}
