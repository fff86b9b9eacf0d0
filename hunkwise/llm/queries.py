"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from hunkwise.llm import cws, decontamination, line_dedup, packing, pii, simhash, token_counts, toxicity, url_filter, warc

QUERIES = {
    "op1_fingerprints": cws.op1_fingerprints,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_simhash": simhash.op3_simhash,
    "op4_pii": pii.op4_pii,
    "op5_packing": packing.op5_packing,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_warc": warc.op8_warc,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLE_SQL = {
    "op7_line_dedup": line_dedup.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
    "op9_url_filter": url_filter.ORACLE_SQL,
}
