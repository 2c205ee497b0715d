"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import best_fit, decontaminate, exact_topk, langid, line_dedup, part_enum, sharding, suffixes, superkmers, url_filter

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_exact_topk": exact_topk.op2_exact_topk,
    "op3_language_id": langid.op3_language_id,
    "op4_best_fit_packing": best_fit.op4_best_fit_packing,
    "op5_substring_dedup": superkmers.op5_substring_dedup,
    "op6_sharding": sharding.op6_sharding,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_near_duplicates": part_enum.op8_near_duplicates,
    "op9_suffix_dedup": suffixes.op9_suffix_dedup,
    "op10_url_filter": url_filter.op10_url_filter,
}

SQL = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op2_exact_topk": exact_topk.OP2_SQL,
    "op5_substring_dedup": superkmers.OP5_SQL,
    "op6_sharding": sharding.OP6_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op8_near_duplicates": part_enum.OP8_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
}
