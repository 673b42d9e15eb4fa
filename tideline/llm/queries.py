"""The corpus operators' queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tideline.llm import line_dedup, resampling, vector_topk, yinyang
from tideline.llm.bpe_codec import op5_bpe_codec
from tideline.llm.language import op3_language
from tideline.llm.mixing import op7_mixing
from tideline.llm.near_dups import op2_near_dups
from tideline.llm.packing import op12_best_fit_packing
from tideline.llm.token_counts import op1_token_counts
from tideline.llm.token_files import op8_token_files
from tideline.llm.toxicity import op4_toxicity
from tideline.llm.winnowing import op6_winnowing

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_near_dups": op2_near_dups,
    "op3_language": op3_language,
    "op4_toxicity": op4_toxicity,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_winnowing": op6_winnowing,
    "op7_mixing": op7_mixing,
    "op8_token_files": op8_token_files,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_vector_topk": vector_topk.op10_vector_topk,
    "op11_yinyang": yinyang.op11_yinyang,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_resampling": resampling.op13_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op9_line_dedup": line_dedup.SQL,
    "op10_vector_topk": vector_topk.SQL,
    "op11_yinyang": yinyang.SQL,
    "op13_resampling": resampling.SQL,
}
