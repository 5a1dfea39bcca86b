"""The queries of the operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from graphloom.llm import op01_collision_ann, op02_lattice_lm, op03_urls, op04_matroska, op05_token_files, op06_language, op07_toxicity, op08_mixing, op09_prefix_bpe, op10_setsketch

QUERIES = {
    "op1_collision_ann": op01_collision_ann.op1_collision_ann,
    "op2_lattice_lm": op02_lattice_lm.op2_lattice_lm,
    "op3_url_filter": op03_urls.op3_url_filter,
    "op4_matroska": op04_matroska.op4_matroska,
    "op5_token_files": op05_token_files.op5_token_files,
    "op6_language": op06_language.op6_language,
    "op7_toxicity": op07_toxicity.op7_toxicity,
    "op8_mixing": op08_mixing.op8_mixing,
    "op9_prefix_bpe": op09_prefix_bpe.op9_prefix_bpe,
    "op10_setsketch": op10_setsketch.op10_setsketch,
}

ORACLE = {"op8_mixing": op08_mixing.ORACLE}
