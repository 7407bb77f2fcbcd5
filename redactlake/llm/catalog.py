"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from redactlake.llm import chat, exact_dedup, language, lattice, lexical, mixing, nearest, packing, passages, simhash, token_files, toxicity, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_nearest": nearest.op3_nearest,
    "op4_passages": passages.op4_passages,
    "op5_lattice_score": lattice.op5_lattice_score,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_mixing": mixing.op7_mixing,
    "op8_packing": packing.op8_packing,
    "op9_simhash": simhash.op9_simhash,
    "op10_language_id": language.op10_language_id,
    "op11_lexical": lexical.op11_lexical,
    "op12_token_files": token_files.op12_token_files,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op7_mixing": mixing.SQL,
    "op11_lexical": lexical.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
