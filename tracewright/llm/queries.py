"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, language_id, minhash, personal_data, piece_codec, substring_dedup, token_files, vector_passes, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": chat.op1_query,
    "op2_token_files": token_files.op2_query,
    "op3_substring_dedup": substring_dedup.op3_query,
    "op4_piece_codec": piece_codec.op4_query,
    "op5_personal_data": personal_data.op5_query,
    "op6_warc": warc.op6_query,
    "op7_decontamination": decontamination.op7_query,
    "op8_minhash": minhash.op8_query,
    "op9_language_id": language_id.op9_query,
    "op10_vector_passes": vector_passes.op10_query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat": chat.OP1_SQL,
    "op3_substring_dedup": substring_dedup.OP3_SQL,
    "op6_warc": warc.OP6_SQL,
    "op7_decontamination": decontamination.OP7_SQL,
    "op8_minhash": minhash.OP8_SQL,
}
