"""Queries of this subpackage, each next to the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talkframe.llm.decontaminate import OP3_SQL, op3_decontamination
from talkframe.llm.embedding_dedup import OP10_SQL, op10_embedding_dedup
from talkframe.llm.language import op5_language_id
from talkframe.llm.line_dedup import op1_line_dedup
from talkframe.llm.near_dedup import OP7_SQL, op7_near_dedup
from talkframe.llm.packing import op4_best_fit_packing
from talkframe.llm.pii import op9_personal_data
from talkframe.llm.quality import op6_quality
from talkframe.llm.repeats import OP13_SQL, op13_repeated_passages
from talkframe.llm.spelling import OP11_SQL, op11_spelling_variants
from talkframe.llm.token_counts import op2_token_counts
from talkframe.llm.token_store import op8_token_store
from talkframe.llm.whitening import op12_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_language_id": op5_language_id,
    "op6_quality": op6_quality,
    "op7_near_dedup": op7_near_dedup,
    "op8_token_store": op8_token_store,
    "op9_personal_data": op9_personal_data,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_whitening": op12_whitening,
    "op13_repeated_passages": op13_repeated_passages,
}
SQL: dict[str, str] = {
    "op3_decontamination": OP3_SQL,
    "op7_near_dedup": OP7_SQL,
    "op10_embedding_dedup": OP10_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op13_repeated_passages": OP13_SQL,
}
