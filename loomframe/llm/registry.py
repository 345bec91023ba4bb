"""Queries and SQL of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from loomframe.llm.bpe import op3_byte_bpe
from loomframe.llm.decontaminate import op1_decontaminate
from loomframe.llm.embeddings import op9_embedding
from loomframe.llm.langid import op10_language_id
from loomframe.llm.license_scan import op6_license_scan
from loomframe.llm.minhash import op7_minhash
from loomframe.llm.oracles import ORACLE_SQL as ORACLE_SQL
from loomframe.llm.pii import op8_pii
from loomframe.llm.store import op2_content_store
from loomframe.llm.substring import op5_substring
from loomframe.llm.toxicity import op4_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_content_store": op2_content_store,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_substring": op5_substring,
    "op6_license_scan": op6_license_scan,
    "op7_minhash": op7_minhash,
    "op8_pii": op8_pii,
    "op9_embedding": op9_embedding,
    "op10_language_id": op10_language_id,
    "pipeline": corpus_pipeline.run,
}
