"""The corpus queries by name, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.bpe_codec import op9_bpe_codec
from tesserae.llm.conversation_trie import SQL as TRIE_SQL
from tesserae.llm.conversation_trie import op11_conversation_trie
from tesserae.llm.html_text import op6_html_text
from tesserae.llm.license_scan import SQL as LICENSE_SQL
from tesserae.llm.license_scan import op5_license_scan
from tesserae.llm.lm_scoring import op2_lm_scoring
from tesserae.llm.quality_rules import SQL as QUALITY_SQL
from tesserae.llm.quality_rules import op3_quality_rules
from tesserae.llm.repeats import SQL as REPEATS_SQL
from tesserae.llm.repeats import op12_repeats
from tesserae.llm.simhash import op4_simhash
from tesserae.llm.source_audit import SQL as AUDIT_SQL
from tesserae.llm.source_audit import op13_source_audit
from tesserae.llm.source_mixing import op10_source_mixing
from tesserae.llm.token_counts import op1_token_counts
from tesserae.llm.top_k import SQL as TOP_K_SQL
from tesserae.llm.top_k import op8_top_k
from tesserae.llm.toxicity import op7_toxicity

_QUERIES = (op1_token_counts, op2_lm_scoring, op3_quality_rules, op4_simhash, op5_license_scan, op6_html_text, op7_toxicity, op8_top_k, op9_bpe_codec, op10_source_mixing, op11_conversation_trie, op12_repeats, op13_source_audit)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (*_QUERIES, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": QUALITY_SQL, "op5_license_scan": LICENSE_SQL, "op8_top_k": TOP_K_SQL, "op11_conversation_trie": TRIE_SQL, "op12_repeats": REPEATS_SQL, "op13_source_audit": AUDIT_SQL}
