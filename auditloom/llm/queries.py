"""The queries of this package, by the name they are registered under."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm.op01_ngram_join import op1_ngram_join
from auditloom.llm.op02_mixing import op2_mixing
from auditloom.llm.op03_toxicity import op3_toxicity
from auditloom.llm.op04_fingerprints import op4_fingerprints
from auditloom.llm.op05_line_dedup import op5_line_dedup
from auditloom.llm.op06_rules import ABLATIONS_SQL, op6_quality_rules, quality_rule_ablations
from auditloom.llm.op06_rules import SQL as SQL6
from auditloom.llm.op07_bpe import op7_bpe
from auditloom.llm.op08_quality import op8_quality_classifier
from auditloom.llm.op09_warc import SQL as SQL9
from auditloom.llm.op09_warc import op9_warc
from auditloom.llm.op10_urls import SQL as SQL10
from auditloom.llm.op10_urls import op10_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_fingerprints": op4_fingerprints,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_rules": op6_quality_rules,
    "quality_rule_ablations": quality_rule_ablations,
    "op7_bpe": op7_bpe,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_warc": op9_warc,
    "op10_url_filters": op10_url_filters,
}

ORACLE_SQL: dict[str, str] = {
    "op6_quality_rules": SQL6,
    "quality_rule_ablations": ABLATIONS_SQL,
    "op9_warc": SQL9,
    "op10_url_filters": SQL10,
}
