"""The queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ragloom.llm.byte_bpe import op8_byte_bpe
from ragloom.llm.centroids import OP11_SQL, op11_centroids
from ragloom.llm.chat_format import OP6_SQL, op6_chat_format
from ragloom.llm.katz_lm import op3_katz_lm
from ragloom.llm.line_dedup import op4_line_dedup
from ragloom.llm.near_dup import OP5_SQL, op5_near_dup
from ragloom.llm.point_in_time import OP12_SQL, op12_point_in_time
from ragloom.llm.quality_classifier import op13_quality
from ragloom.llm.quality_rules import OP9_SQL, op9_quality_rules
from ragloom.llm.secret_scan import op10_secret_scan
from ragloom.llm.source_mixing import OP2_SQL, op2_source_mixing
from ragloom.llm.topk_search import OP1_SQL, op1_topk_search
from ragloom.llm.toxicity import op7_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": op1_topk_search,
    "op2_source_mixing": op2_source_mixing,
    "op3_katz_lm": op3_katz_lm,
    "op4_line_dedup": op4_line_dedup,
    "op5_near_dup": op5_near_dup,
    "op6_chat_format": op6_chat_format,
    "op7_toxicity": op7_toxicity,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality_rules": op9_quality_rules,
    "op10_secret_scan": op10_secret_scan,
    "op11_centroids": op11_centroids,
    "op12_point_in_time": op12_point_in_time,
    "op13_quality": op13_quality,
}
ORACLES: dict[str, str] = {
    "op1_topk_search": OP1_SQL,
    "op2_source_mixing": OP2_SQL,
    "op5_near_dup": OP5_SQL,
    "op6_chat_format": OP6_SQL,
    "op9_quality_rules": OP9_SQL,
    "op11_centroids": OP11_SQL,
    "op12_point_in_time": OP12_SQL,
}
