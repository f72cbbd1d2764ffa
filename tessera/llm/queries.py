"""The queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

from .line_dedup import OP1_SQL
from .quality_rules import OP6_SQL
from .suffix_dedup import OP4_SQL
from .tool_calls import OP3_SQL
from .warc import OP5_SQL

_MODULES = {
    "line_dedup": ["op1_line_dedup"],
    "tiling": ["op2_benchmark_tiling"],
    "tool_calls": ["op3_tool_call_linking"],
    "suffix_dedup": ["op4_suffix_dedup"],
    "warc": ["op5_warc_revisits"],
    "quality_rules": ["op6_repetition_coverage"],
    "langid_cnn": ["op7_language_cnn"],
    "near_dedup": ["op8_weighted_minhash"],
    "bpe": ["op9_byte_bpe"],
    "toxicity": ["op10_compression_toxicity"],
}
QUERIES = {name: getattr(import_module(f"{__package__}.{module}"), name) for module, names in _MODULES.items() for name in names}
ORACLE_SQL = {"op1_line_dedup": OP1_SQL, "op3_tool_call_linking": OP3_SQL, "op4_suffix_dedup": OP4_SQL, "op5_warc_revisits": OP5_SQL, "op6_repetition_coverage": OP6_SQL}
