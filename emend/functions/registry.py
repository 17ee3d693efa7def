"""Names under which SQL can call this library's functions, in the session that they are registered in."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.cleanup import likeness_column
from .text import BEA_RULES, CONLL_RULES, JOIN_CLITIC, WHITE


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _chain(text: str, *rules: tuple[str, str]) -> str:
    """Regular expressions and replacements, one after the other, as SQL."""
    for pattern, new in rules:
        text = f"regexp_replace({text}, {_literal(pattern)}, {_literal(new)})"
    return text


_SPACE = (r"(?U)\s+", " ")
_WORDS = "size(filter(split({0}, ' '), w -> w <> ''))"
_CLEAN = f"trim({_chain('t', _SPACE)})"
#: SQL functions: arguments, type, and what they return; native, so they are planned as any other expression.
NATIVE = {
    "clean_space": ("t STRING", "STRING", _CLEAN),
    "strip_white": ("t STRING", "STRING", f"btrim(t, {_literal(WHITE)})"),
    "word_count": ("t STRING", "INT", _WORDS.format(_CLEAN)),
    "conll_text": ("t STRING", "STRING", _chain("t", JOIN_CLITIC, *CONLL_RULES)),
    "bea_text": ("t STRING", "STRING", _chain("t", JOIN_CLITIC, *BEA_RULES)),
    "between_tags": ("t STRING, b STRING, e STRING", "STRING", "substring_index(CASE WHEN instr(t, b) > 0 THEN substring(t, instr(t, b) + length(b)) ELSE t END, e, 1)"),
    "agreement_tag": ("a STRING, b STRING", "STRING", "CASE WHEN a = concat(b, 's') THEN '$TRANSFORM_AGREEMENT_SINGULAR' WHEN concat(a, 's') = b THEN '$TRANSFORM_AGREEMENT_PLURAL' END"),
}
#: Functions that run in Python workers, on Arrow batches.
FUNCTIONS = {"likeness": likeness_column}


def register_functions(spark: SparkSession) -> list[str]:
    for name, (arguments, kind, body) in NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
    return sorted([*NATIVE, *FUNCTIONS])
