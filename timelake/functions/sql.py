"""The functions as SQL functions of a session: `register(spark)`, then plain SQL can call them.

Scalar functions are SQL text of their own, so Catalyst inlines them; the normal forms that Spark lacks run in Arrow batches.
`tag_filter(TABLE(rows), expression)` keeps the rows of a table whose column `tags` satisfies a tag expression.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from timelake.functions import text
from timelake.operators.tags import parse_tag_expr, tags_match

KNOTS = "ARRAY<STRUCT<local: DOUBLE, source: DOUBLE>>"
_KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
_HIRAGANA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))
_SHARPS = ", ".join(f"'{n}'" for n in text.NOTES)


def _through(x: str, y: str, t: str) -> str:
    """Linear between the knots of `mapping`; null outside, to a billionth."""
    return f"""CASE WHEN size(mapping) >= 2 AND {t} >= mapping[0].{x} - 1e-9 AND {t} <= element_at(mapping, -1).{x} + 1e-9 THEN
        element_at(transform(sequence(1, size(mapping) - 1), i -> CASE WHEN least(greatest({t}, mapping[0].{x}), element_at(mapping, -1).{x}) <= mapping[i].{x} OR i = size(mapping) - 1
        THEN mapping[i - 1].{y} + (least(greatest({t}, mapping[0].{x}), element_at(mapping, -1).{x}) - mapping[i - 1].{x}) * (mapping[i].{y} - mapping[i - 1].{y}) / (mapping[i].{x} - mapping[i - 1].{x}) END),
        CAST(array_position(transform(sequence(1, size(mapping) - 1), i -> least(greatest({t}, mapping[0].{x}), element_at(mapping, -1).{x}) <= mapping[i].{x} OR i = size(mapping) - 1), true) AS INT)) END"""


#: Name: (parameters, type, expression).
FUNCTIONS = {
    "to_source": (f"mapping {KNOTS}, t DOUBLE", "DOUBLE", _through("local", "source", "t")),
    "to_local": (f"mapping {KNOTS}, s DOUBLE", "DOUBLE", _through("source", "local", "s")),
    "spans_overlap": ("a0 DOUBLE, a1 DOUBLE, b0 DOUBLE, b1 DOUBLE", "BOOLEAN", "a0 < b1 - 1e-9 AND a1 > b0 + 1e-9"),
    "frame_of": ("t DOUBLE", "BIGINT", "CAST(floor((t - 0.005D) / 0.01D + 0.5D) AS BIGINT)"),
    "clock_label": ("t DOUBLE", "STRING", "CASE WHEN CAST(bround(greatest(t, 0D) * 1000) AS BIGINT) >= 3600000 THEN format_string('%d:%02d:%02d.%03d', CAST(bround(t * 1000) AS BIGINT) div 3600000, CAST(bround(t * 1000) AS BIGINT) div 60000 % 60, CAST(bround(t * 1000) AS BIGINT) div 1000 % 60, CAST(bround(t * 1000) AS BIGINT) % 1000) ELSE format_string('%d:%02d.%03d', CAST(bround(greatest(t, 0D) * 1000) AS BIGINT) div 60000, CAST(bround(greatest(t, 0D) * 1000) AS BIGINT) div 1000 % 60, CAST(bround(greatest(t, 0D) * 1000) AS BIGINT) % 1000) END"),
    "to_hiragana": ("s STRING", "STRING", f"translate(s, '{_KATAKANA}', '{_HIRAGANA}')"),
    "stripped_text": ("s STRING", "STRING", r"regexp_replace(lower(s), '[\\p{P}\\p{Z}\\p{C}\\s]', '')"),
    "norm_text": ("s STRING", "STRING", "stripped_text(nfkc(s))"),
    "midi_of_hz": ("hz DOUBLE", "DOUBLE", "CASE WHEN hz > 0 THEN 69 + 12 * log2(hz / 440.0D) END"),
    "note_name": ("midi DOUBLE", "STRING", f"concat(element_at(array({_SHARPS}), CAST(pmod(CAST(floor(midi + 0.5D) AS INT), 12) AS INT) + 1), CAST(CAST(floor(floor(midi + 0.5D) / 12) AS INT) - 1 AS STRING))"),
    "facet_of": ("tag STRING", "STRING", "CASE WHEN instr(tag, ':') > 1 THEN split_part(tag, ':', 1) ELSE 'tag' END"),
}


class TagFilter:
    """Rows of a table whose column `tags` satisfies an expression; the expression is checked before anything runs."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, expression: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("tag_filter takes TABLE(...) and an expression")
        field = next((f for f in rows.dataType.fields if f.name == "tags"), None)
        if field is None or field.dataType != ArrayType(StringType()) and not isinstance(field.dataType, ArrayType):
            raise ValueError("the table has no array column named tags")
        if expression.value is None:
            raise ValueError("the expression must be a constant")
        parse_tag_expr(expression.value)
        return AnalyzeResult(schema=rows.dataType)

    def __init__(self):
        self.parsed: dict[str, tuple | None] = {}

    def eval(self, row, expression: str):
        if expression not in self.parsed:
            self.parsed[expression] = parse_tag_expr(expression)
        if tags_match(self.parsed[expression], set(row["tags"] or ())):
            yield tuple(row)


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    spark.udf.register("nfkc", text.nfkc)
    spark.udf.register("nfc", text.nfc)
    for name, (parameters, kind, expression) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {expression}")
    spark.udtf.register("tag_filter", F.udtf(TagFilter))
