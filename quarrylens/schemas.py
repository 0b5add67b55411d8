"""Explicit schemas of the fact tables, and drift checks (section 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FILES = "file_id long, file_path string, content_hash string, file_size long, lines_of_code int, is_test_file boolean"
SYMBOLS = "symbol_uid string, file_path string, name string, qualified_name string, kind string, parent_uid string, line_start int, line_end int, signature string, ast_fingerprint string, token_fingerprint string, semantic_category string, is_public boolean, is_async boolean, is_property boolean, is_static boolean, is_classmethod boolean, complexity_score int, lines_of_code int, base_classes array<string>, smell_complexity int, nesting_depth int, statement_count int, structure string"
BLOCKS = "block_uid string, symbol_uid string, file_path string, block_type string, line_start int, line_end int, lines_of_code int, statement_count int, nesting_level int, ast_fingerprint string, token_fingerprint string, normalized_fingerprint string"
DEPENDENCIES = "source_uid string, file_path string, target_external string, dependency_kind string, resolution string, confidence double, line int"
ATTRIBUTE_ACCESS = "symbol_uid string, file_path string, attribute_name string, access_type string, line_number int, receiver string, root string, outermost boolean"
ERRORS = "file_path string, message string"
DETAILS = "symbol_uid string, file_path string, detail string, name string, value string, line int"
ALL = {"files": FILES, "symbols": SYMBOLS, "blocks": BLOCKS, "dependencies": DEPENDENCIES, "attribute_access": ATTRIBUTE_ACCESS, "details": DETAILS, "errors": ERRORS}
KINDS = ("module", "class", "method", "function", "variable")
DEPENDENCY_KINDS = ("calls", "imports", "inherits", "uses_attr", "instantiates", "unknown")
RESOLUTIONS = ("exact", "probable", "unknown")


def drift(df: DataFrame, name: str) -> dict[str, list[str]]:
    """Columns that a table lacks, has besides, or has of another type (U8)."""
    want = {f.name: f.dataType for f in T._parse_datatype_string(ALL[name]).fields}
    have = {f.name: f.dataType for f in df.schema.fields}
    return {"missing": sorted(want.keys() - have.keys()), "extra": sorted(have.keys() - want.keys()), "type": sorted(c for c in want.keys() & have.keys() if want[c] != have[c])}
