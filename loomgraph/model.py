"""Relations of the code graph, and the vocabularies they use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILES = "path string, content_hash binary, mtime_ns long, lang string, byte_len long, extracted_at long"
SYMBOLS = "id long, file_path string, name string, qualified string, kind string, span_start long, span_end long, signature string, parent_symbol string"
REFS = (
    "id long, from_file string, span_start long, span_end long, target_name string, target_qualified string, target_symbol_hint long, kind string, "
    "confidence string, extracted_qualified string, unresolved_receiver string, spelled_path boolean"
)
RELATIONS = "from_qualified string, to_qualified string, kind string, def_file string, span_start long, span_end long, confidence string"
IMPORTS = "from_file string, target_path string, target_symbol string, source_symbol string, reexport_module string"
COMMANDS = "name string, file_path string, span_start long, handler_symbol string"
STRINGS = "id long, file_path string, line long, value string, context_symbol string"
CONFIGS = "id long, file_path string, line long, key string, kind string"

# The confidence ladder and the reference kinds.
CONFIDENCE = {"exact": 1, "import_resolved": 2, "same_module": 3, "fuzzy_name": 4}
TEXTUAL_KINDS = ("call", "type", "use", "trait_bound")
STRUCTURAL_KINDS = ("impl", "extends", "implements")
CALLABLE_KINDS = ("function", "method", "class", "struct")

MAX_FILE_BYTES = 4 * 1024 * 1024


def confidence_rank(confidence: Column) -> Column:
    """1 for the strongest; null for a word outside the ladder."""
    out = F.lit(None).cast("int")
    for name, rank in CONFIDENCE.items():
        out = F.when(confidence == name, rank).otherwise(out)
    return out


def within_floor(confidence: Column, floor: str) -> Column:
    return confidence_rank(confidence) <= CONFIDENCE[floor]
