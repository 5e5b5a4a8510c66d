"""Schemas of the inputs and contracts.  Readers declare them; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "array<string>": T.ArrayType(T.StringType()), "array<int>": T.ArrayType(T.IntegerType()),
}


def _struct(fields: str) -> T.StructType:
    """The type of "name type, name type"; needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(", "))])


#: The names and types of the contracts.
RAW_NEMOTRON = _struct(
    "id string, prompt string, response string, prompt_label string, response_label string, language string, violated_categories string"
)
CANONICAL = _struct(
    "example_id string, source_id string, source_split string, dataset_source string, language string, view string, text string, "
    "prompt string, response string, safety_label string, prompt_safety_label string, categories array<string>, category_scope string"
)
SEA_CANONICAL = _struct(
    "example_id string, dataset_source string, source_revision string, source_path string, source_line bigint, source_split string, "
    "seahelm_task_name string, registered_in_pinned_seahelm_vi_suite boolean, subset string, language string, view string, "
    "prompt string, response string, text string, safety_label string, prompt_safety_label string, categories array<string>, "
    "category_scope string"
)
BENCHMARK_REQUIRED = ("example_id", "language", "view", "prompt", "safety_label")
MODEL_SPEC = _struct(
    "name string, id string, revision string, family string, target_modules array<string>"
)
TRAINING_EXAMPLE = _struct(
    "input_ids array<int>, attention_mask array<int>, labels array<int>"
)
