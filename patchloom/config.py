"""Settings: defaults, an optional YAML file over them, and their flat form for reports."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Default settings.
DEFAULTS: dict[str, Any] = {
    "pairs": {"granularity": "statement", "strategy": "aligned"},
    "classification": {
        "split": {"group_by": "method", "test_size": 0.2, "cv_folds": 0, "random_state": 42},
        "models": ["random_forest"], "threshold": 0.5, "method_aggregation": "max", "output_formats": ["csv"], "split_input": None,
        "raw_features": {"max_features": 2000, "ngram_range": [1, 2], "min_df": 1},
        "split_features": {
            "numeric": [
                "nesting_depth", "num_source_lines", "token_count", "char_length", "num_calls", "is_process_exec", "is_db_query", "is_dynamic_eval", "is_deserialization", "is_file_io", "is_network_call",
                "is_output_render", "uses_string_concat_or_format", "num_variables_defined", "num_variables_used", "uses_only_literals", "guard_count", "inside_error_handler", "is_error_handling_statement",
                "sanitization_call_detected", "is_compound", "num_direct_children", "cyclomatic_contribution",
            ],
            "categorical": ["statement_type", "parent_block_type", "call_target_kind", "language"], "raw_text_tfidf": False, "tfidf_max_features": 500,
        },
        "xai": {
            "enabled": True, "top_k": 20, "shap": True, "shap_max_samples": 300, "permutation": True, "permutation_repeats": 5, "permutation_scoring": "average_precision",
            "permutation_max_features": 100, "local_explanations": 10,
        },
    },
}


def merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """base with over's values; dictionaries are merged, everything else is replaced."""
    return base | {k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load(path: str | None = None) -> dict[str, Any]:
    """DEFAULTS under a YAML file's settings; the defaults alone if there is no such file or it can't be read."""
    if path is None:
        return DEFAULTS
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            found = yaml.safe_load(f)
    except (ImportError, OSError, ValueError):
        return DEFAULTS
    except Exception as e:  # a YAML error has no base of its own outside of the package
        if type(e).__module__.startswith("yaml"):
            return DEFAULTS
        raise
    return merge(DEFAULTS, found) if isinstance(found, dict) else DEFAULTS


def flat(settings: dict[str, Any], prefix: str = "") -> list[tuple[str, str]]:
    """(dotted key, value as JSON), in order."""
    out: list[tuple[str, str]] = []
    for k, v in settings.items():
        out += flat(v, f"{prefix}{k}.") if isinstance(v, dict) else [(f"{prefix}{k}", json.dumps(v))]
    return out


def table(spark: SparkSession, settings: dict[str, Any]) -> DataFrame:
    return spark.createDataFrame(flat(settings), "key string, value string")
