"""Configuration on the driver: settings, model lists, task registries and run places."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from lexwarden.schemas import MODEL_SPEC

try:
    import yaml
except ImportError:  # optional
    yaml = None


def load_config(path: str) -> dict:
    """A mapping from a YAML or JSON file; anything else raises."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if yaml is not None:
        value = yaml.safe_load(text)
    else:
        value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError(f"no mapping in {path}")
    return value


def write_config(value: Mapping, path: str) -> None:
    """A configuration file that :func:`load_config` reads; JSON, which is YAML as well."""
    with open(path, "w", encoding="utf-8") as file:
        json.dump(dict(value), file, ensure_ascii=False, indent=2)
        file.write("\n")


def registered_tasks(path: str, suite: str = "seahelm", language: str = "vi") -> set[str]:
    """Task names of a suite and language; empty without the file or the keys."""
    if not os.path.exists(path):
        return set()
    return set((load_config(path).get(suite) or {}).get(language) or [])


def model_id(name: str, configured: str, environment: Mapping[str, str] = os.environ) -> str:
    """``MODEL_PATH_<NAME>`` beats the configured id."""
    return environment.get(f"MODEL_PATH_{name.upper()}") or configured


def models_frame(spark: SparkSession, models: list[dict]) -> DataFrame:
    """Model specifications; a repeated name keeps its last specification."""
    by_name = {m["name"]: m for m in models}
    return spark.createDataFrame([tuple(m.get(f) for f in MODEL_SPEC.fieldNames()) for m in by_name.values()], MODEL_SPEC)


def merged_settings(common: Mapping, own: Mapping) -> dict:
    """Settings of a method over the common ones."""
    return {**common, **own}


#: Settings that only some methods have, and those that belong to the data or to a trial run.
LORA_KEYS = ("lora_r", "lora_alpha", "lora_dropout")
NOT_TRAINING = ("max_length", "smoke_max_steps", "pilot_max_steps", *LORA_KEYS)


def training_config(config: Mapping, model: Mapping, method: str, output: str, run_name: str, environment: Mapping[str, str] = os.environ) -> dict:
    """The configuration of one training run: model, data and training settings; adapter keys only for the adapter method."""
    training = config["training"]
    settings = merged_settings(training["common"], training[method])
    chosen = {"id": model_id(model["name"], model["id"], environment), "tuning": method, "attention": "sdpa", "trust_remote_code": False, "revision": None}
    chosen |= {k: model[k] for k in ("revision", "family", "attention", "trust_remote_code") if k in model}
    if method == "lora":
        chosen |= {k: settings[k] for k in LORA_KEYS} | {"target_modules": list(model["target_modules"])}
    data = config["data"]["output_dir"]
    return {
        "run_name": run_name, "model": chosen, "output_dir": output,
        "data": {"train": os.path.join(data, "train.jsonl"), "validation": os.path.join(data, "valid.jsonl"), "max_length": settings["max_length"]},
        "training": {k: v for k, v in settings.items() if k not in NOT_TRAINING},
    }


def evaluated_model(base_id: str, runs: str, name: str, method: str, trained: str, after: bool) -> tuple[str, str | None, str]:
    """(model, adapter or None, run directory) to evaluate: the base before training; after it, its final state or adapter."""
    if not after:
        return base_id, None, os.path.join(runs, name, "base")
    final = os.path.join(trained, "final")
    return (base_id, final, trained) if method == "lora" else (final, None, trained)
