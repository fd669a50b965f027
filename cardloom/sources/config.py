"""Configuration and labelled evaluation sets from YAML."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from cardloom.functions.cost import MID
from cardloom.schemas import BLOOM_LEVELS, CARD_TYPES

# The card types asked for by default.
DEFAULT_TYPES = ("qa", "term_definition", "summary_point", "reversible", "sequence", "compare_contrast")


@dataclass(frozen=True)
class Config:
    """Settings; sections of the file become prefixes of the names."""

    # The defaults.
    model: str = MID
    model_overridden: bool = False
    max_tokens: int = 8192
    quality_confidence_threshold: float = 0.90
    quality_enable_critique: bool = True
    quality_max_critique_rounds: int = 2
    cards_max_cards: int = 50
    cards_card_types: tuple[str, ...] = DEFAULT_TYPES
    cards_bloom_levels: tuple[str, ...] = BLOOM_LEVELS
    cost_budget_limit: float = 1.00
    cost_warn_at: float = 0.80
    ocr_enabled: bool = False
    ocr_lang: str = "jpn+eng"
    cache_enabled: bool = True
    cache_dir: str = ".cache"
    batch_enabled: bool = False
    batch_poll_interval: float = 30.0
    batch_timeout: float = 3600.0
    vision_enabled: bool = False
    vision_coverage: float = 0.20
    vision_max_images: int = 5
    output_format: str = "tsv"
    output_encoding: str = "utf-8"


#: Environment variables that override the file.
ENVIRONMENT = {"CARDLOOM_MODEL": ("model", str), "CARDLOOM_BUDGET_LIMIT": ("cost_budget_limit", float)}


def flatten(data: dict, prefix: str = "") -> dict:
    """Keys of nested mappings joined by _."""
    out: dict = {}
    for key, value in data.items():
        name = f"{prefix}{key}"
        out |= flatten(value, f"{name}_") if isinstance(value, dict) else {name: value}
    return out


def load_config(path: str | None = None, environment: dict[str, str] | None = None, **overrides) -> Config:
    """Defaults, then the file, then the environment, then overrides.

    A missing file and invalid YAML raise; YAML that isn't a mapping is ignored, and so are unknown names.
    model_overridden never comes from a file; it is set when a caller chooses the model.
    """
    import yaml

    values: dict = {}
    if path is not None:
        if not Path(path).exists():
            raise FileNotFoundError(path)
        try:
            data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
        except yaml.YAMLError as e:
            raise ValueError(f"invalid YAML in {path}") from e
        values = flatten(data) if isinstance(data, dict) else {}
    names = {f.name for f in fields(Config)} - {"model_overridden"}
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in names}
    env = os.environ if environment is None else environment
    values |= {name: kind(env[key]) for key, (name, kind) in ENVIRONMENT.items() if env.get(key)}
    config = Config(**values)
    given = {k: v for k, v in overrides.items() if v is not None}
    return replace(config, **given, **({"model_overridden": True} if "model" in given else {}))


def quality_level(config: Config, level: str) -> Config:
    """Q13: off neither scores nor critiques, basic and full do what the configuration says."""
    if level not in ("off", "basic", "full"):
        raise ValueError(level)
    return replace(config, quality_enable_critique=False) if level == "off" else config


def load_dataset(spark: SparkSession, path: str) -> tuple[str, str, DataFrame, DataFrame]:
    """Name, version, cases (case_id, text, description) and expected cards of a labelled set.

    A missing key raises KeyError, an unknown card type ValueError.
    """
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    cases, expected = [], []
    for case in data["cases"]:
        cases.append((case["id"], case["text"], case.get("description", "")))
        for i, card in enumerate(case["expected_cards"]):
            kind = card.get("card_type")
            if kind is not None and kind not in CARD_TYPES:
                raise ValueError(f"unknown card type {kind!r}")
            expected.append((case["id"], i, list(card["front_keywords"]), list(card["back_keywords"]), kind, list(card.get("tags", ()))))
    columns = "case_id string, exp_idx int, front_keywords array<string>, back_keywords array<string>, wanted_type string, tags array<string>"
    return data["name"], data["version"], spark.createDataFrame(cases, "case_id string, text string, description string"), spark.createDataFrame(expected, columns)
