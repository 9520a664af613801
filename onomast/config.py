"""Settings of the pipeline."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class LinkConfig:
    """Column names, source labels, fold size, weights and thresholds."""

    name: str = "name"
    source: str = "source"
    inference: str = "inference"
    reference: str = "reference"
    database: str = "database"
    fold_size: int = 200
    seed: int = 42
    idf_power: float = 0.67
    important_weight: float = 85.0
    subsidiary_weight: float = 10.0
    generic_weight: float = 5.0
    unordered_least: int = 95
    phonetic_least: int = 90
    report_threshold: float = 50.0
    cascade_threshold: float = 85.0
    max_tokens: int = 10
    compat: str = "tolerant"  # or "ieee": gates compare the plain sums with 85 and 100

    @property
    def slack(self) -> float:
        return 0.0 if self.compat == "ieee" else 1e-9


def load_config(path: str, section: str | None = None) -> LinkConfig:
    """Settings from an INI file; keys of all sections, or of one, that name a setting are used."""
    parser = configparser.ConfigParser()
    if not parser.read(path):
        raise FileNotFoundError(path)
    known = {f.name: f.type for f in fields(LinkConfig)}
    found = {}
    for s in [section] if section else parser.sections():
        for key, value in parser[s].items():
            if key in known:
                cast = {"int": int, "float": float}.get(known[key], str)
                found[key] = cast(value.strip().strip("\"'"))
    return replace(LinkConfig(), **found)
