"""Settings: defaults, key=value overrides, and the hash that identifies a run."""

from __future__ import annotations

import copy
import hashlib
import json

#: The defaults. Paths are empty until given, as nothing is downloaded.
DEFAULTS: dict = {
    "task": "financial-sentiment",
    "task_input": "sentence",
    "labels": ["negative", "neutral", "positive"],
    "seed": 20260821,
    "data": {
        "primary_path": "", "secondary_paths": [], "spans_path": "", "out_dir": "data/processed/pool",
        "n_test": 1000, "n_dev": 500, "dedup_threshold": 0.5, "cut_order": "replay",
    },
    "lexicons": {"reported_path": "", "supported_path": ""},
    "eval": {"bootstrap": 10000, "mode": "multinomial", "alpha": 0.05, "correction": "holm", "primary_metric": "macro_f1"},
    "runs": {"registry": "runs/registry.jsonl", "reports": "runs/reports"},
    "gate": {"least_multi_label": 100},
}


def resolve() -> dict:
    """A fresh copy of the defaults."""
    return copy.deepcopy(DEFAULTS)


def parse_value(text: str):
    """true, false and nothing in their spellings, then JSON, then the string as it is."""
    plain = text.strip().lower()
    if plain in ("true", "false"):
        return plain == "true"
    if plain in ("", "~", "none", "null"):
        return None
    try:
        return json.loads(text)
    except ValueError:
        return text


def merged(config: dict, more: dict) -> dict:
    """config with what more has, dictionaries within dictionaries; neither is changed."""
    out = dict(config)
    for key, value in more.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def override(config: dict, items: list[str]) -> dict:
    """A copy of config with every ``a.b=value`` set; parents that are missing are made."""
    for item in items:
        names, eq, text = item.partition("=")
        if not eq:
            raise ValueError(f"expected key=value: {item!r}")
        value = parse_value(text)
        for name in reversed(names.split(".")):
            value = {name: value}
        config = merged(config, value)
    return copy.deepcopy(config)


def config_hash(config: dict) -> str:
    """Of the canonical JSON: the order of keys doesn't matter."""
    text = json.dumps(config, sort_keys=True, separators=(",", ":"), default=str)
    return f"sha256:{hashlib.sha256(text.encode()).hexdigest()}"
