"""Parameters from YAML files with local overrides."""

from __future__ import annotations

import os
from typing import Any

import yaml


def merge(base: dict, over: dict) -> dict:
    """base with over's values; mappings merge, all else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str) -> dict:
    """A file's parameters, overridden by ``<name>.local.<ending>`` beside it."""
    stem, end = os.path.splitext(path)
    found: dict = {}
    for p in (path, f"{stem}.local{end}"):
        if os.path.exists(p):
            with open(p) as f:
                found = merge(found, yaml.safe_load(f) or {})
    return found


def get(params: dict, dotted: str, default: Any = None) -> Any:
    """The value at a dotted path."""
    at: Any = params
    for part in dotted.split("."):
        if not isinstance(at, dict) or part not in at:
            return default
        at = at[part]
    return at


def shell(value: Any) -> str:
    """A value as a shell word list: booleans as true and false, lists between blanks, nothing for None."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    return " ".join(map(shell, value)) if isinstance(value, list | tuple) else str(value)
