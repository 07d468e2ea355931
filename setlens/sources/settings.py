"""YAML settings with overrides of known keys only."""

from __future__ import annotations

import copy
from pathlib import Path


def load(path: str) -> dict:
    import yaml

    value = yaml.safe_load(Path(path).read_text())
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no mapping")
    return value


def save(path: str, value: dict) -> None:
    import yaml

    from setlens.sources.files import write_text

    write_text(path, yaml.safe_dump(value, sort_keys=False, allow_unicode=True))


def parse_overrides(items: list[str]) -> dict[str, object]:
    import yaml

    out: dict[str, object] = {}
    for item in items:
        key, sign, text = item.partition("=")
        if not sign or not key:
            raise ValueError(f"not KEY=VALUE: {item}")
        if key in out:
            raise ValueError(f"given twice: {key}")
        out[key] = yaml.safe_load(text)
    return out


def override(settings: dict, changes: dict[str, object]) -> dict:
    """A copy with dotted keys replaced; a key that is not there is an error."""
    out = copy.deepcopy(settings)
    for dotted, value in changes.items():
        *parents, last = dotted.split(".")
        at = out
        for name in parents:
            if not isinstance(at.get(name), dict):
                raise KeyError(dotted)
            at = at[name]
        if last not in at:
            raise KeyError(dotted)
        at[last] = value
    return out


def check(settings: dict, rules: dict[str, tuple]) -> dict:
    """settings with defaults filled in. rules: name -> (type, default, low, high); unknown names and values out of range are errors."""
    if unknown := set(settings) - set(rules):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    out = {}
    for name, (kind, default, low, high) in rules.items():
        value = settings.get(name, default)
        if kind is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if not isinstance(value, kind) or (kind is not bool and isinstance(value, bool)):
            raise ValueError(f"{name} must be {kind.__name__}")
        if kind in (int, float) and not (low <= value <= high):
            raise ValueError(f"{name} must lie in [{low}, {high}]")
        out[name] = value
    return out
