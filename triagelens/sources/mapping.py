"""Field mappings: which record names feed which event field.

A mapping is a small driver-side configuration; it is checked here and then
compiled to column expressions by ``triagelens.operators.normalize``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class FieldMapping:
    fields: dict[str, list[str]]
    defaults: dict[str, Any] = field(default_factory=dict)
    source_type: str | None = None

    def first_names(self) -> dict[str, str]:
        """Flat form: each field with its first source name."""
        return {name: aliases[0] for name, aliases in self.fields.items()}


def build_mapping(config: FieldMapping | dict | None) -> FieldMapping | None:
    """Check a configuration; the full form has ``fields``, the flat form is fields only."""
    if config is None or isinstance(config, FieldMapping):
        return config
    if not isinstance(config, dict):
        raise ValueError("mapping must be an object")
    full = "fields" in config
    defaults = config.get("defaults", {}) if full else {}
    if not isinstance(defaults, dict):
        raise ValueError("mapping 'defaults' must be an object")
    source_type = config.get("source_type") if full else None
    return FieldMapping(
        fields=_aliases(config["fields"] if full else config),
        defaults=dict(defaults),
        source_type=(str(source_type).strip() or None) if source_type is not None else None,
    )


def _aliases(fields: Any) -> dict[str, list[str]]:
    if not isinstance(fields, dict):
        raise ValueError("mapping 'fields' must be an object")
    out = {}
    for target, names in fields.items():
        if not isinstance(names, (str, list)):
            raise ValueError(f"mapping field '{target}' must be a string or list of strings")
        listed = [names] if isinstance(names, str) else names
        kept = [text for text in (str(n).strip() for n in listed) if text]
        if not kept:
            raise ValueError(f"mapping field '{target}' must not be empty")
        out[str(target)] = kept
    return out


def load_mapping(path: str) -> FieldMapping:
    file = Path(path)
    if not file.exists():
        raise FileNotFoundError(f"Mapping file not found: {path}")
    kind = file.suffix.lower()
    text = file.read_text(encoding="utf-8")
    if kind == ".json":
        raw = json.loads(text)
    elif kind in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as exc:  # optional dependency
            raise RuntimeError("reading a YAML mapping needs the yaml module") from exc
        raw = yaml.safe_load(text)
    else:
        raise ValueError("Mapping file must be .json, .yaml, or .yml")
    return build_mapping(raw) or FieldMapping(fields={})
