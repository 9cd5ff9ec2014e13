"""Project configuration: checked against a fixed schema, with defaults, and hashed."""

from __future__ import annotations

import hashlib
import json

# Sections with their keys and defaults, and what some keys may hold.
DEFAULTS = {
    "project": {"name": None, "id": None},
    "analysis": {"languages": ["python", "javascript", "typescript"], "exclude": [], "include_tests": False},
    "scoring": {"baseline": "auto", "baseline_file": ".baseline.json"},
    "policy": {"file": None},
    "output": {"format": "text"},
    "ignore": {"rules": [], "findings": []},
}
ALLOWED = {
    ("analysis", "languages"): {"python", "javascript", "typescript", "c", "cpp", "rust", "java", "go", "php"},
    ("scoring", "baseline"): {"auto", "strict", "off"},
    ("output", "format"): {"text", "json", "sarif"},
}
PATHS = (("analysis", "exclude"), ("scoring", "baseline_file"), ("policy", "file"))


def parse(text: str) -> dict:
    """A configuration from JSON, or from YAML where a parser for it is installed."""
    try:
        doc = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("the configuration is no JSON, and no YAML parser is installed") from e
        doc = yaml.safe_load(text)
    return check(doc)


def check(doc: dict) -> dict:
    """The configuration with defaults; unknown keys, values and paths that lead upwards are refused."""
    if not isinstance(doc, dict):
        raise ValueError("a configuration is a mapping")
    if doc.get("version", 1) != 1:
        raise ValueError(f"unsupported version {doc['version']}")
    if unknown := set(doc) - {"version", *DEFAULTS}:
        raise ValueError(f"unknown sections {sorted(unknown)}")
    out: dict = {"version": 1}
    for section, keys in DEFAULTS.items():
        given = doc.get(section) or {}
        if unknown := set(given) - set(keys):
            raise ValueError(f"unknown keys {sorted(unknown)} in {section}")
        out[section] = keys | given
    if not out["project"]["name"]:
        raise ValueError("project.name is missing")
    for (section, key), allowed in ALLOWED.items():
        value = out[section][key]
        low = [v.lower() for v in value] if isinstance(value, list) else value.lower()
        if wrong := set(low if isinstance(low, list) else [low]) - allowed:
            raise ValueError(f"{section}.{key} can't be {sorted(wrong)}")
        out[section][key] = low
    for section, key in PATHS:
        value = out[section][key]
        for p in value if isinstance(value, list) else [value] if value is not None else []:
            if ".." in p.strip().split("/"):
                raise ValueError(f"{section}.{key} leads upwards: {p!r}")
    return out


def config_hash(config: dict) -> str:
    """16 hex digits over the configuration in canonical form; lists count as sets, and ``include_tests`` doesn't count."""
    plain = {k: {n: sorted(v) if isinstance(v, list) else v for n, v in s.items() if n != "include_tests"} if isinstance(s, dict) else s for k, s in config.items()}
    return hashlib.sha256(json.dumps(plain, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
