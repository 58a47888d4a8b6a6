"""Configuration documents: inheritance, dotted overrides, required keys. Driver side only."""

from __future__ import annotations

from pathlib import Path

import yaml


def merge(base: dict, over: dict) -> dict:
    """records are merged, anything else is replaced"""
    return {**base, **{k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}}


def load(path: str | Path, overrides: list[str] | None = None, _seen: tuple = ()) -> dict:
    """A YAML document over the one it extends, over the one that extends, and so on; then overrides `a.b=value`."""
    p = Path(path).resolve()
    if p in _seen:
        raise ValueError(f"{p} extends itself")
    own = yaml.safe_load(p.read_text(encoding="utf-8")) or {}
    parent = own.pop("extends", None)
    got = merge(load(p.parent / parent, None, (*_seen, p)), own) if parent else own
    for o in overrides or []:
        got = override(got, o)
    return got


def override(cfg: dict, text: str) -> dict:
    """`a.b=value`, value as a YAML scalar; a value is not replaced by a record that a longer path would need"""
    key, eq, value = text.partition("=")
    if not eq:
        raise ValueError(f"not key=value: {text}")
    out = merge(cfg, {})
    at, path = out, key.strip().split(".")
    for k in path[:-1]:
        nxt = at.get(k, {})
        if not isinstance(nxt, dict):
            raise ValueError(f"{k} in {key} is a value, not a record")
        at[k] = dict(nxt)
        at = at[k]
    at[path[-1]] = yaml.safe_load(value)
    return out


def need(cfg: dict, key: str):
    at = cfg
    for k in key.split("."):
        if not isinstance(at, dict) or k not in at:
            raise KeyError(f"missing {key}")
        at = at[k]
    return at
