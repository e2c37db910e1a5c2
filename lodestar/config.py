"""Layered configuration: a base chain, overrides, unknown keys refused, and a fingerprint of what changes results."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from pathlib import Path
from typing import Any


@dataclasses.dataclass(frozen=True)
class Config:
    top_k: int = 20
    threshold: float = 0.45
    half_life: float = 5.0
    as_of: float = 2026.0
    w_support: float = 0.50
    w_currency: float = 0.30
    w_rerank: float = 0.0
    w_authority: float = 0.20
    window: int = 256
    overlap: int = 32
    batch_size: int = 8
    device: str = "cpu"

    def fingerprint(self) -> str:
        """Twelve hex digits over all but what only changes speed."""
        kept = {k: v for k, v in dataclasses.asdict(self).items() if k not in ("batch_size", "device", "top_k")}
        return hashlib.sha256(json.dumps(kept, sort_keys=True).encode()).hexdigest()[:12]


def load(path: str | Path, overrides: list[str] | None = None, _seen: tuple[Path, ...] = ()) -> Config:
    """Read JSON with an optional `base` (relative to it); `key=value` overrides come last."""
    return from_mapping(_merged(Path(path).resolve(), ()) | dict(map(_override, overrides or [])))


def _merged(path: Path, seen: tuple[Path, ...]) -> dict[str, Any]:
    if path in seen:
        raise ValueError(f"the base of {path} leads back to it")
    own = json.loads(path.read_text())
    base = own.pop("base", None)
    return (_merged((path.parent / base).resolve(), (*seen, path)) if base else {}) | own


def _override(text: str) -> tuple[str, Any]:
    key, sign, value = text.partition("=")
    if not sign:
        raise ValueError(f"{text!r} is not key=value")
    try:
        return key, json.loads(value)
    except ValueError:
        return key, value


def from_mapping(values: dict[str, Any]) -> Config:
    known = {f.name for f in dataclasses.fields(Config)}
    if unknown := sorted(set(values) - known):
        raise ValueError(f"unknown keys: {', '.join(unknown)}; known: {', '.join(sorted(known))}")
    return Config(**values)
