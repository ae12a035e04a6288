"""Configuration: files, checks and keys."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from pathlib import Path

PLACEHOLDERS = ("", "your-api-key", "changeme", "xxx")


@dataclass(frozen=True)
class Check:
    name: str
    status: str
    details: str
    path: str = ""


def load(path: str) -> dict:
    """A JSON configuration, or YAML where a parser is there."""
    body = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(body)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML needs a parser that is not installed") from e
    return yaml.safe_load(body) or {}


def load_template(path: str, default: str | None = None) -> str:
    """A prompt template; a default, if given, stands for a missing file."""
    try:
        return Path(path).read_text()
    except FileNotFoundError:
        if default is None:
            raise
        return default


def get(config: dict, dotted: str, default=None):
    at = config
    for k in dotted.split("."):
        if not isinstance(at, dict) or k not in at:
            return default
        at = at[k]
    return at


def resolve_key(explicit: str | None, names: tuple[str, ...]) -> tuple[str | None, str]:
    """(key, where from): a configured key that is no placeholder, else the first variable that is set."""
    if explicit and explicit.strip().lower() not in PLACEHOLDERS and not explicit.startswith("${"):
        return explicit, "config"
    for n in names:
        if os.environ.get(n):
            return os.environ[n], n
    return None, "missing"


def batch_size(value, n: int) -> int:
    """A positive whole number, at most n; anything else is n."""
    try:
        size = int(value)
    except (TypeError, ValueError):
        return n
    return min(size, n) if size > 0 else n


def validate(config: dict, base: str = ".") -> list[Check]:
    """Weights sum to one, counts are positive, bounds are in order, named files exist."""
    out = []

    def check(name, ok, details="", path=""):
        out.append(Check(name, "PASS" if ok else "FAIL", details, path))

    for path in ("assistant.models", "noise.layers"):
        weights = [float(x.get("weight", 0)) for x in get(config, path, []) or []]
        if weights:
            check(f"{path} weights", abs(sum(weights) - 1) <= 1e-6, f"sum {sum(weights):g}", path)
    for path in ("personas.count", "queries.per_persona", "dialogue.workers", "dialogue.max_turns"):
        v = get(config, path)
        if v is not None:
            check(path, isinstance(v, int) and not isinstance(v, bool) and v > 0, repr(v), path)
    for low, high in (("sampling.least", "sampling.most"), ("dialogue.min_turns", "dialogue.max_turns")):
        a, b = get(config, low), get(config, high)
        if a is not None and b is not None:
            check(f"{low} <= {high}", a <= b, f"{a} and {b}", low)
    for path in ("prompts.style", "prompts.feedback", "prompts.formulation", "input.queries"):
        v = get(config, path)
        if v is not None:
            check(path, Path(base, v).exists(), v, path)
    for path in ("noise.probability", "style.probability"):
        v = get(config, path)
        if v is not None:
            check(path, 0 <= v <= 1, repr(v), path)
    rate = [get(config, f"split.{k}") for k in ("train", "val", "test")]
    if None not in rate:
        check("split", abs(sum(rate) - 1) <= 1e-6, f"sum {sum(rate):g}", "split")
    return out


def tally(checks: list[Check]) -> dict[str, int]:
    return {s: sum(c.status == s for c in checks) for s in ("PASS", "WARN", "FAIL")}


def model_pool(pool: list[dict]) -> list[tuple[str, float]]:
    """(name, weight) of a model pool; weights must sum to one."""
    out = [(m["name"], float(m.get("weight", 0))) for m in pool]
    if abs(sum(w for _, w in out) - 1) > 1e-6:
        raise ValueError("model weights must sum to 1")
    return out


def checkpoint_label(path: str) -> str:
    """The first eight characters of a UUID in a path and the path's last part without its suffix."""
    import re

    uuid = re.search(r"([0-9a-f]{8})-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", path)
    stem = Path(path.rstrip("/")).stem
    return f"{uuid[1]}_{stem}" if uuid else stem
