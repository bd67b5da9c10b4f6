"""TOML configuration: typed defaults, unknown and retired keys rejected by name, ranges checked."""

from __future__ import annotations

import copy
import math
import tomllib
from pathlib import Path
from typing import Any

from keelson import schema
from keelson.errors import KeelsonError

_PROFILE: dict[str, Any] = {
    "candidates": 3,
    "seed": 42,
    "capacity": {"file": 600, "folder": 20, "domain": 16, "package": 15, "package-group": 12},
    "objective": {"imbalance": 0.1, "naming": 0.3, "path": 0.2, "anchor": 1.0, "capacity": 4.0, "dependency-only": 0.05, "companion": 0.05},
    "weights": {"value-import": 1.0, "inheritance": 1.5, "call": 1.0, "type-reference": 0.3, "re-export": 0.0, "same-file-symbol": 1.0, "same-file-type": 3.0},
    "solver": {"ilp-threshold": 300, "timeout-seconds": 60},
    "diversity": {"pool-factor": 10, "score-tolerance": 0.05, "min-distance": 0.05},
    "relocation": {"allow-cross-package-moves": False, "forbid-files": [], "forbid-symbols": []},
    "qualification": {"weighted": 0.60, "structural": 0.50, "margin": 0.15},
}
_DEFAULT: dict[str, Any] = {
    "adapters": {"languages": ["typescript", "rust", "python"], "include": ["**"], "exclude": []},
    "analysis": {"profiles": ["anchored"], "jobs": 0},
    "tests": {"patterns": [], "builtins": True, "helper-cap": 600},
    "profiles": {"anchored": _PROFILE, "greenfield": copy.deepcopy(_PROFILE)},
}
_DEFAULT["profiles"]["greenfield"]["objective"] |= {"path": 0.0, "anchor": 0.0}
# Keys of older layouts, and ceilings.
_RETIRED = ("analysis.mode", "analysis.candidates", "analysis.seed", "capacity", "objective", "weights", "solver", "diversity")
_CEILINGS = {"capacity": 256, "jobs": 1024, "candidates": 64, "pool-factor": 64, "pool": 512, "ilp-threshold": 4096}
_CEILING_FREE = {"file"}


def defaults() -> dict[str, Any]:
    return copy.deepcopy(_DEFAULT)


def _bad(key: str | None, reason: str) -> KeelsonError:
    return KeelsonError("CONFIG_INVALID", reason, key=key)


def _merge(base: dict[str, Any], over: dict[str, Any], at: str) -> None:
    for k, v in over.items():
        key = f"{at}{k}"
        if k not in base:
            raise _bad(key, f"unknown field `{k}`")
        if isinstance(base[k], dict):
            if not isinstance(v, dict):
                raise _bad(key, "expected a table")
            _merge(base[k], v, f"{key}.")
        elif isinstance(base[k], bool) != isinstance(v, bool) or (isinstance(base[k], str | list) and not isinstance(v, type(base[k]))):
            raise _bad(key, f"expected {type(base[k]).__name__}")
        else:
            base[k] = v


def validate(cfg: dict[str, Any]) -> dict[str, Any]:
    a = cfg["analysis"]
    if not 0 <= a["jobs"] <= _CEILINGS["jobs"]:
        raise _bad("analysis.jobs", f"must be at most {_CEILINGS['jobs']}")
    if not a["profiles"]:
        raise _bad("analysis.profiles", "at least one parameter profile must be selected")
    if len(set(a["profiles"])) < len(a["profiles"]):
        raise _bad("analysis.profiles", "parameter profile names must be unique")
    for p in a["profiles"]:
        if p not in cfg["profiles"]:
            raise _bad("analysis.profiles", f"unknown profile `{p}`")
    if not cfg["adapters"]["languages"]:
        raise _bad("adapters.languages", "at least one language must be enabled")
    for x in cfg["adapters"]["languages"]:
        if x not in ("typescript", "rust", "python"):
            raise _bad("adapters.languages", f"unknown language `{x}`")
    if cfg["tests"]["helper-cap"] <= 0:
        raise _bad("tests.helper-cap", "must be positive")
    for i, p in enumerate(cfg["tests"]["patterns"]):
        if not p.removeprefix("!"):
            raise _bad(f"tests.patterns[{i}]", "a pattern must not be empty")
    for name, p in cfg["profiles"].items():
        at = f"profiles.{name}"
        if not 1 <= p["candidates"] <= _CEILINGS["candidates"]:
            raise _bad(f"{at}.candidates", f"must be from 1 to {_CEILINGS['candidates']}")
        for k, v in p["capacity"].items():
            if v <= 0 or (k not in _CEILING_FREE and v > _CEILINGS["capacity"]):
                raise _bad(f"{at}.capacity.{k}", "must be positive and within its ceiling")
        for part in ("objective", "weights", "qualification"):
            for k, v in p[part].items():
                if not math.isfinite(v) or v < 0:
                    raise _bad(f"{at}.{part}.{k}", "must be finite and not negative")
        for k in ("same-file-symbol", "same-file-type"):
            if p["weights"][k] < 1:
                raise _bad(f"{at}.weights.{k}", "must be at least 1")
        if not 0 <= p["solver"]["ilp-threshold"] <= _CEILINGS["ilp-threshold"]:
            raise _bad(f"{at}.solver.ilp-threshold", "is above its ceiling")
        d = p["diversity"]
        if not 1 <= d["pool-factor"] <= _CEILINGS["pool-factor"] or d["pool-factor"] * p["candidates"] > _CEILINGS["pool"]:
            raise _bad(f"{at}.diversity.pool-factor", "is above its ceiling")
    return cfg


def from_document(document: dict[str, Any]) -> dict[str, Any]:
    for key in _RETIRED:
        head, _, tail = key.partition(".")
        if (tail and tail in document.get(head, {})) or (not tail and head in document):
            raise _bad(key, f"unknown field `{tail or head}`")
    cfg = defaults()
    _merge(cfg, document, "")
    return validate(cfg)


def load_config(path: str | Path) -> dict[str, Any]:
    try:
        text = Path(path).read_text()
    except OSError as e:
        raise KeelsonError("INPUT_UNREADABLE", str(e), path=str(path)) from e
    try:
        return from_document(tomllib.loads(text))
    except tomllib.TOMLDecodeError as e:
        raise _bad(None, str(e)) from e


def objective_of(profile: dict[str, Any]) -> dict[str, float]:
    o = profile["objective"]
    return dict(zip(("lambda", "alpha", "beta", "mu", "gamma", "delta", "epsilon"), (o[k] for k in ("imbalance", "naming", "path", "anchor", "capacity", "dependency-only", "companion"))))


def weights_of(profile: dict[str, Any]) -> dict[str, float]:
    w = profile["weights"]
    return dict(zip(schema.EDGE_KINDS, (w[k] for k in ("value-import", "type-reference", "inheritance", "call", "re-export"))))
