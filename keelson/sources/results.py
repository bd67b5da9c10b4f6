"""Saved results: JSON documents with a schema gate, and flat tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

from keelson import schema
from keelson.errors import KeelsonError


def write_json(result: dict, path: str | Path) -> None:
    Path(path).write_text(json.dumps(result, indent=2, ensure_ascii=False) + "\n")


def read_result(path: str | Path) -> dict:
    try:
        found = json.loads(Path(path).read_text())
    except (OSError, ValueError) as e:
        raise KeelsonError("INPUT_UNREADABLE", str(e), path=str(path)) from e
    version = found.get("schemaVersion", 0) if isinstance(found, dict) else 0
    if version != schema.RESULT_SCHEMA_VERSION:
        raise KeelsonError("INPUT_UNREADABLE", f"schema version {version} is not {schema.RESULT_SCHEMA_VERSION}", path=str(path))
    return found


def profile_of(result: dict, name: str) -> dict:
    for p in result["profiles"]:
        if p["name"] == name:
            return p
    raise KeelsonError("CANDIDATE_NOT_FOUND", f"profile {name} was not run")


def candidate_at(result: dict, name: str, index: int) -> dict:
    """Counted from 1."""
    found = profile_of(result, name)["candidates"]
    if not 1 <= index <= len(found):
        raise KeelsonError("CANDIDATE_NOT_FOUND", f"{name} has {len(found)} candidates, not {index}")
    return found[index - 1]


def parse_reference(text: str) -> tuple[str, int] | None:
    """``current`` (None) or ``profile/index``."""
    if text == "current":
        return None
    name, _, index = text.partition("/")
    if not name or not index.isdigit():
        raise KeelsonError("CANDIDATE_NOT_FOUND", f"`{text}` is neither current nor profile/index")
    return name, int(index)


def write_tables(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").format(form).save(f"{folder}/{name}")
