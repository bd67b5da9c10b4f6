"""Finding and reading source files: ignore files, globs, languages, package manifests."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from keelson.errors import KeelsonError
from keelson.functions.text import EXTENSIONS, MANIFESTS, glob_to_regex
from keelson.session import ship

SKIPPED = (".git", "node_modules")  # fixed values: directories never entered


def language_of(path: str) -> str | None:
    ext = path.rpartition("/")[2].rpartition(".")
    return next((k for k, v in EXTENSIONS.items() if ext[1] and ext[2] in v), None)


def is_module_root(path: str) -> bool:
    """Files that stand for their directory."""
    name = path.rpartition("/")[2]
    return name in ("lib.rs", "main.rs", "mod.rs", "__init__.py", "__main__.py", "__init__.pyi") or bool(re.fullmatch(r"index\.[mc]?tsx?", name))


def _ignore_rules(folder: Path, rel: str) -> list[tuple[re.Pattern, bool, bool]]:
    """(pattern on repository-relative paths, negated, directories only)."""
    out = []
    file = folder / ".gitignore"
    if not file.is_file():
        return out
    for line in file.read_text(errors="replace").splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.removeprefix("!")
        only_dirs, line = line.endswith("/"), line.rstrip("/")
        anchored, line = "/" in line, line.lstrip("/")
        body = re.escape(line).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        out.append((re.compile(f"^{re.escape(rel + '/') if rel else ''}{'' if anchored else '(?:.*/)?'}{body}$"), negated, only_dirs))
    return out


def _walk(root: Path) -> Iterator[str]:
    def visit(folder: Path, rel: str, rules: list) -> Iterator[str]:
        rules = rules + _ignore_rules(folder, rel)

        def ignored(path: str, is_dir: bool) -> bool:
            hit = False
            for rx, negated, only_dirs in rules:
                if (is_dir or not only_dirs) and rx.match(path):
                    hit = not negated
            return hit

        for e in sorted(os.scandir(folder), key=lambda e: e.name):
            path = f"{rel}/{e.name}" if rel else e.name
            if e.is_dir(follow_symlinks=False):
                if e.name not in SKIPPED and not ignored(path, True):
                    yield from visit(Path(e.path), path, rules)
            elif e.is_file() and not ignored(path, False):
                yield path

    yield from visit(root, "", [])


def compile_globs(globs: Sequence[str]) -> list[re.Pattern]:
    try:
        return [re.compile(glob_to_regex(g)) for g in globs]
    except re.error as e:
        raise KeelsonError("CONFIG_INVALID", str(e), key="adapters") from e


def discover(root: str | Path, include: Sequence[str] = ("**",), exclude: Sequence[str] = (), languages: Sequence[str] = tuple(EXTENSIONS)) -> tuple[list[str], list[str]]:
    """(source paths, package roots), both sorted and relative to ``root``; nothing is read yet.

    A manifest makes its directory a package root whatever the globs say.
    """
    root = Path(root)
    if not root.is_dir():
        raise KeelsonError("INPUT_UNREADABLE", "not a directory", path=str(root))
    wanted, unwanted = compile_globs(include), compile_globs(exclude)
    files, roots = [], set()
    for p in _walk(root):
        if p.rpartition("/")[2] in MANIFESTS:
            roots.add(p.rpartition("/")[0])
        if language_of(p) in languages and any(r.match(p) for r in wanted) and not any(r.match(p) for r in unwanted):
            files.append(p)
    return sorted(files), sorted(roots)


def source_files(spark: SparkSession, root: str | Path, paths: Sequence[str]) -> DataFrame:
    """(path, contents), read by the executors from a folder that they share with the driver."""
    ship(spark)
    top = str(Path(root).resolve())

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "contents": [Path(top, p).read_text(errors="replace") for p in f["path"]]})

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.repartition(max(1, min(64, len(paths) // 50 + 1))).mapInPandas(read, "path string, contents string")
