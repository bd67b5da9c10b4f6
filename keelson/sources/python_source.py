"""Python extraction: a parser over whole files in parallel, and a relational binder.

The parser turns each file into declaration rows and use rows whose targets are already written as
(dotted module, name); binding is then a join of uses with declarations.
"""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.errors import KeelsonError
from keelson.session import cut, ship

DYNAMIC = 0.5
ROWS = "path string, module string, what string, name string, kind string, target_module string, target_name string, sloc long, level long"


def module_name(path: str) -> str:
    parts = path.rsplit(".", 1)[0].split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


def production_sloc(source: str, first: int, last: int, docstring: tuple[int, int] | None = None) -> int:
    """Lines first..last (from 1) that hold code: not blank, not comment, not the leading docstring."""
    code: set[int] = set()
    skip = (tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.ENCODING)
    for t in tokenize.generate_tokens(io.StringIO(source).readline):
        if t.type not in skip:
            code.update(range(t.start[0], t.end[0] + 1))
    text = source.splitlines()
    code = {n for n in code if n <= len(text) and text[n - 1].strip()}
    if docstring:
        code -= set(range(docstring[0], docstring[1] + 1))
    return sum(first <= n <= last for n in code)


class _Uses(ast.NodeVisitor):
    """What one declaration refers to: (kind, dotted name parts)."""

    def __init__(self):
        self.found: list[tuple[str, tuple[str, ...]]] = []
        self.local: set[str] = set()

    @staticmethod
    def dotted(n: ast.AST) -> tuple[str, ...] | None:
        parts: list[str] = []
        while isinstance(n, ast.Attribute):
            parts.append(n.attr)
            n = n.value
        return (n.id, *reversed(parts)) if isinstance(n, ast.Name) else None

    def _note(self, kind: str, n: ast.AST) -> bool:
        d = self.dotted(n)
        if d:
            self.found.append((kind, d))
        return d is not None

    def visit_Call(self, n: ast.Call) -> None:
        d = self.dotted(n.func)
        if d and d[-1] in ("getattr", "import_module", "__import__") and n.args:
            strings = [a.value for a in n.args if isinstance(a, ast.Constant) and isinstance(a.value, str)]
            if d[-1] == "getattr" and (base := self.dotted(n.args[0])) and strings:
                self.found.append(("Dynamic", (*base, strings[0])))
            elif strings:
                self.found.append(("DynamicModule", tuple(strings[0].split("."))))
        elif not self._note("Call", n.func):
            self.visit(n.func)
        for a in n.args:
            self.visit(a)
        for k in n.keywords:
            self.visit(k.value)

    def visit_Name(self, n: ast.Name) -> None:
        if isinstance(n.ctx, ast.Load):
            self._note("Ref", n)
        else:
            self.local.add(n.id)

    def visit_Attribute(self, n: ast.Attribute) -> None:
        if not self._note("Ref", n):
            self.generic_visit(n)

    def _annotation(self, n: ast.AST | None) -> None:
        if n is None:
            return
        if isinstance(n, ast.Constant) and isinstance(n.value, str):
            try:
                n = ast.parse(n.value, mode="eval").body
            except SyntaxError:
                return
        for x in ast.walk(n):
            if isinstance(x, ast.Name | ast.Attribute):
                self._note("Annotation", x)

    def visit_FunctionDef(self, n) -> None:
        for d in n.decorator_list:
            self.visit(d)
        a = n.args
        for p in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))):
            self.local.add(p.arg)
            self._annotation(p.annotation)
        self._annotation(n.returns)
        for d in (*a.defaults, *filter(None, a.kw_defaults)):
            self.visit(d)
        for s in n.body:
            self.visit(s)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, n: ast.ClassDef) -> None:
        for b in n.bases:
            self._note("Base", b)
        for d in n.decorator_list:
            self.visit(d)
        for s in n.body:
            self.visit(s)

    def visit_AnnAssign(self, n: ast.AnnAssign) -> None:
        self._annotation(n.annotation)
        self.visit(n.target)
        if n.value:
            self.visit(n.value)


def parse(path: str, source: str) -> list[tuple]:
    """Rows of one file (columns ROWS). A syntax error stops everything, with its place."""
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        raise KeelsonError("ADAPTER_PARSE_FAILURE", e.msg, path=path, line=e.lineno, column=e.offset) from None
    module = module_name(path)
    package = module if path.endswith(("__init__.py", "__init__.pyi")) else module.rpartition(".")[0]
    rows: list[tuple] = [(path, module, "module", module, None, None, None, 0, 0)]
    bound: dict[str, tuple[str, str | None]] = {}
    stars: list[str] = []

    def note_import(n: ast.AST) -> None:
        if isinstance(n, ast.Import):
            for a in n.names:
                bound[a.asname or a.name.split(".")[0]] = (a.name if a.asname else a.name.split(".")[0], None)
        elif isinstance(n, ast.ImportFrom):
            base = package.split(".") if n.level else []
            base = base[: len(base) - (n.level - 1)] if n.level > 1 else base
            full = ".".join([*filter(None, base), *filter(None, [n.module])])
            for a in n.names:
                if a.name == "*":
                    stars.append(full)
                else:
                    bound[a.asname or a.name] = (full, a.name)

    body = list(tree.body)
    for n in body:  # imports under a top-level if or try count too
        for x in ast.walk(n) if isinstance(n, ast.If | ast.Try) else [n]:
            note_import(x)
    declared: dict[str, tuple] = {}

    def declare(name: str, n: ast.AST, kind: str) -> None:
        doc = None
        inner = getattr(n, "body", None)
        if isinstance(inner, list) and inner and isinstance(inner[0], ast.Expr) and isinstance(getattr(inner[0], "value", None), ast.Constant) and isinstance(inner[0].value.value, str):
            doc = (inner[0].lineno, inner[0].end_lineno)
        start = min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))])
        declared[name] = (n, kind, production_sloc(source, start, n.end_lineno, doc))

    flat: list[ast.AST] = []
    for n in body:
        flat += [x for x in ast.iter_child_nodes(n) if isinstance(x, ast.stmt)] if isinstance(n, ast.If | ast.Try) else [n]
    exported: list[str] | None = None
    for n in flat:
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            declare(n.name, n, "Symbol")
        elif isinstance(n, ast.ClassDef):
            declare(n.name, n, "Type")
        elif isinstance(n, ast.Assign | ast.AnnAssign):
            for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                if isinstance(t, ast.Name):
                    if t.id == "__all__" and isinstance(n.value, ast.List | ast.Tuple):
                        exported = [e.value for e in n.value.elts if isinstance(e, ast.Constant)]
                    else:
                        declare(t.id, n, "Symbol")
    for name, (n, kind, sloc) in declared.items():
        rows.append((path, module, "declaration", name, kind, None, None, sloc, 0))
        uses = _Uses()
        uses.visit(n)
        for use, parts in uses.found:
            head = parts[0]
            if head in uses.local and head not in bound and head not in declared:
                continue
            if use == "DynamicModule":
                rows.append((path, module, "use", name, "Dynamic", ".".join(parts), None, 0, 0))
            elif head in bound:
                target, item = bound[head]
                if item is None:  # a module: the longest dotted prefix is the module, the next part the name
                    for k in range(len(parts), 0, -1):
                        rows.append((path, module, "use", name, use, ".".join([target, *parts[1:k]]), parts[k] if k < len(parts) else None, 0, k))
                else:
                    rows.append((path, module, "use", name, use, target, item, 0, 0))
                    if len(parts) > 1:
                        rows.append((path, module, "use", name, use, f"{target}.{item}", parts[1], 0, 1))
            elif head in declared and head != name:
                rows.append((path, module, "use", name, use, module, head, 0, 0))
            else:
                for s in stars:
                    rows.append((path, module, "use", name, "Dynamic", s, head, 0, 0))
    for alias, (target, item) in bound.items():
        if item is not None and (path.endswith(("__init__.py", "__init__.pyi")) or (exported and alias in exported)):
            rows.append((path, module, "re_export", alias, None, target, item, 0, 0))
    for target, item in bound.values():  # modules taken whole; ``from m import x`` may mean a module m.x
        rows.append((path, module, "whole", None, None, f"{target}.{item}" if item else target, None, 0, 0))
    for x in exported or ():
        rows.append((path, module, "public", x, None, None, None, 0, 0))
    return rows


def parse_files(files: DataFrame) -> DataFrame:
    """Rows of all files(path, contents)."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ROWS.split(", ")]
        for f in frames:
            out = [r for p, s in zip(f["path"], f["contents"]) for r in parse(p, s)]
            yield pd.DataFrame(out, columns=names)

    return files.mapInPandas(run, ROWS)


def is_test_path(path: F.Column) -> F.Column:
    """TestCase by file name or a tests directory anywhere; conftest is support."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name == "conftest.py", "TestSupport").when(name.rlike(r"^test_.*\.py$|_test\.py$") | path.contains("tests/"), "TestCase").otherwise("Production")


def bind(rows: DataFrame) -> dict[str, DataFrame]:
    """nodes and edges with dense ids, re-export nodes included."""
    rows = cut(rows)
    d = rows.filter("what = 'declaration'").select("path", "module", "name", "kind", "sloc", F.lit(False).alias("re_export"))
    names = d.select("module", "name").distinct()
    r = rows.filter("what = 're_export'").join(names, ["module", "name"], "left_anti").select("path", "module", "name", "target_module", "target_name").distinct()
    # A re-export lives if its target does, to a fixpoint along chains.
    alive = cut(r.join(names.select(F.col("module").alias("target_module"), F.col("name").alias("target_name")), ["target_module", "target_name"], "left_semi"))
    while True:
        more = r.join(alive.select(F.col("module").alias("target_module"), F.col("name").alias("target_name")), ["target_module", "target_name"], "left_semi")
        after = cut(alive.unionByName(more).distinct())
        if after.count() == alive.count():
            break
        alive = after
    every = d.unionByName(alive.select("path", "module", "name", F.lit("Symbol").alias("kind"), F.lit(0).cast("long").alias("sloc"), F.lit(True).alias("re_export"))).dropDuplicates(["path", "name"])
    files = every.groupBy("path").agg(F.count("*").alias("k"))
    before = files.select("path", (F.sum("k").over(Window.orderBy("path")) - F.col("k")).alias("before"))
    ids = every.join(before, "path").withColumn("id", F.col("before") + F.row_number().over(Window.partitionBy("path").orderBy("re_export", "name")) - 1)
    public = rows.filter("what = 'public'").select("path", "name", F.lit(True).alias("listed"))
    listing = rows.filter("what = 'public'").select("path", F.lit(True).alias("closed")).distinct()
    n = ids.join(public, ["path", "name"], "left").join(listing, "path", "left")
    open_ = F.when(F.col("closed"), F.coalesce("listed", F.lit(False))).otherwise(~F.col("name").startswith("_"))
    # A production module that takes another whole may use any of its members: they are beyond advice.
    whole_by = rows.filter("what = 'whole'").filter(is_test_path(F.col("path")) == "Production").select(F.col("target_module").alias("module"), F.lit(True).alias("advice_exempt")).distinct()
    n = n.join(whole_by, "module", "left").withColumn("advice_exempt", F.coalesce("advice_exempt", F.lit(False)))
    nodes = cut(n.select("id", "advice_exempt", "path", "module", "name", "kind", is_test_path(F.col("path")).alias("polarity"), F.col("sloc").alias("effective_size"), "re_export", open_.alias("public_api")))
    at = nodes.select(F.col("module").alias("target_module"), F.col("name").alias("target_name"), F.col("id").alias("target"))
    own = nodes.select("path", "name", F.col("id").alias("source"))
    u = rows.filter("what = 'use'").select("path", "name", "kind", "target_module", "target_name", "level")
    hit = u.filter("target_name is not null").join(at, ["target_module", "target_name"]).join(own, ["path", "name"]).filter("source <> target")
    whole = u.filter("target_name is null and kind = 'Dynamic'").join(at.drop("target_name"), "target_module").join(own, ["path", "name"]).filter("source <> target")
    called = hit.filter("kind = 'Call'").select("source", "target").distinct()
    refs = hit.filter("kind = 'Ref'").join(called, ["source", "target"], "left_anti")
    edge = lambda df, kind, hard, conf: df.select("source", "target", F.lit(kind).alias("kind"), F.lit(hard).alias("hardness"), F.lit(conf).alias("confidence")).distinct()
    links = alive.select("path", "name", "target_module", "target_name").join(at, ["target_module", "target_name"]).join(own, ["path", "name"])
    edges = (
        edge(hit.filter("kind = 'Base'"), "Inheritance", "Hard", 1.0).unionByName(edge(called, "Call", "Hard", 1.0)).unionByName(edge(hit.filter("kind = 'Annotation'"), "TypeReference", "Soft", 1.0))
        .unionByName(edge(refs, "ValueImport", "Hard", 1.0)).unionByName(edge(hit.filter("kind = 'Dynamic'").unionByName(whole.withColumn("target_name", F.lit(None).cast("string")).select(hit.columns)), "ValueImport", "Hard", DYNAMIC)).unionByName(edge(links, "ReExport", "Soft", 1.0))
    )
    return {"nodes": nodes, "edges": edges}


def test_pair_candidates(files: DataFrame) -> DataFrame:
    """(source, test): test_x.py and x_test.py beside the file, in tests/ beside it, and in a tests/ at the top."""
    p = F.col("path")
    folder, stem = F.regexp_replace(p, r"[^/]*$", ""), F.regexp_extract(p, r"([^/]+)\.py$", 1)
    shapes = [F.concat(a, b) for a in (folder, F.concat(folder, F.lit("tests/")), F.concat(F.lit("tests/"), folder)) for b in (F.concat(F.lit("test_"), stem, F.lit(".py")), F.concat(stem, F.lit("_test.py")))]
    return files.filter(stem != "").filter(is_test_path(p) == "Production").select(p.alias("source"), F.explode(F.array_distinct(F.array(*shapes))).alias("test"))


def entry_facts(files: DataFrame) -> DataFrame:
    """Files that something outside starts."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(name.isin("setup.py", "__main__.py")).select(F.col("path").alias("file"))
