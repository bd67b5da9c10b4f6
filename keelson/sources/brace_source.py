"""TypeScript and Rust extraction at token level: a labelled subset.

Comments and strings are blanked first, lengths kept. Top-level declarations are found by keyword, their extents by
braces, imports by their statement forms, and uses by identifier. There is no type checker: names resolve through
imports, then in their own file, and for Rust by a workspace-wide unique name (soft, confidence 0.6).
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.session import cut, partitions, ship

FALLBACK = 0.6
BARE = "bare:"  # leads a module name that is no relative path
ROWS = "path string, language string, what string, name string, kind string, target string, item string, sloc long"
_TS = re.compile(r"^(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function\*?|class|interface|type|enum|const|let|var)\s+([A-Za-z_$][\w$]*)", re.M)
_RS = re.compile(r"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+(?=fn))*(fn|struct|enum|trait|type|const|static|union|macro_rules!)\s+([A-Za-z_]\w*)", re.M)
_TYPES = {"class", "interface", "type", "enum", "struct", "trait", "union"}


def blank(source: str, rust: bool = False) -> str:
    """Comments and string contents as spaces; line ends stay."""
    out, i, n = list(source), 0, len(source)
    wipe = lambda a, z: out.__setitem__(slice(a, z), [c if c == "\n" else " " for c in source[a:z]])
    while i < n:
        two = source[i : i + 2]
        if two == "//":
            j = source.find("\n", i)
            j = n if j < 0 else j
            wipe(i, j)
        elif two == "/*":
            depth, j = 1, i + 2
            while j < n and depth:
                if source[j : j + 2] == "*/":
                    depth, j = depth - 1, j + 2
                elif rust and source[j : j + 2] == "/*":
                    depth, j = depth + 1, j + 2
                else:
                    j += 1
            wipe(i, j)
        elif source[i] == '"' or (not rust and source[i] in "'`"):
            q, j = source[i], i + 1
            while j < n and source[j] != q:
                j += 2 if source[j] == "\\" else 1
            j = min(n, j + 1)
            wipe(i + 1, j - 1)
        else:
            j = i + 1
        i = j
    return "".join(out)


def extent(text: str, at: int) -> int:
    """End of the declaration that starts at ``at``: its closing brace or semicolon at depth 0."""
    depth = 0
    for i in range(at, len(text)):
        c = text[i]
        if c in "{([":
            depth += 1
        elif c in "})]":
            depth -= 1
            if depth == 0 and c == "}":
                return i + 1
        elif c == ";" and depth == 0:
            return i + 1
        elif depth < 0:
            return i
    return len(text)


def parse(path: str, source: str) -> list[tuple]:
    rust = path.endswith(".rs")
    language = "rust" if rust else "typescript"
    text = blank(source, rust)
    rows: list[tuple] = []
    found: list[tuple[str, int, int, str]] = []
    at = 0
    for m in (_RS if rust else _TS).finditer(text):
        if m.start() < at or text[: m.start()].count("{") != text[: m.start()].count("}"):
            continue
        at = extent(text, m.start())
        found.append((m[2], m.start(), at, m[1]))
        sloc = sum(1 for line in text[m.start() : at].splitlines() if line.strip())
        rows.append((path, language, "declaration", m[2], "Type" if m[1] in _TYPES else "Symbol", None, None, sloc))
        if re.match(r"export|pub", text[m.start() : m.start() + 6]):
            rows.append((path, language, "public", m[2], None, None, None, 0))
    folder = posixpath.dirname(path)
    bound: dict[str, tuple[str, str]] = {}
    if rust:
        for m in re.finditer(r"^(pub\s+)?use\s+([^;]+);", text, re.M):
            for full in _use_tree(m[2].strip()):
                name, _, alias = full.partition(" as ")
                last = (alias or name.rpartition("::")[2]).strip()
                bound[last] = (name.rpartition("::")[0].strip(), name.rpartition("::")[2].strip())
                if m[1]:
                    rows.append((path, language, "re_export", last, None, bound[last][0], bound[last][1], 0))
    else:
        for m in re.finditer(r"^(import|export)\s+(?:type\s+)?(.*?)\s*from\s*['\"]", text, re.M | re.S):
            spec = re.match(r"[^'\"\n]*", source[m.end() :])[0]
            target = posixpath.normpath(posixpath.join(folder, spec)) if spec.startswith(".") else BARE + spec
            braces = re.search(r"\{(.*?)\}", m[2], re.S)
            for part in braces[1].split(",") if braces else ():
                name, _, alias = part.strip().removeprefix("type ").partition(" as ")
                if name.strip():
                    bound[(alias or name).strip()] = (target, name.strip())
                    if m[1] == "export":
                        rows.append((path, language, "re_export", (alias or name).strip(), None, target, name.strip(), 0))
            head = m[2].partition("{")[0].strip().rstrip(",")
            if head and not head.startswith("*"):
                bound[head] = (target, "default")
    declared = {n for n, *_ in found}
    for name, a, z, _ in found:
        body = text[a:z]
        seen: dict[tuple[str, str], None] = {}
        for m in re.finditer(r"([A-Za-z_$][\w$]*)\s*(\(?)", body):
            word = m[1]
            if word == name:
                continue
            before = body[max(0, m.start() - 12) : m.start()]
            kind = "Base" if re.search(r"(extends|implements)\s+$", before) else "Call" if m[2] else "Annotation" if re.search(r"[:<|&]\s*$", before) else "Ref"
            seen.setdefault((kind, word))
        for kind, word in seen:
            if word in bound:
                rows.append((path, language, "use", name, kind, *bound[word], 0))
            elif word in declared:
                rows.append((path, language, "use", name, kind, path, word, 0))
            elif rust and kind == "Call":
                rows.append((path, language, "guess", name, kind, None, word, 0))
    return rows


def _use_tree(text: str) -> list[str]:
    """Full paths of a use tree."""
    if "{" not in text:
        return [text]
    head, _, rest = text.partition("{")
    depth, part, out = 0, "", []
    for c in rest[: rest.rindex("}")] + ",":
        if c == "," and depth == 0:
            out += [head + x for x in _use_tree(part.strip())] if part.strip() else []
            part = ""
        else:
            depth += (c == "{") - (c == "}")
            part += c
    return out


def parse_files(files: DataFrame) -> DataFrame:
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ROWS.split(", ")]
        for f in frames:
            yield pd.DataFrame([r for p, s in zip(f["path"], f["contents"]) for r in parse(p, s)], columns=names)

    return files.mapInPandas(run, ROWS)


def resolve_typescript(target: F.Column) -> F.Column:
    """Files that a relative module may mean, in order of preference."""
    return F.array(*[F.concat(target, F.lit(x)) for x in (".ts", ".tsx", ".mts", "/index.ts", "/index.tsx", "")])


def module_maps(path: str, contents: str) -> list[tuple[int, str, str, str]]:
    """(step, scope, key, target) of one package.json or tsconfig.json: 1 subpath imports, 2 path aliases, 3 the package's own
    name. A trailing /* stands for anything; ``scope`` is the directory within which subpaths and aliases hold."""
    here = posixpath.dirname(path)
    try:
        found = json.loads(re.sub(r"^\s*//.*$", "", contents, flags=re.M))
    except ValueError:
        return []
    plain = lambda x: re.sub(r"/\*$", "", x)
    at = lambda base, x: posixpath.normpath(posixpath.join(here, base, plain(x)))
    if not isinstance(found, dict):
        return []
    if posixpath.basename(path) == "package.json":
        rows = [(1, here, plain(k), at("", v)) for k, v in (found.get("imports") or {}).items() if isinstance(v, str)]
        return rows + ([(3, "", found["name"], at("", "."))] if isinstance(found.get("name"), str) else [])
    options = found.get("compilerOptions") or {}
    return [(2, here, plain(k), at(options.get("baseUrl", "."), v[0])) for k, v in (options.get("paths") or {}).items() if v]


def mapped_targets(uses: DataFrame, maps: DataFrame) -> DataFrame:
    """Non-relative module names written as paths: the first step that knows them, then the longest key, then the deepest scope.

    uses(path, target), maps(step, scope, key, target): keys meet the leading parts of a name in an equi-join.
    """
    s = F.split(F.substr("target", F.lit(len(BARE) + 1)), "/")
    u = uses.filter(F.startswith(F.col("target"), F.lit(BARE))).select("path", "target").distinct().select("path", "target", F.explode(F.sequence(F.lit(1), F.size(s))).alias("k"))
    u = u.withColumn("key", F.array_join(F.slice(s, F.lit(1), F.col("k")), "/"))
    m = maps.select("step", "scope", "key", F.col("target").alias("base")).distinct()
    inside = (F.col("scope") == "") | F.startswith(F.col("path"), F.concat("scope", F.lit("/")))
    rest = F.array_join(F.slice(s, F.col("k") + 1, F.size(s)), "/")
    hit = u.join(m, "key").filter(inside).withColumn("mapped", F.regexp_replace(F.concat_ws("/", "base", F.when(rest != "", rest)), r"^\./", ""))
    return hit.groupBy("path", "target").agg(F.min_by("mapped", F.struct("step", -F.col("k"), -F.length("scope"), "base")).alias("mapped"))


def bind(rows: DataFrame, maps: DataFrame | None = None) -> dict[str, DataFrame]:
    """nodes and edges of the subset; ``maps`` (see mapped_targets) leads TypeScript's non-relative module names to files."""
    rows = cut(rows)
    if maps is not None:
        led = mapped_targets(rows.filter("language = 'typescript' and target is not null"), maps)
        rows = cut(rows.join(led, ["path", "target"], "left").withColumn("target", F.coalesce("mapped", "target")).select(*[c.split()[0] for c in ROWS.split(", ")]))
    d = rows.filter("what = 'declaration'").dropDuplicates(["path", "name"])
    order = Window.partitionBy("path").orderBy("name")
    counts = d.groupBy("path").agg(F.count("*").alias("k"))
    before = counts.select("path", (F.sum("k").over(Window.orderBy("path")) - F.col("k")).alias("before"))
    public = rows.filter("what = 'public'").select("path", "name", F.lit(True).alias("public_api")).distinct()
    test = F.col("path").rlike(r"(^|/)(__tests__|tests?|spec)/|\.(test|spec)\.")
    nodes = d.join(before, "path").withColumn("id", F.col("before") + F.row_number().over(order) - 1).join(public, ["path", "name"], "left")
    nodes = cut(nodes.select("id", "path", "language", "name", "kind", F.when(test, "TestCase").otherwise("Production").alias("polarity"), F.col("sloc").alias("effective_size"), F.coalesce("public_api", F.lit(False)).alias("public_api"), F.lit(False).alias("re_export")))
    at = nodes.select(F.col("path").alias("file"), F.col("name").alias("item"), F.col("id").alias("to"), F.col("kind").alias("to_kind"))
    own = nodes.select("path", "name", F.col("id").alias("source"))
    use = rows.filter("what = 'use'").join(own, ["path", "name"])
    local = use.withColumn("file", F.col("target")).join(at, ["file", "item"])
    stem = F.element_at(F.split("target", "::"), -1)
    possible = F.when(F.col("language") == "typescript", resolve_typescript(F.col("target"))).otherwise(F.array(F.concat(F.lit("/"), stem, F.lit(".rs"))))
    loose = use.join(local.select("path", "name", "kind", "target", "item").distinct(), ["path", "name", "kind", "target", "item"], "left_anti").withColumn("maybe", F.explode(possible))
    ts = loose.filter("language = 'typescript'").withColumn("file", F.col("maybe")).join(at, ["file", "item"])
    rust_at = at.withColumn("maybe", F.concat(F.lit("/"), F.element_at(F.split("file", "/"), -1)))
    rs = loose.filter("language = 'rust'").join(rust_at, ["maybe", "item"])
    keep = ["source", "to", "to_kind", "kind", "language"]
    hit = local.select(*keep).unionByName(ts.select(*keep)).unionByName(rs.select(*keep)).filter("source <> to").distinct()
    kind = F.when(F.col("kind") == "Base", "Inheritance").when(F.col("kind") == "Call", "Call").when(F.col("to_kind") == "Type", "TypeReference").otherwise("ValueImport")
    soft = (F.col("language") == "typescript") & (kind == "TypeReference")
    sure = hit.select("source", F.col("to").alias("target"), kind.alias("kind"), F.when(soft, "Soft").otherwise("Hard").alias("hardness"), F.lit(1.0).alias("confidence"))
    once = nodes.filter("language = 'rust'").groupBy(F.col("name").alias("item")).agg(F.count("*").alias("n"), F.min("id").alias("target")).filter("n = 1")
    guess = rows.filter("what = 'guess'").drop("target").join(own, ["path", "name"]).join(once, "item").filter("source <> target").select("source", "target", F.lit("Call").alias("kind"), F.lit("Soft").alias("hardness"), F.lit(FALLBACK).alias("confidence"))
    best = Window.partitionBy("source", "target", "kind").orderBy(F.when(F.col("hardness") == "Hard", 0).otherwise(1), F.desc("confidence"))
    edges = sure.unionByName(guess).withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k")
    return {"nodes": nodes, "edges": edges}


def companions(nodes: DataFrame) -> DataFrame:
    """(owner, companion): a type named like one function plus a signature suffix, if just one function fits."""
    # The suffixes.
    suffix = r"(Params|Options|Input|Output|Result|Context|State)$"
    lower = lambda c: F.lower(F.regexp_replace(c, "_", ""))
    t = nodes.filter((F.col("kind") == "Type") & F.col("name").rlike(suffix)).select(F.col("id").alias("companion"), lower(F.regexp_replace("name", suffix, "")).alias("key"))
    f = nodes.filter("kind = 'Symbol'").select(F.col("id").alias("owner"), lower(F.col("name")).alias("key"))
    one = f.groupBy("key").agg(F.count("*").alias("n"), F.min("owner").alias("owner")).filter("n = 1")
    return t.join(one, "key").select("owner", "companion", F.lit("companion-owner").alias("kind"))


def test_support_crates(members: DataFrame, uses: DataFrame) -> DataFrame:
    """(root,): crates that only support the tests of others: unpublished, a library without a program, and used by no
    other member outside its development dependencies. None if there are fewer than two members or all would be such.

    members(root, unpublished, has_lib, has_bin), uses(root, used, development).
    """
    used = uses.filter("not development").select(F.col("used").alias("root")).distinct()
    fit = members.filter("unpublished and has_lib and not has_bin").join(used, "root", "left_anti").select("root")
    counts = members.agg(F.count("*").alias("all")).join(F.broadcast(fit.agg(F.count("*").alias("some"))))
    return fit.join(F.broadcast(counts.filter("all >= 2 and some < all")), how="inner").select("root")


DEALS = 8


def advisory_uses(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(user, used, from_test): declarations that names in unloaded code may mean; true only while every source is test code.

    names(user, name, from_test), nodes(id, name, test_source).
    """
    # Each user and name is one row before the join, and a declaration has one name, so each pair comes once: the pairs, which can
    # be many times the rows that came in, are neither grouped nor shuffled. Few names may stand for nearly all rows, so each is
    # dealt out by user.
    user = nodes.select(F.col("id").alias("user"), "test_source")
    once = names.groupBy("user", "name").agg(F.bool_and("from_test").alias("from_test")).join(user, "user")
    said = once.select("user", "name", (F.col("from_test") | F.col("test_source")).alias("from_test"), F.pmod(F.xxhash64("user"), F.lit(DEALS)).cast("int").alias("deal"))
    used = nodes.filter("not test_source").select(F.col("id").alias("used"), "name").distinct().join(names.select("name").distinct(), "name", "left_semi")
    used = used.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    n = partitions(names.sparkSession)
    pairs = said.repartition(n, "name", "deal").join(used.repartition(n, "name", "deal"), ["name", "deal"])
    return pairs.filter("user <> used").select("user", "used", "from_test")
