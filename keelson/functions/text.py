"""Names, tokens and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File names and extensions.
MANIFESTS = ("package.json", "Cargo.toml", "pyproject.toml", "setup.py")
EXTENSIONS = {"typescript": ("ts", "tsx", "mts", "cts"), "rust": ("rs",), "python": ("py", "pyi")}


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _humps(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", " ")


def name_tokens(path: Column) -> Column:
    """Sorted set of lower-case word parts of a file's base name without its last extension."""
    stem = F.regexp_replace(basename(path), r"\.[^.]*$", "")
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(_humps(stem)), r"[^\p{L}\p{N}]+"), lambda t: t != "")))


def search_tokens(text: Column) -> Column:
    """Sorted set of parts between / _ - . and humps, without plain numbers."""
    parts = F.split(F.lower(_humps(text)), r"[/_\-. ]+")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: (t != "") & ~t.rlike(r"^[0-9]+$"))))


def basename_stem(path: Column) -> Column:
    """Leading ASCII letters of the base name before its first dot."""
    return F.regexp_extract(F.element_at(F.split(basename(path), r"\."), 1), r"^[A-Za-z]+", 0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def common_prefix_length(a: Column, b: Column) -> Column:
    """Number of equal leading elements."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(True).alias("go"), F.lit(0).alias("n")), lambda s, e: F.struct((s["go"] & e).alias("go"), (s["n"] + F.when(s["go"] & e, 1).otherwise(0)).alias("n")))["n"]


def physical_namespace(scope: Column, physical: Column) -> Column:
    """What a physical path has before its longest common trailing run with the scope path."""
    a, b = F.reverse(path_segments(scope)), F.reverse(path_segments(physical))
    own = path_segments(physical)
    return F.array_join(F.slice(own, F.lit(1), F.size(own) - common_prefix_length(a, b)), "/")


def physical_directory(namespace: Column, scope: Column) -> Column:
    """Inverse of physical_namespace."""
    return F.array_join(F.concat(path_segments(namespace), path_segments(scope)), "/")


def real_key(path: Column, label_keyed: Column) -> Column:
    """Segments without the group label that label-keyed containers lead with."""
    s = path_segments(path)
    return F.when(label_keyed & (F.size(s) > 0), F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s)


def normalize_join(base: Column, relative: Column) -> Column:
    """``relative`` seen from directory ``base``, with . and .. resolved."""
    parts = F.concat(path_segments(base), path_segments(relative))
    walk = lambda s, p: F.when(p == ".", s).when(p == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), walk), "/")


def glob_to_regex(glob: str) -> str:
    """A path glob as an anchored regular expression; * and ** both cross slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while glob[i : i + 1] == "*":
                i += 1
            if glob[i : i + 1] == "/" and out.endswith("/") or (glob[i : i + 1] == "/" and not out):
                out += "(?:.*/)?"
                i += 1
            else:
                out += ".*"
            continue
        if c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end].replace("\\", r"\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = end
        elif c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out += "(?:" + "|".join(glob_to_regex(x)[1:-1] for x in glob[i + 1 : end].split(",")) + ")"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def mirror_regex(template: str) -> str:
    """A {dir}/{stem} template as a regular expression with named groups."""
    out = re.escape(template).replace(r"\{dir\}", r"(?<dir>.*)").replace(r"\{stem\}", r"(?<stem>[^/]+)")
    return f"^{out}$"


def manifest_dir(path: Column) -> Column:
    """The directory that a manifest file makes a package root, else null."""
    return F.when(basename(path).isin(*MANIFESTS), F.regexp_replace(path, r"/?[^/]*$", ""))


def module_root(path: Column) -> Column:
    """Does the file stand for its directory?"""
    name = basename(path)
    # Names of such files.
    return name.isin("lib.rs", "main.rs", "mod.rs", "__init__.py", "__init__.pyi", "__main__.py") | name.rlike(r"^index\.[mc]?tsx?$")


def matches_language(path: Column) -> Column:
    """Language that claims the file's extension, else null."""
    ext = F.regexp_extract(basename(path), r"\.([^.]+)$", 1)
    out = F.lit(None).cast("string")
    for name, some in EXTENSIONS.items():
        out = F.when(ext.isin(*some), name).otherwise(out)
    return out
