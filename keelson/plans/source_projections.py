"""Ordinary tables written out as source files, so that extraction runs on whole tables.

Each customer is a Python, a TypeScript and a Rust file; hand-overs to other customers are imports, calls, references,
annotations and bases by a fixed rule, ``(src + dst) % 4``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.plans.projections import Tables


def _places(t: Tables) -> DataFrame:
    """(c, n, module, path, fname): a customer's Python module; every seventh is a test, every fifth name private."""
    c = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey").cast("string")
    test = F.when(F.col("c_custkey") % 7 == 0, "tests/").otherwise("")
    path = F.concat(test, F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/n"), F.col("c_nationkey").cast("string"), F.lit("/c"), k)
    return c.select(
        F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n"), F.col("n_regionkey").alias("r"), F.concat(path, F.lit(".py")).alias("path"), F.replace(path, F.lit("/"), F.lit(".")).alias("module"),
        F.concat(F.when(F.col("c_custkey") % 5 == 0, "_f").otherwise("f"), k).alias("fname"),
    )


def _first_of_nation(t: Tables) -> DataFrame:
    """(n, least): the customer whose function the nation's package passes on."""
    return _places(t).filter("c % 7 <> 0").groupBy("n").agg(F.min("c").alias("least"))


def _uses(t: Tables, places: DataFrame) -> DataFrame:
    """Per customer the sorted array ``to`` of what it is handed to: (dst, kind, module, fname, n)."""
    least = _first_of_nation(t)
    dst = places.join(least, "n").select(F.col("c").alias("dst"), "n", "r", "fname", "module", (F.col("c") == F.col("least")).alias("first"))
    e = t.handover.select("src", "dst", ((F.col("src") + F.col("dst")) % 4).alias("kind")).join(dst, "dst")
    package = F.concat(F.lit("r"), F.col("r").cast("string"), F.lit(".n"), F.col("n").cast("string"))
    module = F.when((F.col("kind") == 0) & F.col("first"), package).otherwise(F.col("module"))
    return e.groupBy(F.col("src").alias("c")).agg(F.array_sort(F.collect_list(F.struct("dst", "kind", module.alias("module"), "fname", "n"))).alias("to"))


def _lines(to: Column, kind: int | None, line) -> Column:
    some = to if kind is None else F.filter(to, lambda x: x["kind"] == kind)
    return F.array_join(F.transform(some, line), "")


def python_files(t: Tables) -> DataFrame:
    """(path, contents)."""
    p = _places(t)
    j = p.join(_uses(t, p), "c", "left").withColumn("to", F.coalesce("to", F.array().cast("array<struct<dst:bigint,kind:bigint,module:string,fname:string,n:bigint>>")))
    num = lambda x: x["dst"].cast("string")
    item = lambda x: F.when(x["kind"] >= 2, F.concat(F.lit("T"), num(x))).otherwise(x["fname"])
    k, to = F.col("c").cast("string"), F.col("to")
    bases = F.array_join(F.transform(F.filter(to, lambda x: x["kind"] == 3), lambda x: F.concat(F.lit("T"), num(x))), ", ")
    text = F.concat(
        F.lit('"""Customer '), k, F.lit('."""\n'), _lines(to, None, lambda x: F.concat(F.lit("from "), x["module"], F.lit(" import "), item(x), F.lit("\n"))), F.lit("\n# bases\nclass T"), k,
        F.when(bases != "", F.concat(F.lit("("), bases, F.lit(")"))).otherwise(""), F.lit(':\n    """A doc.\n    Two lines."""\n\n    size = '), k, F.lit("\n\n\ndef "), F.col("fname"), F.lit("(a: int = 0):\n    # uses\n"),
        _lines(to, 2, lambda x: F.concat(F.lit("    v"), num(x), F.lit(": T"), num(x), F.lit(" = None\n"))),
        _lines(to, 0, lambda x: F.concat(F.lit("    "), x["fname"], F.lit("()\n"))),
        _lines(to, 1, lambda x: F.concat(F.lit("    r"), num(x), F.lit(" = "), x["fname"], F.lit("\n"))), F.lit("    return a\n"),
    )
    inits = p.join(_first_of_nation(t), "n").filter("c = least").select(F.regexp_replace("path", r"[^/]+$", "__init__.py").alias("path"), F.concat(F.lit("from .c"), k, F.lit(" import "), F.col("fname"), F.lit("\n")).alias("contents"))
    return j.select("path", text.alias("contents")).unionByName(inits)


def typescript_files(t: Tables) -> DataFrame:
    """(path, contents): calls of kind 0 and annotations of kind 2. Modules of other nations are imported by a relative
    path if the sum of both numbers is divisible by 3, through the alias ``@app`` if it leaves 1, else by package name."""
    p = _places(t)
    j = p.join(_uses(t, p), "c", "left").withColumn("to", F.coalesce(F.filter("to", lambda x: x["kind"] % 2 == 0), F.array().cast("array<struct<dst:bigint,kind:bigint,module:string,fname:string,n:bigint>>")))
    k, to, num = F.col("c").cast("string"), F.col("to"), lambda x: x["dst"].cast("string")
    name = lambda x: F.concat(F.lit("c"), num(x), F.when(x["kind"] == 2, "Params").otherwise(""))
    way = lambda x: F.when((F.col("c") + x["dst"]) % 3 == 0, "../").when((F.col("c") + x["dst"]) % 3 == 1, "@app/").otherwise("shop/")
    text = F.concat(
        _lines(to, None, lambda x: F.concat(F.lit("import { "), name(x), F.lit(' } from "'), way(x), F.lit("n"), x["n"].cast("string"), F.lit("/c"), num(x), F.lit('";\n'))),
        F.lit("// types\nexport interface c"), k, F.lit("Params {\n  a: number;\n}\n\nexport function c"), k, F.lit("(): void {\n"),
        _lines(to, 0, lambda x: F.concat(F.lit("  "), name(x), F.lit("();\n"))), _lines(to, 2, lambda x: F.concat(F.lit("  let v"), num(x), F.lit(": "), name(x), F.lit(";\n"))), F.lit("}\n"),
    )
    return j.select(F.concat(F.lit("web/n"), F.col("n").cast("string"), F.lit("/c"), k, F.lit(".ts")).alias("path"), text.alias("contents"))


def rust_files(t: Tables) -> DataFrame:
    """(path, contents): calls of kind 0 through ``use``, calls of kind 1 without, to be found by name alone."""
    p = _places(t)
    j = p.join(_uses(t, p), "c", "left").withColumn("to", F.coalesce(F.filter("to", lambda x: x["kind"] < 2), F.array().cast("array<struct<dst:bigint,kind:bigint,module:string,fname:string,n:bigint>>")))
    k, to, num = F.col("c").cast("string"), F.col("to"), lambda x: x["dst"].cast("string")
    text = F.concat(
        _lines(to, 0, lambda x: F.concat(F.lit("use crate::n"), x["n"].cast("string"), F.lit("::c"), num(x), F.lit("::f"), num(x), F.lit(";\n"))), F.lit("\n/* one */\npub fn f"), k, F.lit("() {\n"),
        _lines(to, None, lambda x: F.concat(F.lit("    f"), num(x), F.lit("();\n"))), F.lit("}\n\npub struct S"), k, F.lit(" {\n    a: u8,\n}\n"),
    )
    return j.select(F.concat(F.lit("rs/n"), F.col("n").cast("string"), F.lit("/c"), k, F.lit(".rs")).alias("path"), text.alias("contents"))
