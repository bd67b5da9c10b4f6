import pytest
from pyspark.sql import functions as F

from keelson import functions as K
from keelson.sources import discovery


def one(spark, expression, /, **cols):
    df = spark.createDataFrame([tuple(cols.values()) or (1,)], list(cols) or ["x"])
    return df.select(expression.alias("v")).first().v


@pytest.mark.parametrize(
    ("path", "want"),
    [("a/user-service.ts", ["service", "user"]), ("UserService.spec.ts", ["service", "spec", "user"]), ("JSONBlob.rs", ["jsonblob"]), ("v2Api.py", ["api", "v2"]), (".html", []), ("x/plain", ["plain"])],
)
def test_name_tokens(spark, path, want):
    assert one(spark, K.name_tokens(F.col("p")), p=path) == want


def test_search_tokens_drop_numbers(spark):
    assert one(spark, K.search_tokens(F.col("p")), p="src/fooBar_12-x.py") == ["bar", "foo", "py", "src", "x"]


def test_stem_segments_join(spark):
    assert one(spark, K.basename_stem(F.col("p")), p="a/b/foo2bar.test.ts") == "foo"
    assert one(spark, K.path_segments(F.col("p")), p="/a//b/") == ["a", "b"]
    assert one(spark, K.normalize_join(F.col("a"), F.col("b")), a="x/y", b="../z/./w") == "x/z/w"
    assert one(spark, K.real_key(F.col("p"), F.lit(True)), p="group/a/b") == ["a", "b"]


def test_namespace_round_trip(spark):
    ns = one(spark, K.physical_namespace(F.col("s"), F.col("p")), s="core/util", p="pkg/src/core/util")
    assert ns == "pkg/src"
    assert one(spark, K.physical_directory(F.col("n"), F.col("s")), n=ns, s="core/util") == "pkg/src/core/util"


def test_jaccard_and_prefix(spark):
    assert one(spark, K.jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)
    assert one(spark, K.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0
    assert one(spark, K.common_prefix_length(F.col("a"), F.col("b")), a=["x", "y", "z"], b=["x", "y"]) == 2


def test_prices_and_severity(spark):
    assert one(spark, K.edge_weight(F.col("k"), F.col("c")), k="Inheritance", c=0.5) == 0.75
    assert one(spark, K.edge_weight(F.col("k"), F.col("c")), k="ReExport", c=1.0) == 0.0
    assert [one(spark, K.severity(F.lit(m), F.lit(600.0))) for m in (600, 601, 660, 661)] == [None, "Borderline", "Borderline", "Violation"]
    assert one(spark, K.normalized_overage(F.lit(5), F.lit(0))) == 5.0
    assert one(spark, K.height_penalty(F.lit("Package"))) == 8.0


@pytest.mark.parametrize(("glob", "path", "hit"), [("*.py", "a/b.py", True), ("src/**/x.ts", "src/x.ts", True), ("src/**/x.ts", "src/a/b/x.ts", True), ("a?.rs", "ab.rs", True), ("a[!b].rs", "ab.rs", False), ("{a,b}.py", "b.py", True), ("*.py", "a.pyi", False)])
def test_globs(glob, path, hit):
    assert bool(discovery.compile_globs([glob])[0].match(path)) == hit


def test_languages(spark):
    assert [one(spark, K.matches_language(F.lit(p))) for p in ("a.tsx", "b.rs", "c.pyi", "d.js")] == ["typescript", "rust", "python", None]
    assert one(spark, K.manifest_dir(F.lit("a/b/Cargo.toml"))) == "a/b" and one(spark, K.manifest_dir(F.lit("setup.py"))) == ""
