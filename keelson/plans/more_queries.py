"""Further registered queries: text functions, extraction, normalisation, search bookkeeping, advice and invariants of solvers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson import functions as K
from keelson import model
from keelson.functions import text as X
from keelson.operators import advice, cluster, findings, graph, moves, partition
from keelson.plans import source_projections as P
from keelson.plans.catalogue import _customer_edges, _file_rows, _r, _sql, query
from keelson.plans.projections import Tables
from keelson.session import cut
from keelson.sources import brace_source, python_source

# --- text functions ------------------------------------------------------------------------------

_DIR = "regexp_replace(path, '/?[^/]*$', '')"


@query(_sql("select page_id, regexp_extract(string_split(string_split(path, '/')[-1], '.')[1], '^[A-Za-z]+') as stem from (select page_id, 'x/page' || case when page_id % 3 = 0 then '' else 'B' end || page_id || '.test.ts' as path from pages)"))
def basename_stems(t: Tables) -> DataFrame:
    path = F.concat(F.lit("x/page"), F.when(F.col("page_id") % 3 == 0, "").otherwise("B"), F.col("page_id").cast("string"), F.lit(".test.ts"))
    return t["pages"].select("page_id", X.basename_stem(path).alias("stem"))


@query(_sql("select distinct path source, 'tests/' || regexp_extract(path, '^(.*)/([^/]+)\\.html$', 1) || '/test_' || regexp_extract(path, '^(.*)/([^/]+)\\.html$', 2) || '.html' test from pf where regexp_matches(path, '^(.*)/([^/]+)\\.html$')", "pf"))
def mirror_templates(t: Tables) -> DataFrame:
    return moves.mirror_candidates(t.page_files, "{dir}/{stem}.html", "tests/{dir}/test_{stem}.html").distinct()


_NS = """select page_id, string_split(path, '/')[1] host, string_split(path, '/')[2] lang, case page_id % 3 when 0 then string_split(path, '/')[2] when 1 then 'x/' || string_split(path, '/')[2] else 'zzz' end scope from pf"""


@query(_sql("select page_id, case when scope = 'zzz' then host || '/' || lang else host end as namespace, case when scope = 'zzz' then host || '/' || lang else host end || '/' || scope as directory from ns", "pf", ns=_NS))
def physical_places(t: Tables) -> DataFrame:
    s = K.path_segments(F.col("path"))
    lang = F.element_at(s, 2)
    scope = F.when(F.col("page_id") % 3 == 0, lang).when(F.col("page_id") % 3 == 1, F.concat(F.lit("x/"), lang)).otherwise("zzz")
    d = t.page_files.select("page_id", scope.alias("scope"), F.array_join(F.slice(s, 1, 2), "/").alias("physical")).withColumn("namespace", X.physical_namespace(F.col("scope"), F.col("physical")))
    return d.select("page_id", "namespace", X.physical_directory(F.col("namespace"), F.col("scope")).alias("directory"))


@query(_sql("select a.page_id, len(list_filter(range(1, least(len(a.s), len(b.s)) + 1), lambda i: a.s[1:i] = b.s[1:i]))::int n from seg a join seg b on b.page_id = (a.page_id // 2)", "pf",
            seg="select page_id, list_filter(string_split(path, '/'), lambda x: x <> '') s from pf"))
def common_prefixes(t: Tables) -> DataFrame:
    """Leading segments that each page has in common with the one at half its number."""
    s = t.page_files.select("page_id", K.path_segments(F.col("path")).alias("s"))
    b = s.select(F.col("page_id").alias("half"), F.col("s").alias("o"))
    return s.withColumn("half", F.floor(F.col("page_id") / 2).cast("long")).join(b, "half").select("page_id", K.common_prefix_length(F.col("s"), F.col("o")).alias("n"))


@query(_sql("select page_id, case page_id % 4 when 0 then host || '/x' when 1 then host || '/' || lang || '/y' when 2 then 'z' else host || '/' || lang || '/r' end as path from ns", "pf", ns=_NS))
def joined_paths(t: Tables) -> DataFrame:
    base = F.array_join(F.slice(K.path_segments(F.col("path")), 1, 2), "/")
    k = F.col("page_id") % 4
    rel = F.when(k == 0, "../x").when(k == 1, "./y").when(k == 2, "../../z").otherwise("q/../r")
    return t.page_files.select("page_id", X.normalize_join(base, rel).alias("path"))


@query(_sql("select page_id, array_to_string(case when page_id % 2 = 1 then s[2:] else s end, '/') as key from (select page_id, list_filter(string_split(path, '/'), lambda x: x <> '') s from pf)", "pf"))
def real_keys(t: Tables) -> DataFrame:
    return t.page_files.select("page_id", F.array_join(X.real_key(F.col("path"), F.col("page_id") % 2 == 1), "/").alias("key"))


@query(_sql("select page_id, regexp_matches(path, '^(.*/)?en/.*\\.html$') deep, path like '%.example.com/%' host, regexp_matches(path, '^(m|blog)\\..*$') either, regexp_matches(path, '^[a-m].*$') ranged from pf", "pf"))
def glob_matches(t: Tables) -> DataFrame:
    globs = {"deep": "**/en/*.html", "host": "*.example.com/*", "either": "{m,blog}.*", "ranged": "[a-m]*"}
    return t.page_files.select("page_id", *[F.col("path").rlike(X.glob_to_regex(g)).alias(k) for k, g in globs.items()])


_NAMED = "select page_id, regexp_replace(path, '/[^/]*$', '') || '/' || ['package.json', 'Cargo.toml', 'pyproject.toml', 'setup.py', 'index.ts', '__init__.py', 'a.tsx', 'b.pyi', 'mod.rs', 'c.txt', 'conftest.py', '__main__.py'][1 + page_id % 12] as path from pf"
_NAMES = ("package.json", "Cargo.toml", "pyproject.toml", "setup.py", "index.ts", "__init__.py", "a.tsx", "b.pyi", "mod.rs", "c.txt", "conftest.py", "__main__.py")


def _named(t: Tables) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(x) for x in _NAMES]), (F.col("page_id") % len(_NAMES) + 1).cast("int"))
    return t.page_files.select("page_id", F.concat(F.regexp_replace("path", r"/[^/]*$", ""), F.lit("/"), name).alias("path"))


@query(_sql("select distinct regexp_replace(path, '/[^/]*$', '') root from nm where page_id % 12 < 4", "pf", nm=_NAMED))
def package_roots(t: Tables) -> DataFrame:
    return _named(t).select(X.manifest_dir(F.col("path")).alias("root")).filter("root is not null").distinct()


@query(_sql("select page_id, case page_id % 12 when 4 then 'typescript' when 6 then 'typescript' when 8 then 'rust' when 1 then null when 0 then null when 2 then null when 9 then null else 'python' end as language, page_id % 12 in (4, 5, 8, 11) module_root, page_id % 12 in (3, 11) entry from nm", "pf", nm=_NAMED))
def file_languages(t: Tables) -> DataFrame:
    """Language, whether the file stands for its directory, and whether something outside starts it."""
    n = _named(t)
    entry = python_source.entry_facts(n.select(F.col("path"))).select(F.col("file").alias("path"), F.lit(True).alias("entry")).distinct()
    return n.join(entry, "path", "left").select("page_id", X.matches_language(F.col("path")).alias("language"), X.module_root(F.col("path")).alias("module_root"), F.coalesce("entry", F.lit(False)).alias("entry"))


@query(_sql("select page_id, page_id % 5 in (0, 1, 3) builtin from pages"))
def builtin_test_paths(t: Tables) -> DataFrame:
    k = F.col("page_id") % 5
    path = F.when(k == 0, "a/tests/b.ts").when(k == 1, "a/b.spec.ts").when(k == 2, "a/spec.d/b.ts").when(k == 3, "test/x.rs").otherwise("a/testing.ts")
    return t["pages"].select("page_id", findings.builtin_test_path(path).alias("builtin"))


@query(_sql("select page_id, path as shown from pf", "pf"))
def stripped_groups(t: Tables) -> DataFrame:
    p = t.page_files.select("page_id", F.concat(F.lit("web.x/"), "path").alias("path"))
    return moves.strip_group(p, "web.x").select("page_id", F.col("path").alias("shown"))


# --- extraction ----------------------------------------------------------------------------------

_CU = dict(
    cu="""select c_custkey c, c_nationkey n, 'f' pre, case when c_custkey % 7 = 0 then 'tests/' else '' end || 'r' || n_regionkey || '/n' || c_nationkey || '/c' || c_custkey || '.py' as path, 'r' || n_regionkey || '/n' || c_nationkey || '/__init__.py' init,
    case when c_custkey % 5 = 0 then '_f' else 'f' end || c_custkey fname from customer join nation on c_nationkey = n_nationkey""",
    le="select n, min(c) least from cu where c % 7 <> 0 group by 1",
    us="select src, dst, (src + dst) % 4 kind from he",
    cnt="select src, count(*) filter (where kind < 3) k from us group by 1",
)


@query(_sql("""select path, 'T' || c as name, 'Type' kind, case when c % 7 = 0 then 'TestCase' else 'Production' end polarity, 2::bigint effective_size, false re_export, true public_api from cu
union all select path, fname, 'Symbol', case when c % 7 = 0 then 'TestCase' else 'Production' end, 2 + coalesce(k, 0), false, c % 5 <> 0 from cu left join cnt on c = src
union all select init, fname, 'Symbol', 'Production', 0, true, c % 5 <> 0 from cu join le on cu.c = le.least""", "he", **_CU))
def python_nodes(t: Tables) -> DataFrame:
    """Parse, name, size (code lines without docstrings and comments), polarity and publicity of whole Python files."""
    got = python_source.bind(python_source.parse_files(P.python_files(t)))
    return got["nodes"].select("path", "name", "kind", "polarity", "effective_size", "re_export", "public_api")


@query(_sql("""select a.path source_path, case when kind = 3 then 'T' || src else a.fname end as source, case when kind = 0 and b.c = le.least then b.init else b.path end target_path, case when kind >= 2 then 'T' || dst else b.fname end as target,
['Call', 'ValueImport', 'TypeReference', 'Inheritance'][kind + 1] kind, case kind when 2 then 'Soft' else 'Hard' end hardness, 1.0::double confidence from us join cu a on src = a.c join cu b on dst = b.c join le on b.n = le.n
union all select init, fname, path, fname, 'ReExport', 'Soft', 1.0 from cu join le on cu.c = le.least""", "he", **_CU))
def python_edges(t: Tables) -> DataFrame:
    """Name resolution and edge emission over whole Python files, re-exports of packages included."""
    got = python_source.bind(python_source.parse_files(P.python_files(t)))
    n = got["nodes"].select("id", "path", "name")
    a, b = (n.select(F.col("id").alias(x), F.col("path").alias(f"{x}_path"), F.col("name").alias(f"{x}_name")) for x in ("source", "target"))
    return got["edges"].join(a, "source").join(b, "target").select("source_path", F.col("source_name").alias("source"), "target_path", F.col("target_name").alias("target"), "kind", "hardness", "confidence")


def _named_edges(got: dict[str, DataFrame]) -> DataFrame:
    n = got["nodes"].select("id", "name")
    a, b = (n.select(F.col("id").alias(x), F.col("name").alias(f"{x}_name")) for x in ("source", "target"))
    return got["edges"].join(a, "source").join(b, "target").select(F.col("source_name").alias("source"), F.col("target_name").alias("target"), "kind", "hardness", "confidence")


@query(_sql("""select 'c' || src as source, 'c' || dst || case when kind = 2 then 'Params' else '' end as target, case when kind = 2 then 'TypeReference' else 'Call' end kind, case when kind = 2 then 'Soft' else 'Hard' end hardness, 1.0::double confidence from us where kind % 2 = 0""", "he", **_CU))
def typescript_edges(t: Tables) -> DataFrame:
    """Names led to files through relative paths, a path alias and the package's own name."""
    manifests = [("web/package.json", '{"name": "shop"}'), ("web/tsconfig.json", '{"compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["./*"]}}}')]
    maps = t.spark.createDataFrame([r for m in manifests for r in brace_source.module_maps(*m)], "step int, scope string, key string, target string")
    return _named_edges(brace_source.bind(brace_source.parse_files(P.typescript_files(t)), maps))


@query(_sql("select 'c' || c as owner, 'c' || c || 'Params' as companion from cu", **_CU))
def typescript_companions(t: Tables) -> DataFrame:
    got = brace_source.bind(brace_source.parse_files(P.typescript_files(t)))["nodes"]
    n = got.select("id", "name")
    j = brace_source.companions(got).join(n.select(F.col("id").alias("owner"), F.col("name").alias("o")), "owner").join(n.select(F.col("id").alias("companion"), F.col("name").alias("c")), "companion")
    return j.select(F.col("o").alias("owner"), F.col("c").alias("companion"))


@query(_sql("select 'f' || src as source, 'f' || dst as target, 'Call' kind, case kind when 0 then 'Hard' else 'Soft' end hardness, case kind when 0 then 1.0 else 0.6 end::double confidence from us where kind < 2", "he", **_CU))
def rust_edges(t: Tables) -> DataFrame:
    """Calls through ``use`` are hard; calls found by a name that is unique in the workspace are soft."""
    return _named_edges(brace_source.bind(brace_source.parse_files(P.rust_files(t))))


@query("""with m as (select s_suppkey root, s_suppkey % 3 = 0 unpublished, s_suppkey % 2 = 0 lib, s_suppkey % 10 = 0 bin from supplier),
u as (select distinct o_custkey % 13 used, o_orderstatus = 'O' development from orders)
select root from m where unpublished and lib and not bin and root not in (select used from u where not development)""")
def support_crates(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    members = t["supplier"].select(k.alias("root"), (k % 3 == 0).alias("unpublished"), (k % 2 == 0).alias("has_lib"), (k % 10 == 0).alias("has_bin"))
    uses = t["orders"].select((F.col("o_custkey") % 100).alias("root"), (F.col("o_custkey") % 13).alias("used"), (F.col("o_orderstatus") == "O").alias("development")).distinct()
    return brace_source.test_support_crates(members, uses)


@query(_sql("""select "user", used, from_test or u.test_source from_test from (select o_custkey "user", n.id used, bool_and(o_orderstatus = 'P') from_test from orders join nodes n on n.name = 'p' || o_custkey % 50 where not n.test_source and o_custkey <> n.id group by 1, 2) h join nodes u on u.id = h."user" """,
            nodes="select c_custkey id, 'p' || c_custkey % 400 as name, c_nationkey % 3 = 0 test_source from customer"))
def advisory_names(t: Tables) -> DataFrame:
    nodes = t["customer"].select(F.col("c_custkey").alias("id"), F.concat(F.lit("p"), (F.col("c_custkey") % 400).cast("string")).alias("name"), (F.col("c_nationkey") % 3 == 0).alias("test_source"))
    names = t["orders"].select(F.col("o_custkey").alias("user"), F.concat(F.lit("p"), (F.col("o_custkey") % 50).cast("string")).alias("name"), (F.col("o_orderstatus") == "P").alias("from_test"))
    return brace_source.advisory_uses(names, nodes)


@query(_sql("select id + case when polarity = 'Production' then 0 else (select max(id) + 1 from onode where polarity = 'Production') end id, 'n' || (container // 8) % 25 || '/c' || container || '.py' as path, 'File' as level from onode", "onode"))
def merged_nodes(t: Tables) -> DataFrame:
    """Production and test orders as two fragments put into one snapshot, with one new tree over their files."""
    path = F.concat(F.lit("n"), (F.floor(F.col("container") / 8) % 25).cast("string"), F.lit("/c"), F.col("container").cast("string"), F.lit(".py"))
    n = t.org_nodes.withColumn("path", path)
    parts = [{"nodes": n.filter("polarity = 'Production'")}, {"nodes": n.filter("polarity <> 'Production'")}]
    got = model.merge_fragments(t.spark, parts, "root", t.spark.createDataFrame([], "root string"))
    tree = got["containers"].select(F.col("id").alias("container"), "level", F.col("name").alias("file"))
    return got["nodes"].join(tree, "container").filter("file = path").select("id", "path", "level")


@query("""with r(rung, s) as (values (0, 1), (1, 3), (2, 5), (3, 7), (4, 7)), g as (select s, max(rung) rung, min(rung) first from r group by 1),
f as (select c_custkey node, g.rung, row_number() over (partition by c_custkey order by first) k, c_custkey % 6 declared from customer, g where s > c_custkey % 9)
select node, rung::bigint rung, 'rung' || rung as spelling from f where k = 1 and rung < declared""")
def ladder_verdicts(t: Tables) -> DataFrame:
    """Customers with five rungs of 1, 3, 5, 7 and 7 files, used in as many files as their number leaves from nine."""
    c = t["customer"].select(F.col("c_custkey").alias("node"), (F.col("c_custkey") % 6).alias("declared_rung"))
    sizes = F.array(*[F.struct(F.lit(k).cast("long").alias("rung"), F.lit(n).alias("n")) for k, n in enumerate((1, 3, 5, 7, 7))])
    rungs = c.select("node", "declared_rung", F.explode(sizes).alias("x")).select("node", "declared_rung", "x.rung", F.sequence(F.lit(0), F.col("x.n") - 1).alias("files"), F.concat(F.lit("rung"), F.col("x.rung").cast("string")).alias("spelling"))
    foot = c.select("node", F.sequence(F.lit(0), (F.col("node") % 9).cast("int")).alias("files"))
    return findings.ladder_verdicts(rungs, foot)


# --- graph ---------------------------------------------------------------------------------------


@query(_sql("""select case when a.container <> b.container then 1.0 when a.kind = 'Type' or b.kind = 'Type' then 3.0 else 1.0 end affinity, a.container = b.container same_file, count(*) edges from oedge join onode a on source = a.id join onode b on target = b.id group by 1, 2""", "oedge", "onode"))
def same_file_affinities(t: Tables) -> DataFrame:
    n = t.org_nodes.select("id", "kind", "container")
    a, b = n.toDF("source", "ka", "fa"), n.toDF("target", "kb", "fb")
    j = t.org_edges.select("source", "target").join(a, "source").join(b, "target")
    return j.groupBy(findings.same_file_affinity("fa", "fb", "ka", "kb").alias("affinity"), (F.col("fa") == F.col("fb")).alias("same_file")).agg(F.count("*").alias("edges"))


@query("""with recursive ev_s as (select event_type s, lead(event_type) over (partition by user_id order by ts, event_id) t from events),
ev as (select s, t, count(*) * 1.0 * case when (s in ('click', 'error')) = (t in ('click', 'error')) then 3.0 else 1.0 end weight, (s in ('click', 'error')) <> (t in ('click', 'error')) crossing from ev_s where t is not null and s <> t group by 1, 2),
v as (select distinct event_type x from events),
p as (select [a.x, b.x, c.x, d.x, e.x] o from v a, v b, v c, v d, v e where a.x <> b.x and a.x <> c.x and a.x <> d.x and a.x <> e.x and b.x <> c.x and b.x <> d.x and b.x <> e.x and c.x <> d.x and c.x <> e.x and d.x <> e.x)
select min(w)::double weight, true as exact from (select o, sum(weight) w from p, ev where list_position(o, s) > list_position(o, t) group by 1)""")
def solved_cycles(t: Tables) -> DataFrame:
    """Cheapest breaks among event types in two files, all of them types, so that ties within a file cost threefold."""
    rank = lambda c: F.array_position(F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")]), F.col(c)).cast("long")
    e = cut(t.event_graph.select(rank("s").alias("source"), rank("t").alias("target"), F.lit("Call").alias("kind"), F.lit("Hard").alias("hardness"), F.col("weight").alias("confidence")))
    nodes = t.spark.createDataFrame([(k, "Type") for k in range(1, 6)], "id long, kind string")
    home = nodes.select(F.col("id").alias("node"), F.when(F.col("id") <= 2, "a").otherwise("b").alias("file"))
    m = graph.condense(e.select(F.col("source").alias("src"), F.col("target").alias("dst")))
    return findings.solved_cycles(e, m, home, nodes).agg(F.sum("weight").alias("weight"), F.bool_and("exact").alias("exact"))


_INV = "select count(*) filter (where k > 1) cyclic, coalesce(sum(k) filter (where k > 1), 0)::bigint members, true inside, true acyclic from (select scc, count(*) k from hm group by 1)"


def _break_invariants(t: Tables, **budget) -> DataFrame:
    """One row: cyclic components, their members, whether all breaks lie in them, and whether none is left without the breaks."""
    e = cut(t.handover)
    m = cut(graph.condense(e))
    breaks = cut(graph.shatter(e, m, **budget))
    big = m.groupBy("scc").agg(F.count("*").alias("k")).filter("k > 1")
    a, b = m.toDF("src", "sa"), m.toDF("dst", "sb")
    # No cycle leaves its component, so what joins two of them need not be looked at again.
    left = graph.condense(e.join(a, "src").join(b, "dst").filter("sa = sb").select("src", "dst").join(breaks.select("src", "dst"), ["src", "dst"], "left_anti"))
    outside = breaks.join(a, "src").join(b, "dst").filter("sa <> sb or sa <> scc").agg((F.count("*") == 0).alias("inside"))
    still = left.groupBy("scc").agg(F.count("*").alias("k")).agg(F.coalesce(F.max("k") <= 1, F.lit(True)).alias("acyclic"))
    return big.agg(F.count("*").alias("cyclic"), F.coalesce(F.sum("k"), F.lit(0)).alias("members")).join(F.broadcast(outside)).join(F.broadcast(still))


@query(_sql(_INV, "hm"))
def mfas_breaks(t: Tables) -> DataFrame:
    """Breaks of the customer graph's cyclic components, under the production budgets."""
    return _break_invariants(t)


@query(_sql(_INV, "hm"))
def mfas_heuristic_valid(t: Tables) -> DataFrame:
    """The heuristic alone."""
    return _break_invariants(t, exact_vertices=0, seconds=0.0)


def _folder_graph(t: Tables) -> tuple[list[int], list[tuple[int, int, float]]]:
    """The acyclic part, lower to higher number, of the quotient over folders; at most nations times segments of them."""
    home = t.customers.select(F.col("file").alias("node"), F.col("folder").alias("scc"))
    rows = [(r["src"], r["dst"], r["weight"]) for r in graph.quotient(_customer_edges(t), home).filter("src < dst").collect()]
    ids = sorted({v for r in rows for v in r[:2]})
    at = {v: i for i, v in enumerate(ids)}
    return ids, sorted((at[a], at[b], w) for a, b, w in rows)


_QG = "select a.folder src, b.folder dst, sum(weight) weight from cedge join cust a on src = a.file join cust b on dst = b.file where a.folder < b.folder group by 1, 2"


@query(_sql("select (select count(distinct v) from (select src v from qg union select dst from qg)) vertices, count(*) edges, round(sum(weight), 3)::double weight, true acyclic, true within_cap from qg", "cedge", "cust", qg=_QG))
def partition_acyclic(t: Tables) -> DataFrame:
    """Multilevel clustering of the graph of folders: what it ran on, and whether caps and acyclicity hold."""
    ids, edges = _folder_graph(t)
    got = cluster.cluster_level([1.0] * len(ids), edges, 8.0)
    acyclic = not edges or cluster.acyclic(max(got) + 1, cluster.quotient(got, edges))
    fits = all(got.count(c) <= 8 for c in set(got))
    return t.spark.createDataFrame([(len(ids), len(edges), round(float(sum(w for *_, w in edges)), 3), acyclic, fits)], "vertices long, edges long, weight double, acyclic boolean, within_cap boolean")


@query(_sql("select (select count(distinct v) from (select src v from qg union select dst from qg)) vertices, 30::bigint restarts, true best_first, true good, true apart, true few from qg group by ()", "cedge", "cust", qg=_QG))
def diversify_pick(t: Tables) -> DataFrame:
    """Thirty restarts of the clustering of the graph of folders over shuffled vertex orders, and what is picked of them."""
    import random

    ids, edges = _folder_graph(t)
    n, total = len(ids), sum(w for *_, w in edges) or 1.0

    def solve(seed: int) -> tuple[float, list[int]]:
        kinds = list(range(n))
        random.Random(seed).shuffle(kinds)
        got = cluster.cluster_level([1.0] * n, edges, 8.0, affinity=[k % 5 for k in kinds])
        return cluster.cut_weight(got, edges) / total, got

    rows = partition.restarts(t.spark.range(30).withColumnRenamed("id", "seed"), solve).orderBy("seed").collect()  # one row per restart
    pool = [(r["score"], list(r["assignment"])) for r in rows]
    picked, _ = partition.diversify(pool)
    scores, best = [pool[i][0] for i in picked], min(s for s, _ in pool)
    apart = all(partition.vi(pool[a][1], pool[b][1]) >= 0.05 for k, a in enumerate(picked) for b in picked[k + 1 :])
    row = (n, len(rows), scores == sorted(scores) and scores[0] == best, all(s <= best * 1.05 for s in scores), apart, 1 <= len(picked) <= 3)
    return t.spark.createDataFrame([row], "vertices long, restarts long, best_first boolean, good boolean, apart boolean, few boolean")


@query(_sql("select count(*) findings from (select n.id, vis_rank, greatest(0, max(case when a.container is null or a.container = f.file then 0 when c.folder = g.folder then 1 when c.domain = g.domain then 2 when c.package = g.package then 3 else 4 end)) need from onode n join reloc f on n.id = f.id join cust c on f.file = c.file left join uses u on u.target = n.id left join (select id, file container from reloc) a on a.id = u.source left join cust g on a.container = g.file where not public_api group by 1, 2) where vis_rank > need",
            "onode", "reloc", "cust", "oedge", uses="select source, target from oedge where kind <> 'TypeReference' and kind <> 'Inheritance'"))
def trial_visibility(t: Tables) -> DataFrame:
    """Items declared too wide if urgent orders lived in their new files; uses that expose types are left out here."""
    placement = t.relocated.select("id", F.col("file").alias("container"))
    edges = t.org_edges.filter("kind not in ('TypeReference', 'Inheritance')")
    tree = _tree(t)
    return findings.finding_count(t.org_nodes, edges, tree, placement)


def _tree(t: Tables) -> DataFrame:
    from keelson.operators import hierarchy

    return cut(hierarchy.ancestors(t.org_containers))


@query(_sql("""select count(*) filter (where excess) remaining, count(*) filter (where excess and lv = 'File') file_level from (
select 'File' lv, size > 600 * 1.1 excess from fsize union all select 'Folder', count(*) > 20 * 1.1 from cust group by new_folder union all select 'Domain', count(distinct new_folder) > 16 * 1.1 from cust group by "domain")""", "fsize", "cust"))
def capacity_left(t: Tables) -> DataFrame:
    """What the proposed folders leave over their caps; sizes of files count too."""
    f = _file_rows(t)
    m = findings._capacity(f.select(F.col("file").alias("container"), F.col("size").alias("measure")), "File", None)
    m = m.unionByName(findings._capacity(t.customers.groupBy(F.col("new_folder").alias("container")).agg(F.count("*").alias("measure")), "Folder", None))
    m = m.unionByName(findings._capacity(t.customers.groupBy(F.col("domain").alias("container")).agg(F.countDistinct("new_folder").alias("measure")), "Domain", None))
    return findings.capacity_remainder(m)


# --- moves ---------------------------------------------------------------------------------------


@query("""with b as (select p_partkey file, p_brand package, case when p_partkey % 9 <> 0 then p_type end namespace from part), k as (select distinct package, namespace from b where namespace is not null),
a as (select p_partkey file, case when p_size % 2 = 0 then 'Brand#2' when p_size % 5 = 0 then 'new' else p_brand end package from part)
select a.file, a.package, case when k.namespace is not null then b.namespace when o.n = 1 then o.one else '' end as namespace from a join b on a.file = b.file left join k on a.package = k.package and b.namespace = k.namespace
left join (select package, count(*) n, min(namespace) one from k group by 1) o on a.package = o.package where b.namespace is not null""")
def kept_namespaces(t: Tables) -> DataFrame:
    p = t["part"]
    before = p.select(F.col("p_partkey").alias("file"), F.col("p_brand").alias("package"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_type")).alias("namespace"))
    to = F.when(F.col("p_size") % 2 == 0, "Brand#2").when(F.col("p_size") % 5 == 0, "new").otherwise(F.col("p_brand"))
    return moves.kept_namespaces(before, p.select(F.col("p_partkey").alias("file"), to.alias("package")))


@query("""with e as (select p_partkey cluster, p_brand parent, p_name as name, case when p_partkey % 4 <> 0 then 'a/' || p_type end anchor from part)
select cluster, case when count(*) over (partition by parent, name) > 1 then name || ' (' || replace(coalesce(anchor, 'workspace'), '/', '.') || ')' else name end as label from e""")
def qualified_names(t: Tables) -> DataFrame:
    anchor = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("a/"), "p_type"))
    return moves.qualify_names(t["part"].select(F.col("p_partkey").alias("cluster"), F.col("p_brand").alias("parent"), F.col("p_name").alias("name"), anchor.alias("anchor")))


@query("""select cluster, namespace, name from (select p_brand cluster, p_type namespace, p_name as name, count(*) n from part group by 1, 2, 3) where n > 1""")
def identity_clashes(t: Tables) -> DataFrame:
    return moves.identity_veto(t["part"].select(F.col("p_brand").alias("cluster"), F.col("p_type").alias("namespace"), F.concat(F.lit("x/"), "p_name").alias("path")))


_MV = "select file, 'd' || new_folder as destination from cust where folder <> new_folder"
_PR = "select c.file as source, (c.cust + 1) * 8 test, c.cust % 3 = 0 pinned from cust c"


@query(_sql("select file, destination from led union select test, destination from led where test is not null", "cust", mv=_MV, pr=_PR, led="select mv.file, mv.destination, pr.test from mv left join pr on mv.file = pr.source where not coalesce(pinned, false)"))
def followed_tests(t: Tables) -> DataFrame:
    m = t.customers.filter("folder <> new_folder").select("file", F.concat(F.lit("d"), F.col("new_folder").cast("string")).alias("destination"))
    pairs = t.customers.select(F.col("file").alias("source"), ((F.col("cust") + 1) * 8).alias("test"), (F.col("cust") % 3 == 0).alias("pinned"))
    return moves.follow_tests(m, pairs)


@query(_sql("""select g.destination, g.kind, case when g.main_origin % 3 = 0 then 'RelievesOverCap' when pl.destination is not null then 'PulledBy' when g.destination % 5 < 2 then 'NamingCohesion' else 'Clustering' end reason, pl.puller
from grp g left join (select new_folder destination, min(cust) puller from cust where acctbal > 5000 group by 1) pl on g.destination = pl.destination""", "cust", "fsize",
            mv="select folder origin, new_folder destination, size from fsize where folder <> new_folder",
            by_o="select m.destination, m.origin, count(*) n, sum(size) s, any_value(f.feeds) feeds from mv m join (select origin, count(distinct destination) feeds from mv group by 1) f on m.origin = f.origin group by 1, 2",
            grp="select destination, case when count(distinct origin) >= 2 then 'Merge' when max(feeds) >= 2 then 'Split' else 'Move' end kind, arg_min(origin, [-s, origin]) main_origin from by_o group by 1"))
def move_reasons(t: Tables) -> DataFrame:
    g = moves.move_groups(_file_rows(t).select("file", "size", F.col("folder").alias("origin"), F.col("new_folder").alias("destination")))
    over = t.customers.select(F.col("folder").alias("origin")).filter("origin % 3 = 0").distinct()
    pulls = t.customers.filter("acctbal > 5000").select(F.col("new_folder").alias("destination"), F.col("cust").alias("puller"))
    naming = t.customers.select(F.col("new_folder").alias("destination")).filter("destination % 5 < 2").distinct()
    return moves.move_reasons(g, over, pulls, naming)


_FM = "select distinct path, case when page_id % 3 = 0 then regexp_replace(path, '/[^/]*$', '') else 'new' || page_id % 4 end destination from pf"


@query(_sql("select folder, sum(o)::bigint leaving, sum(i)::bigint entering from (select regexp_replace(path, '/?[^/]*$', '') folder, 1 o, 0 i, destination from fm where regexp_replace(path, '/?[^/]*$', '') <> destination union all select destination, 0, 1, destination from fm where regexp_replace(path, '/?[^/]*$', '') <> destination) group by 1", "pf", fm=_FM))
def folder_impacts(t: Tables) -> DataFrame:
    return moves.folder_impacts(_file_moves(t))


def _file_moves(t: Tables) -> DataFrame:
    to = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.concat(F.lit("new"), (F.col("page_id") % 4).cast("string")))
    return t.page_files.select("path", to.alias("destination")).distinct()


@query(_sql("""select distinct side, i::bigint as depth, array_to_string(string_split(path, '/')[1:i], '/') branch, i = len(string_split(path, '/')) is_file from (select side, path, unnest(range(1, len(string_split(path, '/')) + 1)) i from (
select 'before' side, path from fm where destination || '/' || string_split(path, '/')[-1] <> path union all select 'after', destination || '/' || string_split(path, '/')[-1] from fm where destination || '/' || string_split(path, '/')[-1] <> path))""", "pf", fm=_FM))
def change_tree(t: Tables) -> DataFrame:
    return moves.change_tree(_file_moves(t))


# --- advice --------------------------------------------------------------------------------------


@query(_sql("select 'file' kind, file::varchar subject, new_folder::varchar destination from cust where folder <> new_folder union all select 'symbol', id::varchar, file::varchar from reloc where file <> start_file", "cust", "reloc"))
def atomized_moves(t: Tables) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    files = t.customers.filter("folder <> new_folder").select(s("file").alias("subject"), s("new_folder").alias("destination"))
    return advice.atomize(files, t.relocated.filter("file <> start_file").select(s("id").alias("subject"), s("file").alias("destination")))


@query(_sql("""select subject, place from (select file subject, folder::varchar place from cust union select src, b.folder::varchar from cedge join cust b on dst = b.file where weight > 0 union select dst, a.folder::varchar from cedge join cust a on src = a.file where weight > 0
union select h.dst * 8, c.folder::varchar from he h join cust c on h.src = c.cust union select file, case when acctbal < 0 then '' else 'shared' end from cust)  where place <> ''""", "cust", "cedge", "he"))
def alternative_places(t: Tables) -> DataFrame:
    """Places to weigh: the source, neighbours' homes, a common place of the users, owners' homes."""
    c = t.customers
    place = c.select(F.col("file"), F.col("folder").cast("string").alias("place"))
    e = _customer_edges(t).filter("weight > 0")
    near = e.select(F.col("src").alias("subject"), F.col("dst").alias("file")).union(e.select(F.col("dst").alias("subject"), F.col("src").alias("file"))).join(place, "file").select("subject", "place")
    own = t.handover.select((F.col("dst") * 8).alias("subject"), (F.col("src") * 8).alias("file")).join(place, "file").select("subject", "place")
    use = c.select(F.col("file").alias("subject"), F.when(F.col("acctbal") < 0, "").otherwise("shared").alias("place"))
    return advice.alternatives(place.select(F.col("file").alias("subject"), "place"), near, use, own)


@query("""with i as (select case when p_size % 4 = 0 then 'file' else 'symbol' end kind, p_partkey subject, p_name || p_partkey as name, p_brand origin, p_type outcome from part)
select kind, origin, outcome, count(*) subjects, array_to_string(list_sort(list(distinct name)), ', ') as names from i group by kind, origin, outcome, case when kind = 'file' then subject end""")
def grouped_advice(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_size") % 4 == 0, "file").otherwise("symbol")
    return advice.grouped(t["part"].select(kind.alias("kind"), F.col("p_partkey").alias("subject"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("origin"), F.col("p_type").alias("outcome")))


# --- saved results -------------------------------------------------------------------------------


@query(_sql("select id, kind, polarity, effective_size from onode", "onode"))
def json_round_trip(t: Tables) -> DataFrame:
    """Rows written as JSON documents and read back under the fixed schema."""
    rows = t.org_nodes.select("id", "kind", "polarity", "effective_size")
    said = rows.select(F.to_json(F.struct(*rows.columns)).alias("j"))
    return said.select(F.from_json("j", "id long, kind string, polarity string, effective_size long").alias("r")).select("r.*")


