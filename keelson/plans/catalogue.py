"""Every registered query of the graph engine, with the SQL that gives the same rows.

A query is a function on plans.projections.Tables; SQL is built from named common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson import functions as K
from keelson import schema
from keelson import model
from keelson.operators import advice, findings, graph, hierarchy, moves, partition, score, symbols
from keelson.operators.components import connected_components
from keelson.plans.projections import Tables
from keelson.session import cut, ship, spread

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}

# --- common table expressions -------------------------------------------------------------------

_CTE = {
    "h_d": "select distinct l_partkey, l_quantity, l_discount, o_orderdate, o_orderkey, o_custkey from lineitem join orders on l_orderkey = o_orderkey",
    "h_s": "select o_custkey src, lead(o_custkey) over (partition by l_partkey, l_quantity, l_discount order by o_orderdate, o_orderkey) dst from h_d",
    "he": "select src, dst, cast(count(*) as double) weight from h_s where dst is not null and src <> dst group by 1, 2",
    "hn": "select src node from he union select dst from he",
    "hr": "select src a, dst b from he union select hr.a, he.dst from hr join he on hr.b = he.src",
    "hm": "select node, least(node, coalesce(m, node)) scc from hn left join (select p.a, min(p.b) m from hr p join hr q on p.a = q.b and p.b = q.a group by 1) on node = a",
    "hq": "select x.scc src, y.scc dst, sum(weight) weight from he join hm x on he.src = x.node join hm y on he.dst = y.node where x.scc <> y.scc group by 1, 2",
    "ev_s": "select event_type s, lead(event_type) over (partition by user_id order by ts, event_id) t from events",
    "ev": "select s, t, cast(count(*) as double) weight from ev_s where t is not null and s <> t group by 1, 2",
    "o_size": "select l_orderkey, count(*) effective_size from lineitem group by 1",
    "onode": """select o_orderkey id, case when o_orderkey % 5 <= 2 then 'Symbol' when o_orderkey % 5 = 3 then 'Type' else 'FileBody' end kind,
        case o_orderstatus when 'F' then 'Production' when 'O' then 'TestSupport' else 'TestCase' end polarity, o_custkey * 8 container,
        ['File', 'Folder', 'Domain', 'Package', 'PackageGroup'][1 + (o_orderkey // 5) % 5] visibility, (o_orderkey // 5) % 5 vis_rank, effective_size,
        o_orderstatus <> 'F' test_source, nullif(min(o_orderkey) over (partition by o_custkey), o_orderkey) owner, o_orderpriority = '1-URGENT' public_api
        from orders join o_size on o_orderkey = l_orderkey""",
    "o_pl": "select l_partkey, l_orderkey, min(l_discount) d, min(l_linestatus) ls from lineitem group by 1, 2",
    "o_seq": "select o_orderkey source, lead(o_orderkey) over (partition by l_partkey order by o_orderdate, o_orderkey) target, o_orderpriority pr, ls, d from o_pl join orders on l_orderkey = o_orderkey",
    "oedge": """select source, target, case pr when '1-URGENT' then 'ValueImport' when '2-HIGH' then 'TypeReference' when '3-MEDIUM' then 'Inheritance' when '4-NOT SPECIFIED' then 'Call' else 'ReExport' end kind,
        case ls when 'O' then 'Hard' else 'Soft' end hardness, 1 - d confidence from o_seq where target is not null""",
    "opriced": "select *, confidence * case kind when 'ValueImport' then 1.0 when 'Inheritance' then 1.5 when 'Call' then 1.0 when 'TypeReference' then 0.3 else 0.0 end::double weight from oedge",
    "cust": """select c_custkey cust, c_custkey * 8 as "file", (c_nationkey::bigint * 16 + seg) * 8 + 1 folder, c_nationkey::bigint * 8 + 2 as "domain", n_regionkey::bigint * 8 + 3 package, 4::bigint packagegroup,
        c_name as "name", c_mktsegment segment, c_acctbal acctbal, (c_nationkey::bigint * 16 + case when c_acctbal < 0 then (seg + 1) % 5 else seg end) * 8 + 1 new_folder
        from (select *, list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) - 1 seg from customer) join nation on c_nationkey = n_nationkey""",
    "cont": """select file id, name, 'File' as level, folder parent from cust union select folder, folder::varchar, 'Folder', domain from cust union select domain, domain::varchar, 'Domain', package from cust
        union select package, package::varchar, 'Package', packagegroup from cust union select packagegroup, 'world', 'PackageGroup', null from cust""",
    "aff": "select * from (select o_orderkey as \"owner\", lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) companion from orders) where companion is not null",
    "o_to": "select source id, min(target) as t from oedge group by 1",
    "reloc": "select n.id, case when n.public_api and m.container is not null then m.container else n.container end as \"file\", n.container start_file from onode n left join o_to on n.id = o_to.id left join onode m on o_to.t = m.id",
    "fe": """select a.container src, b.container dst, sum(case when a.kind = 'FileBody' and false then 0 when za.file is not null or zb.file is not null then 0 else weight end) weight
        from opriced join onode a on source = a.id join onode b on target = b.id left join zone za on a.container = za.file left join zone zb on b.container = zb.file where a.container <> b.container group by 1, 2""",
    "zone": "select container as \"file\" from onode group by 1 having bool_and(polarity <> 'Production')",
    "cedge": "select a.container src, b.container dst, sum(weight) weight from opriced join onode a on source = a.id join onode b on target = b.id where a.container <> b.container group by 1, 2",
    "pf": "select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || '.html' as path from pages",
    "psz": "select container, sum(case when polarity = 'Production' then effective_size else 0 end) size from onode group by 1",
    "fsize": "select c.*, coalesce(size, 0) size from cust c left join psz on c.file = psz.container",
    "csize": """select file container, 'File' as level, sum(size)::bigint size from fsize group by 1 union all select folder, 'Folder', sum(size)::bigint from fsize group by 1 union all select domain, 'Domain', sum(size)::bigint from fsize group by 1
        union all select package, 'Package', sum(size)::bigint from fsize group by 1 union all select packagegroup, 'PackageGroup', sum(size)::bigint from fsize group by 1""",
}
_NEEDS = {
    "h_s": ["h_d"], "he": ["h_s"], "hn": ["he"], "hr": ["he"], "hm": ["hn", "hr"], "hq": ["he", "hm"], "ev": ["ev_s"], "onode": ["o_size"], "o_seq": ["o_pl"], "oedge": ["o_seq"], "opriced": ["oedge"],
    "cont": ["cust"], "o_to": ["oedge"], "reloc": ["onode", "o_to"], "zone": ["onode"], "fe": ["opriced", "onode", "zone"], "cedge": ["opriced", "onode"], "psz": ["onode"], "fsize": ["cust", "psz"], "csize": ["fsize"],
}


def _sql(body: str, *names: str, **own: str) -> str:
    """``body`` over the named expressions, those they need, and further ones given by name."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} as ({_CTE[n]})" for n in order] + [f"{n} as ({x})" for n, x in own.items()]
    return f"with recursive {', '.join(parts)} {body}" if parts else body


def query(sql: str | None):
    def keep(f: Callable[[Tables], DataFrame]):
        name = f.__name__.rstrip("_")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict:
    run = lambda f: lambda spark, sf_dir: f(Tables(spread(ship(spark), f"{sf_dir}/lineitem.parquet"), sf_dir))
    return {k: run(f) for k, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(c, places: int = 4):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, places) + F.lit(0.0)


# --- prices and projections of the graph --------------------------------------------------------


@query(_sql("select source, target, kind, hardness, round(confidence, 4) confidence, round(weight, 4) weight from opriced", "opriced"))
def price_edges(t: Tables) -> DataFrame:
    return graph.price_edges(t.org_edges).select("source", "target", "kind", "hardness", _r("confidence").alias("confidence"), _r("weight").alias("weight"))


@query(_sql("select kind, count(*) edges, round(sum(weight), 4) weight from opriced group by 1", "opriced"))
def kind_weight_sum(t: Tables) -> DataFrame:
    return graph.price_edges(t.org_edges).groupBy("kind").agg(F.count("*").alias("edges"), _r(F.sum("weight")).alias("weight"))


@query(_sql("select source src, target dst, round(sum(weight), 4) weight from opriced group by 1, 2", "opriced"))
def weighted_edges(t: Tables) -> DataFrame:
    e = graph.price_edges(t.org_edges).withColumnsRenamed({"source": "src", "target": "dst"})
    return graph.weighted_edges(e).select("src", "dst", _r("weight").alias("weight"))


@query(_sql("select source, target, kind from oedge where hardness = 'Hard'", "oedge"))
def hard_edges(t: Tables) -> DataFrame:
    return graph.hard_edges(t.org_edges).select("source", "target", "kind")


@query(_sql("select dst src, src dst, weight from he", "he"))
def reversed_edges(t: Tables) -> DataFrame:
    return graph.reversed_edges(t.handover).select("src", "dst", "weight")


def _zone(t: Tables) -> DataFrame:
    return t.org_nodes.groupBy(F.col("container").alias("file")).agg(F.bool_and(F.col("polarity") != "Production").alias("z")).filter("z").select("file")


def _priced(t: Tables) -> DataFrame:
    return graph.price_edges(t.org_edges)


def _customer_edges(t: Tables) -> DataFrame:
    none = t.org_nodes.select(F.col("container").alias("file")).limit(0)
    return graph.file_graph(_priced(t), t.org_nodes.select("id", F.col("container").alias("file")), none)


@query(_sql("select src, dst, round(weight, 4) weight from fe", "fe"))
def file_graph(t: Tables) -> DataFrame:
    return graph.file_graph(_priced(t), t.org_nodes.select("id", F.col("container").alias("file")), _zone(t)).select("src", "dst", _r("weight").alias("weight"))


# --- components, layers, closure -----------------------------------------------------------------


@query(_sql("select node, scc from hm", "hm"))
def scc_membership(t: Tables) -> DataFrame:
    return graph.condense(t.handover)


@query(_sql("select scc, count(*) members from hm group by 1 having count(*) > 1", "hm"))
def scc_sizes(t: Tables) -> DataFrame:
    return graph.condense(t.handover).groupBy("scc").agg(F.count("*").alias("members")).filter("members > 1")


@query(_sql("select src, dst, weight from hq", "hq"))
def scc_quotient(t: Tables) -> DataFrame:
    e = cut(t.handover)
    return graph.quotient(e, graph.condense(e))


@query(_sql("select (select coalesce(sum(k), 0)::bigint from (select count(*) k from hm group by scc having count(*) > 1)) cyclic_nodes, (select count(*) from he join hm a on src = a.node join hm b on dst = b.node where a.scc = b.scc) cyclic_edges", "hm"))
def cycle_counts(t: Tables) -> DataFrame:
    e = cut(t.handover)
    return graph.cycle_counts(e, graph.condense(e))


@query(_sql("select scc, count(*) members, list_sort(list(distinct name)) as location from hm join cust on node = cust group by 1 having count(*) > 1", "hm", "cust"))
def cycle_findings(t: Tables) -> DataFrame:
    home = t["customer"].select(F.col("c_custkey").alias("node"), F.col("c_name").alias("file"))
    return findings.cycle_findings(graph.condense(t.handover), home)


@query(_sql("select node, coalesce(max(d), 0) + 1 as layer from (select distinct scc node from hm) left join hd on node = n group by 1", "hq",
            hd="select src n, dst m, 1::bigint d from hq union select hd.n, hq.dst, hd.d + 1 from hd join hq on hd.m = hq.src"))
def layers(t: Tables) -> DataFrame:
    e = cut(t.handover)
    m = cut(graph.condense(e))
    return graph.layers(graph.quotient(e, m), m.select(F.col("scc").alias("node")))


@query(_sql("select a as start, b reached from hr", "hr"))
def reachability(t: Tables) -> DataFrame:
    return graph.closure(t.handover)


@query(_sql("select node as vertex, min(b) component from (select node, node b from hn union all select a, b from ur) group by 1", "hn",
            ue="select src x, dst y from he union select dst, src from he", ur="select x a, y b from ue union select ur.a, ue.y from ur join ue on ur.b = ue.x"))
def connected_components_(t: Tables) -> DataFrame:
    return connected_components(t.handover)


@query("""with recursive p as (select p_partkey k from part), c as (select k, k as t, 0::bigint hops from p union all select k, t // 2, hops + 1 from c where t % 2 = 1)
select k node, arg_max(t, hops) target, max(hops) hops from c group by 1""")
def reexport_flatten(t: Tables) -> DataFrame:
    p = t["part"].select(F.col("p_partkey").alias("node"))
    odd = p.filter(F.col("node") % 2 == 1).select(F.col("node").alias("source"), F.floor(F.col("node") / 2).cast("long").alias("target"))
    return graph.flatten_re_exports(p, odd)


_PERM = """with recursive ev_s as (select event_type s, lead(event_type) over (partition by user_id order by ts, event_id) t from events),
ev as (select s, t, cast(count(*) as double) weight from ev_s where t is not null and s <> t group by 1, 2),
v as (select distinct event_type x from events),
p as (select [a.x, b.x, c.x, d.x, e.x] o from v a, v b, v c, v d, v e where a.x <> b.x and a.x <> c.x and a.x <> d.x and a.x <> e.x and b.x <> c.x and b.x <> d.x and b.x <> e.x and c.x <> d.x and c.x <> e.x and d.x <> e.x)
select min(w) weight, true as exact from (select o, sum(weight) w from p, ev where list_position(o, s) > list_position(o, t) group by 1)"""


def _event_breaks(t: Tables) -> DataFrame:
    rank = lambda c: F.array_position(F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")]), F.col(c)).cast("long")
    e = t.event_graph.select(rank("s").alias("src"), rank("t").alias("dst"), "weight")
    e = cut(e)
    return graph.shatter(e, graph.condense(e))


@query(_PERM)
def mfas_weight_events(t: Tables) -> DataFrame:
    return _event_breaks(t).agg(F.sum("weight").alias("weight"), F.bool_and("exact").alias("exact"))


@query(_sql("select vertex, cluster, round(pull, 4) pull, rank from (select *, row_number() over (partition by vertex order by round(pull, 6) desc, cluster) as rank from (select v.x vertex, b.folder cluster, sum(weight) pull from v join cust a on v.x = a.file join cust b on v.y = b.file where a.folder <> b.folder group by 1, 2 having sum(weight) > 0)) where rank <= 4", "cedge", "cust",
            v="select src x, dst y, weight from cedge union all select dst, src, weight from cedge"))
def pull_targets_top4(t: Tables) -> DataFrame:
    home = t.customers.select(F.col("file").alias("vertex"), F.col("folder").alias("cluster"))
    return graph.pull_targets(_customer_edges(t), home).select("vertex", "cluster", _r("pull").alias("pull"), "rank")


# --- hierarchy -----------------------------------------------------------------------------------

_PT = dict(
    placed="""select distinct path, host package, host || '/' || case when len(s) = 2 then 'workspace' else s[2] end as "domain", host || '/' || case when len(s) = 2 then 'workspace' else array_to_string(s[2:len(s) - 1], '/') end folder, len(s) = 2 synthetic
    from (select path, string_split(path, '/') s, string_split(path, '/')[1] host from pf)""",
)


def _placed(t: Tables) -> DataFrame:
    roots = t.page_files.select(F.element_at(K.path_segments(F.col("path")), 1).alias("root")).distinct()
    return hierarchy.laminar_tree(t.page_files, roots, "root", source_roots=())


@query(_sql("select path, package, domain, folder, synthetic from placed", "pf", **_PT))
def laminar_files(t: Tables) -> DataFrame:
    return _placed(t)


@query(_sql("""select level, name, up as parent_name, bool_or(synthetic) synthetic from (select 'PackageGroup' as level, 'web' as name, null as up, false synthetic union select 'Package', package, 'web', false from placed union select 'Domain', domain, package, synthetic from placed
union select 'Folder', folder, domain, synthetic from placed union select 'File', path, folder, false from placed) group by 1, 2, 3""", "pf", **_PT))
def laminar_containers(t: Tables) -> DataFrame:
    c = cut(hierarchy.tree_containers(_placed(t), "web"))
    if hierarchy.tree_violations(c).limit(1).count():
        raise AssertionError("the built tree is not valid")
    up = c.select(F.col("id").alias("parent"), F.col("name").alias("parent_name"))
    return c.join(up, "parent", "left").select("level", "name", "parent_name", "synthetic")


@query(_sql("select file id, file, folder, domain, package, packagegroup from cust union select folder, null, folder, domain, package, packagegroup from cust union select domain, null, null, domain, package, packagegroup from cust union select package, null, null, null, package, packagegroup from cust union select packagegroup, null, null, null, null, packagegroup from cust", "cust"))
def ancestor_table(t: Tables) -> DataFrame:
    return hierarchy.ancestors(t.org_containers)


_BENT = "select id, level, case when level = 'Folder' and (id // 8) % 16 = 4 then id when level = 'Domain' and parent = 11 then -1 else parent end parent from cont"


@query(_sql("""select 'MissingParent' as defect, b.id from bent b left join bent p on b.parent = p.id where b.parent is not null and p.id is null
union all select 'LevelNotAscending', b.id from bent b join bent p on b.parent = p.id where list_position(['File', 'Folder', 'Domain', 'Package', 'PackageGroup'], p.level) <= list_position(['File', 'Folder', 'Domain', 'Package', 'PackageGroup'], b.level)
union all select 'NonDenseIds', max(id) from bent having min(id) <> 0 or max(id) <> count(distinct id) - 1""", "cont", bent=_BENT))
def tree_violations(t: Tables) -> DataFrame:
    """The tree with two defects put in: one segment's folders hang on themselves, one region's nations on nothing."""
    c = t.org_containers
    bent = F.when((F.col("level") == "Folder") & (F.floor(F.col("id") / 8) % 16 == 4), F.col("id")).when((F.col("level") == "Domain") & (F.col("parent") == 11), F.lit(-1)).otherwise(F.col("parent"))
    return hierarchy.tree_violations(c.select("id", "level", bent.cast("long").alias("parent")))


@query(_sql("select source, target from oedge where source not in (select id from onode where polarity <> 'TestCase') or target not in (select id from onode where polarity <> 'TestCase')", "oedge", "onode"))
def dangling_edges(t: Tables) -> DataFrame:
    """Edges with an endpoint outside the nodes that are no test cases."""
    return hierarchy.dangling_edges(t.org_edges.select("source", "target"), t.org_nodes.filter("polarity <> 'TestCase'"))


_LEVEL = "case when a.file = b.file then 'File' when a.folder = b.folder then 'Folder' when a.domain = b.domain then 'Domain' when a.package = b.package then 'Package' else 'PackageGroup' end"


@query(_sql(f"select src, dst, {_LEVEL} as level from cedge join cust a on src = a.file join cust b on dst = b.file", "cedge", "cust"))
def lca_level(t: Tables) -> DataFrame:
    return score.edge_levels(_customer_edges(t), t.org_tree).select("src", "dst", "level")


@query(_sql("select a.id, b.id other, coalesce(case when a.folder = b.folder then a.folder end, case when a.domain = b.domain then a.domain end, case when a.package = b.package then a.package end, a.packagegroup) ancestor from (select file id, * from cust) a join (select file id, * from cust) b on a.cust + 1 = b.cust", "cust"))
def common_ancestors(t: Tables) -> DataFrame:
    """Deepest common ancestor of each customer and the next."""
    c = t.customers
    cols = [x.lower() for x in schema.LEVELS]
    a = c.select("cust", F.col("file").alias("id"), *[F.col(x).alias(f"a_{x}") for x in cols])
    b = c.select((F.col("cust") - 1).alias("cust"), F.col("file").alias("other"), *[F.col(x).alias(f"b_{x}") for x in cols])
    side = lambda s: {x: F.col(f"{s}_{x.lower()}") for x in schema.LEVELS}
    return a.join(b, "cust").select("id", "other", hierarchy.common_ancestor(side("a"), side("b")).alias("ancestor"))


@query(_sql("select container, level, size from csize", "csize"))
def subtree_sizes(t: Tables) -> DataFrame:
    return hierarchy.container_sizes(t.org_nodes, t.org_tree)


# --- objective -----------------------------------------------------------------------------------

_CUTSQL = f"select coalesce(sum(w * case level when 'File' then 1 when 'Folder' then 2 when 'Domain' then 4 when 'Package' then 8 else 16 end) / (16 * sum(w)), 0) cut from (select weight * case when a.container = b.container then case when a.kind = 'Type' or b.kind = 'Type' then 3.0 else 1.0 end else 1.0 end::double w, {_LEVEL.replace('a.', 'ca.').replace('b.', 'cb.')} as level from opriced join onode a on source = a.id join onode b on target = b.id join cust ca on a.container = ca.file join cust cb on b.container = cb.file)"
_IMBSQL = "select coalesce(sum(cv), 0) imbalance from (select case when count(*) < 2 or avg(size) = 0 then 0 else var_pop(size) / (avg(size) * avg(size)) end cv from csize join cont on container = id where parent is not null group by parent)"


def _node_levels(t: Tables) -> DataFrame:
    """Priced edges times the same-file affinity, with the level of the files' common ancestor."""
    n = t.org_nodes.select("id", "kind", "container")
    a, b = n.select(F.col("id").alias("source"), F.col("kind").alias("ks"), F.col("container").alias("src")), n.select(F.col("id").alias("target"), F.col("kind").alias("kt"), F.col("container").alias("dst"))
    e = _priced(t).select("source", "target", "weight").join(a, "source").join(b, "target")
    e = e.withColumn("weight", F.col("weight") * findings.same_file_affinity("src", "dst", "ks", "kt"))
    return score.edge_levels(e.select("src", "dst", "weight"), t.org_tree)


@query(_sql(f"select round(cut, 4) cut from ({_CUTSQL})", "opriced", "onode", "cust"))
def cut_term(t: Tables) -> DataFrame:
    return score.cut_term(_node_levels(t)).select(_r("cut").alias("cut"))


def _sizes(t: Tables) -> DataFrame:
    return hierarchy.container_sizes(t.org_nodes, t.org_tree)


@query(_sql(f"select round(imbalance, 4) imbalance from ({_IMBSQL})", "csize", "cont"))
def imbalance_term(t: Tables) -> DataFrame:
    return score.imbalance_term(_sizes(t), t.org_containers).select(_r("imbalance").alias("imbalance"))


@query(_sql("select path, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', ''), '([\\p{Ll}\\p{N}])(\\p{Lu})', '\\1 \\2', 'g')), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) tokens from (select distinct path from pf)", "pf"))
def name_tokens(t: Tables) -> DataFrame:
    return t.page_files.select("path").distinct().select("path", K.name_tokens(F.col("path")).alias("tokens"))


_MEM = "select distinct n.n_nationkey grp, p_partkey member, list_sort(list_distinct(string_split(p_name, ' '))) tokens, p_size::double mass from supplier join nation n on s_nationkey = n_nationkey join lineitem on l_suppkey = s_suppkey join part on l_partkey = p_partkey"


def _members(t: Tables) -> DataFrame:
    """Nations and the parts their suppliers deliver; tokens of the part name, size as mass."""
    j = t["supplier"].join(t["lineitem"].select("l_suppkey", "l_partkey").distinct(), F.col("l_suppkey") == F.col("s_suppkey")).join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    return j.select(F.col("s_nationkey").alias("grp"), F.col("p_partkey").alias("member"), F.array_sort(F.array_distinct(F.split("p_name", " "))).alias("tokens"), F.col("p_size").cast("double").alias("mass")).distinct()


_COH = """select grp, round(case when count(*) < 2 then 0 else coalesce(any_value(s), 0) / (count(*) * (count(*) - 1) / 2) end, 4) cohesion, round(sum(mass), 2) mass
from mem left join (select a.grp g, sum(len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens)))) s from mem a join mem b on a.grp = b.grp and a.member < b.member group by 1) on grp = g group by 1"""


@query(_sql(_COH, mem=_MEM))
def group_cohesion(t: Tables) -> DataFrame:
    return score.group_cohesion(_members(t)).select("grp", _r("cohesion").alias("cohesion"), _r("mass", 2).alias("mass"))


@query(_sql("select round(coalesce(sum(cohesion * mass) / sum(mass), 0), 3) naming from coh", mem=_MEM, coh=_COH.replace(", 4) cohesion", ", 12) cohesion")))
def naming_cohesion(t: Tables) -> DataFrame:
    return score.naming_term(score.group_cohesion(_members(t))).select(_r("naming", 3).alias("naming"))


def _file_rows(t: Tables) -> DataFrame:
    size = hierarchy.container_sizes(t.org_nodes, t.org_tree).filter("level = 'File'").select(F.col("container").alias("file"), "size")
    return t.customers.join(size, "file")


_PATHSQL = "select coalesce(sum(case when folder = new_folder then size else 0 end) / nullif(sum(size), 0), 1.0) as \"path\" from fsize"


@query(_sql(f"select round(path, 4) as \"path\" from ({_PATHSQL})", "fsize"))
def path_cohesion(t: Tables) -> DataFrame:
    rows = _file_rows(t).select("size", F.col("new_folder").alias("folder"), F.col("folder").alias("start_folder"))
    return score.path_term(rows).select(_r("path").alias("path"))


_DISTSQL = "select coalesce(avg(case when folder <> new_folder or r.file <> r.start_file then 1.0 else 0.0 end), 0) distance from reloc r join cust on r.start_file = cust.file"


@query(_sql(f"select round(distance, 4) distance from ({_DISTSQL})", "reloc", "cust"))
def move_distance(t: Tables) -> DataFrame:
    home = t.customers.select(F.col("file").alias("start_file"), F.col("folder").alias("start_folder"), F.col("new_folder").alias("folder"))
    return score.move_distance(t.relocated.join(home, "start_file")).select(_r("distance").alias("distance"))


_CAPSQL = """select 'File' as level, file container, size::bigint measure, 600::bigint cap from fsize union all select 'Folder', folder, count(*), 20 from cust group by 2
union all select 'Domain', domain, count(distinct folder), 16 from cust group by 2 union all select 'Package', package, count(distinct domain), 15 from cust group by 2 union all select 'PackageGroup', packagegroup, count(distinct package), 12 from cust group by 2"""
_SEV = "case when measure <= cap then null when measure <= cap * 1.1 then 'Borderline' else 'Violation' end"


def _capacities(t: Tables) -> DataFrame:
    tree = t.org_tree
    files = hierarchy.container_sizes(t.org_nodes, tree).filter("level = 'File'")
    return (
        findings._capacity(files.select("container", F.col("size").alias("measure")), "File", None)
        .unionByName(findings.child_capacity(tree, "folder", "file", "Folder")).unionByName(findings.child_capacity(tree, "domain", "folder", "Domain"))
        .unionByName(findings.child_capacity(tree, "package", "domain", "Package")).unionByName(findings.child_capacity(tree, "packagegroup", "package", "PackageGroup"))
    )


@query(_sql(f"select level, container, measure, cap, {_SEV} severity from caps", "fsize", caps=_CAPSQL))
def capacity_all(t: Tables) -> DataFrame:
    return _capacities(t)


def _one_level(level: str) -> None:
    def run(t: Tables) -> DataFrame:
        return _capacities(t).filter(F.col("level") == level)

    run.__name__ = f"capacity_{level.lower()}" if level != "PackageGroup" else "capacity_group"
    query(_sql(f"select level, container, measure, cap, {_SEV} severity from caps where level = '{level}'", "fsize", caps=_CAPSQL))(run)


for _level in schema.LEVELS:
    _one_level(_level)


@query(_sql(f"select 'Folder' as level, container, count(*) measure, 20::bigint cap, case when count(*) <= 20 then null when count(*) <= 22 then 'Borderline' else 'Violation' end severity from (select distinct array_to_string(s[1:k - 1], '/') container, s[k] child, k = len(s) leaf from (select s, unnest(range(1, len(s) + 1)) k from (select distinct string_split(path, '/') s from pf))) group by 2", "pf"))
def capacity_directories(t: Tables) -> DataFrame:
    """Physical directories of the page files."""
    return findings.folder_capacity(t.page_files.select("path"))


_PRESS = "select coalesce(sum(greatest(0.0, measure - cap) / cap), 0) pressure from caps"


@query(_sql(f"select round(pressure, 4) pressure from ({_PRESS})", "fsize", caps=_CAPSQL))
def capacity_pressure(t: Tables) -> DataFrame:
    return score.pressure_term(_capacities(t)).select(_r("pressure").alias("pressure"))


_DEPSQL = """select distinct r.id from reloc r join onode n on r.id = n.id join oedge e on e.source = r.id join reloc o on e.target = o.id where n.polarity = 'Production' and n.kind in ('Symbol', 'Type') and r.file <> r.start_file and o.start_file = r.file
and r.id not in (select q.id from reloc q join oedge f on f.target = q.id join reloc p on f.source = p.id where p.start_file = q.file)"""


@query(_sql(_DEPSQL, "reloc", "oedge"))
def dependency_only(t: Tables) -> DataFrame:
    return score.dependency_only(t.org_nodes, t.org_edges, t.relocated)


_SEPSQL = "select distinct owner, companion from aff join reloc a on owner = a.id join reloc b on companion = b.id where a.file <> b.file"


@query(_sql(_SEPSQL, "aff", "reloc"))
def companion_separation(t: Tables) -> DataFrame:
    return score.companion_separation(t.affinities, t.relocated)


def _objective(t: Tables, profile: dict[str, float]) -> DataFrame:
    home = t.customers.select(F.col("file").alias("start_file"), F.col("folder").alias("start_folder"), F.col("new_folder").alias("folder"))
    rows = _file_rows(t).select("size", F.col("new_folder").alias("folder"), F.col("folder").alias("start_folder"))
    terms = {
        "cut": score.cut_term(_node_levels(t)),
        "imbalance": score.imbalance_term(_sizes(t), t.org_containers),
        "naming": score.naming_term(score.group_cohesion(_members(t))),
        "path": score.path_term(rows),
        "distance": score.move_distance(t.relocated.join(home, "start_file")),
        "pressure": score.pressure_term(_capacities(t)),
        "dependency_only": score.dependency_only(t.org_nodes, t.org_edges, t.relocated).agg(F.count("*").alias("dependency_only")),
        "separation": score.companion_separation(t.affinities, t.relocated).agg(F.count("*").alias("separation")),
    }
    return score.objective(terms, profile).select(_r("objective", 2).alias("objective"))


def _objective_sql(p: dict[str, float]) -> str:
    coh = _COH.replace(", 4) cohesion", ", 12) cohesion")
    body = f"""select round((select cut from ({_CUTSQL})) + {p['lambda']} * (select imbalance from ({_IMBSQL})) - {p['alpha']} * (select sum(cohesion * mass) / sum(mass) from coh) - {p['beta']} * (select "path" from ({_PATHSQL}))
    + {p['mu']} * (select distance from ({_DISTSQL})) + {p['gamma']} * (select pressure from ({_PRESS})) + {p['delta']} * (select count(*) from ({_DEPSQL})) + {p['epsilon']} * (select count(*) from ({_SEPSQL})), 2)::double objective"""
    return _sql(body, "opriced", "onode", "cust", "csize", "cont", "fsize", "reloc", "aff", "oedge", mem=_MEM, coh=coh, caps=_CAPSQL)


@query(_objective_sql(schema.ANCHORED))
def objective_anchored(t: Tables) -> DataFrame:
    return _objective(t, schema.ANCHORED)


@query(_objective_sql(schema.GREENFIELD))
def objective_greenfield(t: Tables) -> DataFrame:
    return _objective(t, schema.GREENFIELD)


# --- findings ------------------------------------------------------------------------------------


@query(_sql("select (select count(*) from onode) n_nodes, (select count(*) from oedge) n_edges, (select count(distinct container) from onode) n_files", "onode", "oedge"))
def summary_census(t: Tables) -> DataFrame:
    return findings.census(t.org_nodes, t.org_edges, t.org_nodes.select(F.col("container").alias("file")))


_POL = "select distinct source, target, a.polarity from_polarity, b.polarity to_polarity from oedge join onode a on source = a.id join onode b on target = b.id where (a.polarity = 'Production' and b.polarity in ('TestCase', 'TestSupport')) or (a.polarity = 'TestSupport' and b.polarity = 'TestCase')"


@query(_sql(_POL, "oedge", "onode"))
def polarity_findings(t: Tables) -> DataFrame:
    return findings.polarity_findings(t.org_edges, t.org_nodes)


@query(_sql("select n.id, case when n.polarity = 'Production' and not n.public_api and coalesce(o, false) then 'TestSupport' else n.polarity end polarity from onode n left join (select target, bool_and(polarity <> 'Production') o from oedge join onode on source = id group by 1) on n.id = target", "oedge", "onode"))
def polarity_demotion(t: Tables) -> DataFrame:
    return findings.demoted(t.org_nodes, t.org_edges)


_TO1 = "select n.id from onode n join (select target, bool_and(test_source) o from (select distinct source, target from oedge) join onode on source = id group by 1) on n.id = target where o and not n.test_source and n.kind <> 'FileBody'"


@query(_sql("select n.id from onode n join (select target, bool_and(s.test_source or (t1.id is not null and coalesce(s.owner = target, false))) o from (select distinct source, target from oedge) join onode s on source = s.id left join to1 t1 on s.id = t1.id group by 1) on n.id = target where o and not n.test_source and n.kind <> 'FileBody'", "oedge", "onode", to1=_TO1))
def test_only(t: Tables) -> DataFrame:
    return findings.test_only(t.org_nodes, t.org_edges)


# Scopes: levels at which a node's own and its users' files agree, then the exposure fixpoint as a recursion on types.
_SC0 = """select id, case when min(file) = max(file) then 0 when min(folder) = max(folder) then 1 when min(domain) = max(domain) then 2 when min(package) = max(package) then 3 else 4 end rank, min(file) f
from (select n.id, c.* from onode n join cust c on n.container = c.file union all select e.target, c.* from oedge e join onode n on e.source = n.id join cust c on n.container = c.file) group by 1"""


def _scopes(t: Tables) -> DataFrame:
    return findings.derived_scopes(t.org_nodes, t.org_edges, hierarchy.ancestors(t.org_containers))


@query(_sql("""select id, case when min(c.file) = max(c.file) then 'File' when min(c.folder) = max(c.folder) then 'Folder' when min(c.domain) = max(c.domain) then 'Domain' when min(c.package) = max(c.package) then 'Package' else 'PackageGroup' end as level
from (select id, file from leafs union select r.id, l.file from reach r join leafs l on l.id = r.k) m join cust c on m.file = c.file group by 1""", "oedge", "onode", "cust", sc0=_SC0,
            leafs="select id, container as \"file\" from onode union select e.target, n.container from oedge e join onode n on e.source = n.id",
            ty="select distinct source, target from oedge join onode n on target = n.id where oedge.kind in ('TypeReference', 'Inheritance') and n.kind = 'Type'",
            reach="select target id, source k from ty join sc0 on source = sc0.id where sc0.rank > 0 union select ty.target, reach.k from reach join ty on reach.id = ty.source"))
def derived_scope(t: Tables) -> DataFrame:
    return _scopes(t).select("id", "level")


@query(_sql("select n.id, n.visibility, 'File' as derived from onode n join sc0 on n.id = sc0.id where sc0.rank = 0 and n.vis_rank > 0 and not n.public_api and not exists (select 1 from ty where ty.target = n.id) and n.id not in (select id from sec)", "oedge", "onode", "cust", sc0=_SC0,
            ty="select distinct source, target from oedge join onode n on target = n.id join sc0 on source = sc0.id where oedge.kind in ('TypeReference', 'Inheritance') and n.kind = 'Type' and sc0.rank > 0", to1=_TO1,
            sec="select n.id from onode n join (select target, bool_and(s.test_source or (t1.id is not null and coalesce(s.owner = target, false))) o from (select distinct source, target from oedge) join onode s on source = s.id left join to1 t1 on s.id = t1.id group by 1) on n.id = target where o and not n.test_source and n.kind <> 'FileBody'"))
def visibility_findings(t: Tables) -> DataFrame:
    return findings.visibility_findings(t.org_nodes, _scopes(t), test_only=findings.test_only(t.org_nodes, t.org_edges))


_ALL = f"""select 'Polarity' as kind, 'Violation' as severity, source::varchar || ' -> ' || target::varchar as detail from ({_POL})
union select 'Capacity', {_SEV}, level || ' ' || container::varchar || ': ' || measure::varchar || ' / ' || cap::varchar from caps where measure > cap"""
_ALLN = ("oedge", "onode", "fsize")


def _all_findings(t: Tables) -> DataFrame:
    pol = findings.polarity_findings(t.org_edges, t.org_nodes)
    a = pol.select(F.lit("Polarity").alias("kind"), F.lit("Violation").alias("severity"), F.concat_ws(" -> ", F.col("source").cast("string"), F.col("target").cast("string")).alias("detail"))
    c = _capacities(t).filter("severity is not null")
    b = c.select(F.lit("Capacity").alias("kind"), "severity", F.concat("level", F.lit(" "), F.col("container").cast("string"), F.lit(": "), F.col("measure").cast("string"), F.lit(" / "), F.col("cap").cast("string")).alias("detail"))
    return a.unionByName(b).distinct()


@query(_sql(f"select kind, severity, detail, list_position(['Violation', 'Borderline'], severity)::integer - 1 severity_rank, list_position(['Cycle', 'Polarity', 'Capacity', 'Visibility', 'TestOnly'], kind)::integer - 1 kind_rank from ({_ALL})", *_ALLN, caps=_CAPSQL))
def findings_ranked(t: Tables) -> DataFrame:
    f = _all_findings(t).withColumn("location", F.array("detail"))
    return findings.ranked(f).select("kind", "severity", "detail", "severity_rank", "kind_rank")


_ALLB = _ALL.replace("from caps where measure > cap", "from (select level, container, measure + 1 measure, cap from caps) where measure > cap")


def _other_findings(t: Tables) -> DataFrame:
    pol = _all_findings(t).filter("kind = 'Polarity'")
    c = _capacities(t).withColumn("measure", F.col("measure") + 1)
    c = c.withColumn("severity", K.severity(F.col("measure"), F.col("cap").cast("double"))).filter("severity is not null")
    return pol.unionByName(c.select(F.lit("Capacity").alias("kind"), "severity", F.concat("level", F.lit(" "), F.col("container").cast("string"), F.lit(": "), F.col("measure").cast("string"), F.lit(" / "), F.col("cap").cast("string")).alias("detail")))


@query(_sql(f"select * from ({_ALL}) intersect select * from ({_ALLB})", *_ALLN, caps=_CAPSQL))
def shared_findings(t: Tables) -> DataFrame:
    return findings.shared(_all_findings(t), _other_findings(t))


@query(_sql(f"select * from ({_ALLB}) except select * from ({_ALL})", *_ALLN, caps=_CAPSQL))
def unique_findings(t: Tables) -> DataFrame:
    return findings.unique_to(_other_findings(t), _all_findings(t))


@query(_sql(f"select exists (select 1 from ({_ALL}) where kind in ('Capacity', 'Cycle') and severity = 'Violation') failed, case when exists (select 1 from ({_ALL}) where kind in ('Capacity', 'Cycle') and severity = 'Violation') then 2 else 0 end::bigint exit_code", *_ALLN, caps=_CAPSQL))
def gate(t: Tables) -> DataFrame:
    return findings.gate(_all_findings(t), ("capacity", "cycle:violation"))


@query(_sql(f"select count(*) breaks from ({_ALL}) where kind = 'Capacity' and severity = 'Violation'", *_ALLN, caps=_CAPSQL))
def hard_capacity_breaks(t: Tables) -> DataFrame:
    return findings.hard_capacity_breaks(_all_findings(t))


@query(_sql("select scc, production_size::bigint production_size, ceil(production_size / 20)::bigint files from (select scc, sum(case when acctbal >= 0 then size else 0 end) production_size from hm join fsize on node = cust group by 1 having count(*) > 1) where production_size > 20", "hm", "fsize"))
def conditional_splits(t: Tables) -> DataFrame:
    """Cyclic components of customers whose production exceeds 20 lines."""
    size = _file_rows(t).select(F.col("cust").alias("id"), F.when(F.col("acctbal") >= 0, "Production").otherwise("TestCase").alias("polarity"), F.col("size").alias("effective_size"))
    return findings.conditional_splits(graph.condense(t.handover), size, 20)


# --- partitions ----------------------------------------------------------------------------------


def _partitions(t: Tables) -> tuple[DataFrame, DataFrame]:
    c = t.customers
    return c.select(F.col("cust").alias("vertex"), F.col("package").alias("cluster")), c.select(F.col("cust").alias("vertex"), F.col("segment").alias("cluster"))


@query(_sql("""select round(greatest(0, 2 * (select sum(-n / t * ln(n / t)) from cells, tot) - (select sum(-n / t * ln(n / t)) from (select sum(n) n from cells group by a), tot) - (select sum(-n / t * ln(n / t)) from (select sum(n) n from cells group by b), tot)), 4)::double vi""", "cust",
            cells="select package a, segment b, count(*)::double n from cust group by 1, 2", tot="select sum(n) t from cells"))
def vi_distance(t: Tables) -> DataFrame:
    return partition.vi_distance(*_partitions(t)).select(_r("vi").alias("vi"))


@query(_sql("select round(tp / g, 4) as \"precision\", round(tp / e, 4) recall, round(2 * (tp / g) * (tp / e) / (tp / g + tp / e), 4) f1 from (select (select sum(n * (n - 1) / 2) from cells) tp, (select sum(n * (n - 1) / 2) from (select sum(n) n from cells group by a)) e, (select sum(n * (n - 1) / 2) from (select sum(n) n from cells group by b)) g)", "cust",
            cells="select package a, segment b, count(*)::double n from cust group by 1, 2"))
def pair_f1(t: Tables) -> DataFrame:
    return partition.pair_f1(*_partitions(t)).select(_r("precision").alias("precision"), _r("recall").alias("recall"), _r("f1").alias("f1"))


@query(_sql("select a.folder src, b.folder dst, round(sum(weight), 4) weight from cedge join cust a on src = a.file join cust b on dst = b.file where a.folder <> b.folder group by 1, 2", "cedge", "cust"))
def partition_quotient(t: Tables) -> DataFrame:
    m = t.customers.select(F.col("file").alias("node"), F.col("folder").alias("scc"))
    return graph.quotient(_customer_edges(t), m).select("src", "dst", _r("weight").alias("weight"))


@query(_sql("select cust as vertex, folder before, new_folder after from cust where folder in (select folder from (select folder, list_sort(list(cust)) l from cust group by 1) where true) and (select list_sort(list(cust)) from cust c where c.folder = cust.folder) <> (select list_sort(list(cust)) from cust c where c.new_folder = cust.new_folder)", "cust"))
def moved_files(t: Tables) -> DataFrame:
    c = t.customers
    return partition.moved_files(c.select(F.col("cust").alias("vertex"), F.col("folder").alias("cluster")), c.select(F.col("cust").alias("vertex"), F.col("new_folder").alias("cluster")))


@query(_sql("select folder scc, name as path, size::bigint size from (select *, row_number() over (partition by folder order by size desc, name) k from fsize) where k = 1", "fsize"))
def dominant_member(t: Tables) -> DataFrame:
    return partition.dominant_members(_file_rows(t).select(F.col("folder").alias("scc"), F.col("name").alias("path"), "size"))


@query("select grp, key, n votes, total, 2 * n > total majority from (select *, sum(n) over (partition by grp)::bigint total, row_number() over (partition by grp order by n desc, key) k from (select s_nationkey grp, p_brand key, count(*) n from supplier join lineitem on l_suppkey = s_suppkey join part on l_partkey = p_partkey group by 1, 2)) where k = 1")
def plurality_vote(t: Tables) -> DataFrame:
    j = t["supplier"].join(t["lineitem"].select("l_suppkey", "l_partkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(t["part"].select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return partition.plurality(j.select(F.col("s_nationkey").alias("grp"), F.col("p_brand").alias("key")))


@query(_sql("select cluster, round(avg(hit), 4) alignment from (select regexp_replace(path, '/[^/]*$', '') cluster, case when len(list_intersect(tok(path), tok(regexp_extract(regexp_replace(path, '/[^/]*$', ''), '[^/]*$')))) > 0 then 1.0 else 0.0 end hit from pf) group by 1".replace("tok(path)", "list_filter(string_split_regex(lower(path), '[/_\\-. ]+'), lambda x: x <> '' and not regexp_full_match(x, '[0-9]+'))").replace("tok(regexp_extract(regexp_replace(path, '/[^/]*$', ''), '[^/]*$'))", "list_filter(string_split_regex(lower(regexp_extract(regexp_replace(path, '/[^/]*$', ''), '[^/]*$')), '[/_\\-. ]+'), lambda x: x <> '' and not regexp_full_match(x, '[0-9]+'))"), "pf"))
def name_alignment(t: Tables) -> DataFrame:
    m = t.page_files.select(F.regexp_replace("path", "/[^/]*$", "").alias("cluster"), F.col("path").alias("name"))
    return partition.name_alignment(m).select("cluster", _r("alignment").alias("alignment"))


# --- moves and advice ----------------------------------------------------------------------------


@query(_sql("""select destination, sum(n)::bigint files, count(distinct origin) origins, sum(s)::bigint size, case when count(distinct origin) >= 2 then 'Merge' when max(feeds) >= 2 then 'Split' else 'Move' end kind, arg_min(origin, [-s, origin]) main_origin
from by_o group by 1""", "fsize", mv="select folder origin, new_folder destination, size from fsize where folder <> new_folder",
            by_o="select m.destination, m.origin, count(*) n, sum(size) s, any_value(f.feeds) feeds from mv m join (select origin, count(distinct destination) feeds from mv group by 1) f on m.origin = f.origin group by 1, 2"))
def moved_groups(t: Tables) -> DataFrame:
    return moves.move_groups(_file_rows(t).select("file", "size", F.col("folder").alias("origin"), F.col("new_folder").alias("destination")))


@query(_sql("select path, file, k = 1 keeps from (select *, row_number() over (partition by path order by case when file = path then 0 else 1 end, file) k, count(*) over (partition by path) n from prop) where n > 1", "pf",
            prop="select distinct path as \"file\", regexp_replace(path, '[0-9]+', '0', 'g') as path from pf"))
def path_collisions(t: Tables) -> DataFrame:
    p = t.page_files.select(F.col("path").alias("file"), F.regexp_replace("path", "[0-9]+", "0").alias("path")).distinct()
    return moves.collisions(p)


@query("""with c as (select distinct 'part/' || p_partkey as source, 'part/' || (2 * p_partkey // 3) test from part)
select min(source) source, test from c where test in (select 'part/' || p_partkey from part) group by test having count(*) = 1""")
def unique_pairs(t: Tables) -> DataFrame:
    """Parts as files; each claims the part at two thirds of its number."""
    p = F.col("p_partkey")
    files = t["part"].select(F.concat(F.lit("part/"), p.cast("string")).alias("path")).distinct()
    claims = t["part"].select(F.concat(F.lit("part/"), p.cast("string")).alias("source"), F.concat(F.lit("part/"), F.floor(2 * p / 3).cast("string")).alias("test"))
    return moves.test_pairs(claims, files)


@query(_sql("""select id, file, round(pull, 4) pull, rank from (select *, row_number() over (partition by id order by round(pull, 6) desc, file) as rank from (
  select p.id, p.file, p.pull from pulls p left join pulls s on s.id = p.id and s.file = s.own where p.file <> p.own and p.pull > 0 and (p.kind <> 'Type' or round(p.pull, 6) > round(coalesce(s.pull, 0), 6)))) where rank <= 4""", "opriced", "onode", "aff", "zone",
            nr="select source id, target other, weight from opriced union all select target, source, weight from opriced union all select companion, owner, 0.05 from aff",
            pulls="select a.id, any_value(a.kind) kind, a.container own, b.container as \"file\", sum(weight) pull from nr join onode a on nr.id = a.id join onode b on nr.other = b.id where a.kind <> 'FileBody' and a.container not in (select file from zone) and b.container not in (select file from zone) group by 1, 3, 4"))
def symbol_nominations(t: Tables) -> DataFrame:
    nodes = t.org_nodes.select("id", "kind", F.col("container").alias("file"))
    return symbols.nominations(_priced(t), nodes, _zone(t), t.affinities).select("id", "file", _r("pull").alias("pull"), "rank")


@query(_sql("select source, target, kind, hardness, round(confidence, 4) confidence from (select *, row_number() over (partition by source, target, kind order by hardness, confidence desc) k from oedge) where k = 1", "oedge"))
def edge_dedup(t: Tables) -> DataFrame:
    return model.deduplicated_edges(t.org_edges).select("source", "target", "kind", "hardness", _r("confidence").alias("confidence"))


@query(_sql("select container as \"file\" from onode group by 1 having bool_and(polarity = 'TestCase')", "onode"))
def case_only_files(t: Tables) -> DataFrame:
    return findings.case_only_files(t.org_nodes.withColumn("file", F.col("container")))


@query(_sql("select id, case when public_api then 'Production' when acctbal < 0 and polarity = 'Production' then 'TestSupport' else polarity end polarity from onode join cust on container = cust.file", "onode", "cust"))
def relabelled_nodes(t: Tables) -> DataFrame:
    """Test policy: customers in debt are test files, urgent orders are negated."""
    n = t.org_nodes.join(t.customers.select(F.col("file").alias("container"), "acctbal"), "container")
    return findings.relabelled(n, F.col("acctbal") < 0, F.col("public_api")).select("id", "polarity")


@query(_sql("""select x.n a, y.n b, round(greatest(0, 2 * (select sum(-c / t * ln(c / t)) from (select count(*)::double c from cust group by case x.n when 'domain' then domain::varchar when 'package' then package::varchar else segment end, case y.n when 'domain' then domain::varchar when 'package' then package::varchar else segment end), tot)
  - (select sum(-c / t * ln(c / t)) from (select count(*)::double c from cust group by case x.n when 'domain' then domain::varchar when 'package' then package::varchar else segment end), tot)
  - (select sum(-c / t * ln(c / t)) from (select count(*)::double c from cust group by case y.n when 'domain' then domain::varchar when 'package' then package::varchar else segment end), tot)), 4)::double vi
  from (values ('domain'), ('package'), ('segment')) x(n), (values ('domain'), ('package'), ('segment')) y(n) where x.n < y.n""", "cust", tot="select count(*)::double t from cust"))
def vi_matrix(t: Tables) -> DataFrame:
    parts = {k: t.customers.select(F.col("cust").alias("vertex"), F.col(k).cast("string").alias("cluster")) for k in ("domain", "package", "segment")}
    return partition.vi_matrix(parts).select("a", "b", _r("vi").alias("vi"))


@query(_sql("select r.id, count(distinct case when n.file <> r.file then n.file end) broken from reloc r left join (select source a, target b from oedge union all select target, source from oedge) e on r.id = e.a left join reloc n on e.b = n.id where r.file <> r.start_file group by 1", "reloc", "oedge"))
def broken_imports(t: Tables) -> DataFrame:
    r = t.relocated
    return moves.broken_imports(r.filter("file <> start_file"), t.org_edges, r.select("id", "file"))


@query(_sql("select b.container from (select folder container, greatest(0, count(*) - 20) o from cust group by 1) a right join (select new_folder container, greatest(0, count(*) - 20) o from cust group by 1) b on a.container = b.container where b.o > coalesce(a.o, 0)", "cust"))
def capacity_veto(t: Tables) -> DataFrame:
    c = t.customers
    m = lambda col: c.groupBy(F.col(col).alias("container")).agg(F.count("*").alias("measure")).withColumn("cap", F.lit(20).cast("long"))
    return moves.capacity_veto(m("folder"), m("new_folder"))


@query(_sql("select scc, count(distinct folder) homes, count(*) files from hm join cust on node = cust group by 1 having count(distinct folder) > 1", "hm", "cust"))
def cycle_homes(t: Tables) -> DataFrame:
    m = graph.condense(t.handover).join(t.customers.select(F.col("cust").alias("node"), F.col("file"), F.col("folder")), "node")
    return moves.cycle_homes(m)


@query(_sql("select scc, bool_or(acctbal < 0) pinned from hm join cust on node = cust group by 1", "hm", "cust"))
def pinned_components(t: Tables) -> DataFrame:
    m = graph.condense(t.handover).join(t.customers.select(F.col("cust").alias("node"), F.col("file"), (F.col("acctbal") < 0).alias("pinned")), "node")
    return moves.pinned_components(m)


@query("""with f as (select distinct p_type key, p_brand package, p_name as "domain" from part) select f.key, f.package, f.domain,
case when d.n > 1 then f.key || ' (' || f.package || ' ' || replace(f.domain, '/', '.') || ')' when p.n > 1 then f.key || ' (' || f.package || ')' else f.key end as label
from f join (select key, count(distinct package) n from f group by 1) p on f.key = p.key join (select key, package, count(*) n from f group by 1, 2) d on f.key = d.key and f.package = d.package""")
def folder_labels(t: Tables) -> DataFrame:
    return moves.folder_labels(t["part"].select(F.col("p_type").alias("key"), F.col("p_brand").alias("package"), F.col("p_name").alias("domain")))


_SIG = """select p.subject, p.source, p.destination, case when greatest(wd, ws) <= 0 then 0 else greatest(0.0, least(1.0, (wd - ws) / greatest(wd, ws))) end sc, case when wall > 0 then wd / wall * case c.nd when 0 then 0.0 when 1 then 0.5 else 1.0 end else 0.0 end dc, coalesce(o.n, 0) n_own, coalesce(o.nd, 0) nd_own, coalesce(r.reach, 0.0) reach, coalesce(ra.role, 0.0) role
from prop p left join (select p.subject, coalesce(sum(case when place = p.destination then weight end), 0) wd, coalesce(sum(case when place = p.source then weight end), 0) ws, coalesce(sum(weight), 0) wall, count(distinct case when place = p.destination then other end) nd from prop p left join near n on p.subject = n.subject group by 1) c on p.subject = c.subject
left join own o on p.subject = o.subject left join reach r on p.subject = r.subject left join ra on p.subject = ra.subject"""
_SIGC = dict(
    prop="select file subject, folder source, new_folder destination, [package, domain, new_folder] dseg from cust where folder <> new_folder",
    near="select src subject, dst other, b.folder place, weight from cedge join cust b on dst = b.file where weight > 0 union all select dst, src, a.folder, weight from cedge join cust a on src = a.file where weight > 0",
    own="select p.subject, count(distinct h.dst) n, count(distinct case when c.folder = p.destination then h.dst end) nd from prop p join he h on h.src * 8 = p.subject join cust c on h.dst = c.cust group by 1",
    lcp="select dst subject, count(distinct src) n, case when min(a.package) <> max(a.package) then [] when min(a.domain) <> max(a.domain) then [any_value(a.package)] when min(a.folder) <> max(a.folder) then [any_value(a.package), any_value(a.domain)] else [any_value(a.package), any_value(a.domain), any_value(a.folder)] end l from cedge join cust a on src = a.file group by 1",
    reach="select p.subject, case when n < 2 then 0.0 when len(l) >= 3 and l = dseg then 1.0 else 0.0 end reach from prop p join lcp on p.subject = lcp.subject",
    words="select distinct o_custkey * 8 subject, unnest(string_split(p_name, ' ')) w from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey",
    ra="""select p.subject, case when u = 0 then 0.0 else i / u end role from prop p join (select p.subject, (select count(*) from (select w from words x where x.subject = p.subject intersect select w from words x join cust c on x.subject = c.file where c.folder = p.destination)) i,
    (select count(*) from (select w from words x where x.subject = p.subject union select w from words x join cust c on x.subject = c.file where c.folder = p.destination)) u from prop p) q on p.subject = q.subject""",
)


def _signals(t: Tables) -> DataFrame:
    c = t.customers
    p = c.filter("folder <> new_folder").select(F.col("file").alias("subject"), F.col("folder").alias("source"), F.col("new_folder").alias("destination"), F.array("package", "domain", "new_folder").alias("destination_segments"))
    homes = c.select(F.col("file").alias("vertex"), F.col("file").alias("subject"), F.col("folder").alias("place"))
    e = _customer_edges(t)
    coh = advice.cohesion_signals(p, e, homes)
    own = advice.owner_signals(p, t.handover.select((F.col("dst") * 8).alias("owner"), (F.col("src") * 8).alias("companion")), homes)
    words = t["lineitem"].select("l_orderkey", "l_partkey").join(t["orders"].select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t["part"].select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    words = words.select((F.col("o_custkey") * 8).alias("subject"), F.split("p_name", " ").alias("tokens")).distinct().join(c.select(F.col("file").alias("subject"), F.col("folder").alias("place")), "subject")
    role = advice.role_affinity(p.withColumn("place_tokens", F.array().cast("array<string>")), words)
    use = e.select(F.col("dst").alias("subject"), F.col("src").alias("file")).join(c.select("file", F.array("package", "domain", "folder").alias("folder")), "file")
    reach = advice.architectural_reach(p, use)
    keys = ["subject", "source", "destination"]
    return coh.join(own, keys).join(role, keys).join(reach, keys)


@query(_sql(f"select subject, source, destination, round(case when n_own = 1 and nd_own = 1 then 1.0 else 0.0 end, 4)::double unique_owner, round(role, 4)::double role_affinity, round(sc, 4)::double source_cohesion, round(dc, 4)::double destination_cohesion, round(case when n_own > 0 then nd_own / n_own else 0 end, 4)::double producer_evidence, round(reach, 4)::double architectural_reach from ({_SIG})", "cedge", "cust", "he", **_SIGC))
def evidence_signals(t: Tables) -> DataFrame:
    return _signals(t).select("subject", "source", "destination", *[_r(s).alias(s) for s in advice.SIGNALS])


_W = "(0.1 * case when n_own = 1 and nd_own = 1 then 1.0 else 0.0 end + 0.1 * role + 0.25 * sc + 0.25 * dc + 0.1 * case when n_own > 0 then nd_own / n_own else 0 end + 0.2 * reach)"
_S = "((0.1 * case when n_own = 1 and nd_own = 1 then 1.0 else 0.0 end + 0.25 * sc + 0.25 * dc + 0.1 * case when n_own > 0 then nd_own / n_own else 0 end + 0.2 * reach) / 0.9)"


@query(_sql(f"select subject, destination, case when q then 1 else 0 end::bigint votes, q recommended, case when q then [] else list_filter([case when w < 0.6 then 'WeakEvidence' end, case when s < 0.5 then 'WeakStructuralEvidence' end, case when w < 0.15 then 'WeakAmbiguityMargin' end, 'NoMajoritySupport'], lambda x: x is not null) end reasons from (select *, w >= 0.6 and s >= 0.5 q from (select subject, destination, {_W} w, {_S} s from ({_SIG})))", "cedge", "cust", "he", **_SIGC))
def advice_consensus(t: Tables) -> DataFrame:
    """One profile, with no alternative place."""
    none = t.spark.createDataFrame([], "subject long, place long, score double")
    scored = advice.qualified(advice.margins(advice.weigh(_signals(t)), none))
    return advice.consensus(scored.withColumn("profile", F.lit("anchored")), 1)


# --- saved results -------------------------------------------------------------------------------


@query(_sql(f"select kind, severity, detail, hidden from (select *, row_number() over (order by case severity when 'Violation' then 0 else 1 end, kind, detail) k, greatest(0, count(*) over () - 5)::bigint hidden from ({_ALL})) where k <= 5", *_ALLN, caps=_CAPSQL))
def take_worst(t: Tables) -> DataFrame:
    """The display's five worst findings and how many it hides."""
    f = _all_findings(t).withColumn("key", F.struct(F.when(F.col("severity") == "Violation", 0).otherwise(1).alias("s"), "kind", "detail"))
    return moves.worst(f, "key").select("kind", "severity", "detail", "hidden")


@query(_sql("select kind || ' [' || severity || '] ' || detail as line from (" + _ALL + ")", *_ALLN, caps=_CAPSQL))
def violations_table(t: Tables) -> DataFrame:
    return _all_findings(t).select(F.concat("kind", F.lit(" ["), "severity", F.lit("] "), "detail").alias("line"))
