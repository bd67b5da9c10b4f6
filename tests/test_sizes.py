"""What must not grow with the tables: rows between shuffles, and rows of one task."""

import random

from keelson.plans.projections import Tables
from keelson.session import ADVISED, partitions, spread
from keelson.sources import brace_source


def test_pairs_of_advisory_names_are_not_shuffled(spark):
    rng = random.Random(2)
    nodes = [(i, f"p{i % 7}", i % 3 == 0) for i in range(60)]
    names = [(rng.randrange(70), f"p{rng.randrange(9)}", rng.random() < 0.5) for _ in range(300)]
    got = brace_source.advisory_uses(spark.createDataFrame(names, "user long, name string, from_test boolean"), spark.createDataFrame(nodes, "id long, name string, test_source boolean"))
    want, test = {}, {i: t for i, _, t in nodes}
    for user, name, from_test in names:
        for i, other, source in nodes:
            if other == name and not source and user != i and user in test:
                want[user, i] = want.get((user, i), True) and from_test
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and {r[:2]: r[2] for r in rows} == {k: v or test[k[0]] for k, v in want.items()}
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in text[: text.index("Join")]


def test_partitions_follow_the_largest_table(spark, tmp_path):
    kept = {k: spark.conf.get(k, None) for k in (ADVISED, "spark.sql.shuffle.partitions")}
    try:
        spread(spark, str(tmp_path / "none.parquet"))
        assert partitions(spark) == int(kept["spark.sql.shuffle.partitions"]) and int(spark.conf.get(ADVISED)) == 8 << 20
        (tmp_path / "lineitem.parquet").write_bytes(b"x" * (50 << 20))
        spread(spark, str(tmp_path / "lineitem.parquet"))
        assert partitions(spark) == 13
        spark.conf.set(ADVISED, "4m")
        spread(spark, str(tmp_path / "none.parquet"))
        assert int(spark.conf.get(ADVISED)) == 4 << 20 and partitions(spark) == 13
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def tables(spark, folder, lines, orders):
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_discount double, l_linestatus string").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    return Tables(spark, str(folder))


def test_shared_projections_sort_once(spark, tmp_path):
    import datetime as dt

    rng = random.Random(3)
    day = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(5)]
    orders = [(k, rng.randrange(6), rng.choice([*day, None]), rng.choice(["1-URGENT", "5-LOW", "odd", None])) for k in range(40)]
    lines = [(rng.randrange(42), rng.randrange(4), float(rng.randrange(2)), rng.choice([0.0, 0.1]), rng.choice(["O", "F"])) for _ in range(200)]
    t = tables(spark, tmp_path, [*lines, *lines[:50]], orders)
    by, groups, weight = {o[0]: o for o in orders}, {}, {}
    for o, p, q, d, _ in set(lines):
        if o in by:
            groups.setdefault((p, q, d), set()).add((by[o][2] is not None, by[o][2] or day[0], o, by[o][1]))
    for g in groups.values():
        g = sorted(g)
        for a, b in zip(g, g[1:]):
            if a[3] != b[3]:
                weight[a[3], b[3]] = weight.get((a[3], b[3]), 0.0) + 1.0
    assert {(r.src, r.dst): r.weight for r in t.handover.collect()} == weight
    text = t.handover._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate") == 1  # the sum over pairs alone; equal rows are left out as they lie side by side
    kinds = {"1-URGENT": "ValueImport", "5-LOW": "ReExport"}
    for r in t.org_edges.collect():
        mine = [x for x in lines if x[0] == r.source]
        assert r.kind == kinds.get(by[r.source][3]) and r.hardness in {"Hard" if x[4] == "O" else "Soft" for x in mine} and round(1 - r.confidence, 4) in {x[3] for x in mine}


def test_nominations_join_each_edge_once(spark):
    from keelson.operators import symbols

    e = spark.createDataFrame([(1, 2, 1.0), (3, 1, 2.0), (4, 1, 0.5), (1, 5, 0.25), (5, 6, 1.0)], "source long, target long, weight double")
    n = spark.createDataFrame([(1, "Type", 10), (2, "Symbol", 10), (3, "Symbol", 20), (4, "FileBody", 30), (5, "Symbol", 40), (6, None, 20)], "id long, kind string, file long")
    aff = spark.createDataFrame([(2, 5)], "owner long, companion long")
    got = symbols.nominations(e, n, spark.createDataFrame([(30,)], "file long"), aff)
    rows = {(r.id, r.file): (round(r.pull, 6), r["rank"]) for r in got.collect()}
    assert rows == {(1, 20): (2.0, 1), (3, 10): (2.0, 1), (5, 20): (1.0, 1), (5, 10): (0.3, 2)}
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate") == 1  # what stays is looked up beside the pulls, not made again
