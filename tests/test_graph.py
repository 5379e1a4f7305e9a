"""Graph operators on two small clusters, against plain versions."""

import math

import pytest
from pyspark.sql import functions as F

from siltstone.operators import graph as G
from siltstone.operators import vectors as V

EDGES = [("a1", "a2"), ("a2", "a3"), ("a3", "a1"), ("b1", "b2"), ("b2", "b1"), ("a1", "b1")]
NODES = ["a1", "a2", "a3", "b1", "b2", "lone"]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(n, "file", n, f"src/{n}.py", 1, 9, False, n == "b2", 0, i) for i, n in enumerate(NODES)], "id string, type string, label string, file_path string, start_line int, end_line int, changed boolean, is_test boolean, finding_count int, ord int")
    edges = spark.createDataFrame([(f"{a}>{b}", a, b, "imports", i) for i, (a, b) in enumerate(EDGES)], "id string, source string, target string, type string, ord int")
    return nodes, edges


def plain_pagerank(nodes, edges, d=0.85, rounds=30):
    near = {n: set() for n in nodes}
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    rank = {n: 1 / len(nodes) for n in nodes}
    for _ in range(rounds):
        loose = sum(rank[n] for n in nodes if not near[n])
        rank = {n: (1 - d) / len(nodes) + d * loose / len(nodes) + sum(d * rank[m] / len(near[m]) for m in near[n]) for n in nodes}
    return {n: r / max(rank.values()) for n, r in rank.items()}


def test_pagerank(graph):
    nodes, edges = graph
    got = {r.id: r["rank"] for r in G.pagerank(edges, nodes).collect()}
    want = plain_pagerank(NODES, EDGES)
    assert got.keys() == want.keys() and all(math.isclose(got[n], want[n], rel_tol=1e-9) for n in NODES)
    assert max(got.values()) == 1.0 and min(got, key=got.get) == "lone"
    assert G.pagerank(edges.limit(0), nodes.limit(0)).count() == 0


def test_embedding(graph):
    nodes, edges = graph
    base = G.node_features(nodes, edges)
    out = {r.id: r.v for r in G.propagate(edges, nodes, base, 65).collect()}
    again = {r.id: r.v for r in G.propagate(edges, nodes, base, 65).collect()}
    assert all(len(v) == 65 and math.isclose(sum(x * x for x in v), 1.0, rel_tol=1e-9) for v in out.values())
    assert all(math.isclose(x, y, abs_tol=1e-12) for n in out for x, y in zip(out[n], again[n]))
    dot = lambda m, a, b: sum(x * y for x, y in zip(m[a], m[b]))
    raw = {r.id: r.v for r in base.collect()}
    assert dot(out, "a1", "a2") > dot(raw, "a1", "a2")
    near = {n: {n} for n in NODES}
    for a, b in EDGES:
        near[a].add(b), near[b].add(a)
    plain = raw
    for _ in range(2):
        plain = {n: [sum(plain[m][i] / math.sqrt(len(near[n]) * len(near[m])) for m in near[n]) for i in range(65)] for n in NODES}
    for n in NODES:
        size = math.sqrt(sum(x * x for x in plain[n]))
        assert all(math.isclose(x / size, y, abs_tol=1e-9) for x, y in zip(plain[n], out[n]))


def test_walks(spark, graph):
    nodes, edges = graph
    start = spark.createDataFrame([("b1",)], "start string")
    assert {(r.id, r.depth) for r in G.blast_radius(edges, start, 3).collect()} == {("a1", 1), ("b2", 1), ("a3", 2), ("a2", 3)}
    assert {r.id for r in G.dependencies(edges, start, 2).collect()} == {"b2"}
    assert {(r.id, r.test) for r in G.covering_tests(edges, nodes).collect()} == {("b1", "b2")}
    paths = G.shortest_paths(edges, spark.createDataFrame([("a2", "b2"), ("b1", "a1")], "a string, b string")).collect()
    assert [r.path for r in paths] == [["a2", "a3", "a1", "b1", "b2"]]
    assert sorted(r.cycle for r in G.short_cycles(edges).collect()) == [["a1", "a2", "a3"], ["b1", "b2"]]
    assert {r.id for r in G.cyclic_core(edges).collect()} == {"a1", "a2", "a3", "b1", "b2"}
    hit = G.impact(edges, spark.createDataFrame([("b1",), ("none",)], "origin string")).collect()
    assert {r.origin: (r.nodes, len(r.edges)) for r in hit} == {"b1": (["a1", "a3", "b1", "b2"], 4), "none": (["none"], 0)}
    assert {r.id: r.ring for r in G.ring_distance(edges, nodes, "a1").collect()} == {"a1": 0, "a2": 1, "a3": 1, "b1": 1, "b2": 2, "lone": 3}


def test_assembly_and_resolution(spark):
    nodes = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), ("c", 4)], "id string, ord int")
    edges = spark.createDataFrame([("e", "a", "b", 1), ("e", "b", "a", 2), ("f", "a", "zz", 3), ("g", "b", "c", 4)], "id string, source string, target string, ord int")
    n, e = G.assemble(nodes, edges, max_nodes=2)
    assert sorted((r.id, r.ord) for r in n.collect()) == [("a", 1), ("b", 3)] and [r.id for r in e.collect()] == ["e"]
    imports = spark.createDataFrame([(1, "./util", "web/app.ts"), (2, "pkg.mod", "main.py"), (3, ".near", "pkg/x.py"), (4, "react", "web/app.ts")], "ord int, module string, file_path string")
    paths = spark.createDataFrame([("web/util.ts",), ("web/util/index.ts",), ("pkg/mod/__init__.py",), ("pkg/near.py",)], "path string")
    assert {r.ord: r.resolved for r in G.resolve_imports(imports, paths).collect()} == {1: "web/util.ts", 2: "pkg/mod/__init__.py", 3: "pkg/near.py", 4: None}
    calls = spark.createDataFrame([(1, "x.y.run"), (2, "gone")], "ord int, callee string")
    symbols = spark.createDataFrame([("s2", "run", 5), ("s1", "run", 3)], "id string, name string, ord int")
    assert {r.ord: r.target for r in G.resolve_calls(calls, symbols).collect()} == {1: "s1", 2: None}


def test_neighbours(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])], "id string, v array<double>")
    got = [(r.id, r["rank"]) for r in V.neighbours(df, df.where("id = 'a'"), 2, 0.25).collect()]
    assert got == [("b", 1)]
    e = df.select(V.embed(F.lit("def getUser(user_id): return db.query(user_id)")).alias("e")).first().e
    assert len(e) == 512 and math.isclose(sum(x * x for x in e), 1.0, rel_tol=1e-9)
    assert sum(df.select(V.embed(F.lit("")).alias("e")).first().e) == 0
