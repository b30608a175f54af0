from collections import deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from graphloom.operators import graph as G
from graphloom.operators import index_build as D
from graphloom.plans import render
from graphloom.plans.api import Index
from graphloom.plans.session import small_rows

EDGE = "src string, dst string, file string, edge_type string, ord bigint"


def frame(spark, edges, kind="call"):
    return spark.createDataFrame([(a, b, f"{a}.ts", kind, k) for k, (a, b) in enumerate(edges)], EDGE)


def starts(spark, *nodes):
    return spark.createDataFrame([(n, n) for n in nodes], "root string, node string")


def bfs(edges, start, depth):
    out, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for a, b in edges:
            if a == x and b not in out and out[x] < depth:
                out[b] = out[x] + 1
                queue.append(b)
    return out


def test_chain_and_cycle(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "c"), ("c", "d"), ("d", "e")]
    got = {r["node"]: r["hop"] for r in G.down_reach(frame(spark, edges), starts(spark, "a"), 3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r["node"] for r in G.up_reach(frame(spark, edges), starts(spark, "d"), 6).collect()} == {"d", "c", "b", "a"}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdefg"), st.sampled_from("abcdefg")), min_size=1, max_size=14), st.integers(1, 4))
def test_reach_is_breadth_first(spark, edges, depth):
    got = {r["node"]: r["hop"] for r in G.reach(frame(spark, edges), starts(spark, "a"), depth).collect()}
    assert got == bfs(edges, "a", depth)


def test_depth_is_clamped():
    assert [G.clamp_depth(x) for x in (None, 3, 99)] == [4, 3, 6]
    for bad in (0, -1):
        with pytest.raises(ValueError):
            G.clamp_depth(bad)
    with pytest.raises(ValueError):
        G.check_types(["nope"])


def test_first_type_after_filter(spark):
    edges = spark.createDataFrame([("a", "b", "f", "type", 0), ("a", "b", "f", "call", 1)], EDGE)
    assert D.adjacency(edges).first()["edge_type"] == "type"
    assert D.adjacency(edges, ["call"]).first()["edge_type"] == "call"


def test_fan_out_and_prune(spark):
    edges = frame(spark, [("a", f"b{k}") for k in range(9)])
    rows = G.fan_out(D.adjacency(edges)).collect()
    assert sorted(r["dst"] for r in rows) == [f"b{k}" for k in range(6)] and {r["hidden"] for r in rows} == {3}
    sims = spark.createDataFrame([("b7", 0.9), ("b1", 0.05)], "name string, max_sim double")
    assert [r["dst"] for r in G.semantic_prune(D.adjacency(edges), sims).collect()] == ["b7"]
    assert G.semantic_prune(D.adjacency(edges), sims.where("max_sim < 0.1")).count() == 9


def test_layer_passes_unknown_callees(spark):
    symbols = spark.createDataFrame([("x", "client/x.ts"), ("y", "apps/server/y.ts"), ("y", "apps/client/y.ts")], "name string, file string")
    edges = D.adjacency(frame(spark, [("a", "x"), ("a", "y"), ("a", "z")]))
    assert {r["dst"] for r in G.layer_pass(edges, symbols, "server").collect()} == {"y", "z"}
    assert {r["dst"] for r in G.layer_pass(edges, symbols, "client").collect()} == {"x", "y", "z"}


def test_scoping_and_fallback(spark):
    refs = spark.createDataFrame([("f", "one.ts", "a", "a.ts"), ("f", "one.ts", "b", "b.ts"), ("f", "two.ts", "a", "a.ts"), ("f", "three.ts", "b", "b.ts")], "sym string, from_file string, caller string, file string")
    imports = spark.createDataFrame([("a.ts", "one.ts"), ("c.ts", "three.ts")], "importer string, resolved string")
    got = {(r["from_file"], r["caller"]) for r in G.scope_callers(refs, imports).collect()}
    assert got == {("one.ts", "a"), ("two.ts", "a"), ("three.ts", "b")}


def test_impact_is_strict_and_reports_once(spark):
    edges = spark.createDataFrame(
        [("b", "a", "server/b.ts", "call", 0), ("c", "b", "server/c.ts", "jsx", 1), ("c", "a", "server/c.ts", "type", 2), ("t", "a", "server/t.test.ts", "call", 3), ("x", "a", "client/x.ts", "call", 4), ("d", "x", "server/d.ts", "call", 5)], EDGE
    )
    none = spark.createDataFrame([], "importer string, resolved string")
    start = spark.createDataFrame([("a", "a.ts")], "symbol string, file string")
    got = {(r["hop"], r["symbol"], r["edge_type"]) for r in G.impact(edges, none, start, 4, layer="server").collect()}
    assert got == {(1, "b", "call"), (1, "c", "type")}
    rows = G.impact_summary(G.impact(edges, none, start, 4)).collect()
    assert {(r["hop"], r["label"], r["edge_type"], r["n"]) for r in rows} == {(1, "direct", "call", 2), (1, "direct", "type", 1), (2, "indirect", "call", 1)}
    assert G.impact(edges, none, spark.createDataFrame([("zz", None)], "symbol string, file string"), 2).count() == 0


def test_depth_first_tree_marks_repeats(spark):
    edges = frame(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("c", "d")])
    none = spark.createDataFrame([], "name string, file string")
    capped = G.down_capped(edges, none, starts(spark, "a"), 4)
    got = render.down_rows(capped, "a", 4)
    assert got == [
        (1, "a", "b", "call", False), (2, "b", "c", "call", False), (3, "c", "a", "call", False), (4, "a", "b", "call", True), (4, "a", "c", "call", False), (3, "c", "d", "call", False), (1, "a", "c", "call", True),
    ]
    assert render.render_down(capped, "a", 4).splitlines()[0] == "a"


def test_up_tree_of_index(spark):
    symbols = spark.createDataFrame([("f", "one.ts"), ("g", "a.ts"), ("h", "b.ts")], "name string, file string")
    edges = spark.createDataFrame([("g", "f", "a.ts", "call", 0), ("h", "g", "b.ts", "call", 1), ("k", "f", "x.spec.ts", "call", 2)], EDGE)
    imports = spark.createDataFrame([("a.ts", "m", "one.ts"), ("b.ts", "m", "a.ts")], "importer string, module string, resolved string")
    index = Index(spark, {"symbols": symbols, "edges": edges, "imports": imports, "files": symbols.select(symbols["file"].alias("path"))})
    got = [(r["hop"], r["sym"], r["file"], r["distance"], r["callers"]) for r in index.graph("f").orderBy("hop").collect()]
    assert got == [(1, "f", "a.ts", 1, ["g"]), (2, "g", "b.ts", 2, ["h"])]
    assert {(r["hop"], r["symbol"]) for r in index.graph("f", mode="impact").collect()} == {(1, "g"), (2, "h")}
    assert {r["dst"] for r in index.graph("h", "down").collect()} == {"g", "f"}
    for bad in ("nope",):
        with pytest.raises(LookupError):
            index.graph(bad)
        with pytest.raises(LookupError):
            index.graph(bad, "down")
    tree = render.up_rows({("f", "one.ts"): [("a.ts", "g", ["g"])], ("g", "a.ts"): [("b.ts", "h", ["h"])]}, "f", "one.ts", 3)
    assert tree == [(1, "g", "a.ts", False), (2, "h", "b.ts", False)]


@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_capped_walk_ranks_only_what_it_reaches(spark, monkeypatch, limit):
    edges = [("a", f"b{k}") for k in range(9)] + [("b0", "a"), ("b0", "b1"), ("b1", "c"), ("b8", "z"), ("c", "d"), ("d", "e")] + [(f"x{k}", f"y{k}") for k in range(200)]
    seen, plain = [], G.adjacency
    monkeypatch.setattr(G, "adjacency", lambda e, types=None: (seen.append(e.count()), plain(e, types))[1])
    monkeypatch.setattr(G, "small_rows", lambda df, column: small_rows(df, column, limit))
    none = spark.createDataFrame([], "name string, file string")
    both = spark.createDataFrame([("a", "a"), ("b1", "b1")], "root string, node string")
    rows = {(r["root"], r["hop"], r["src"], r["dst"], r["hidden"]) for r in G.down_capped(frame(spark, edges + edges), none, both, 4).collect()}
    tree = {("a", 1, "a", f"b{k}", 3) for k in range(6)} | {("a", 2, "b0", "a", 0), ("a", 2, "b0", "b1", 0), ("a", 2, "b1", "c", 0), ("a", 3, "c", "d", 0), ("a", 4, "d", "e", 0)}
    assert rows == tree | {("b1", 1, "b1", "c", 0), ("b1", 2, "c", "d", 0), ("b1", 3, "d", "e", 0)}
    # both copies of the edges of a, b1, b0, c and d, once each
    assert sum(seen) == 2 * (9 + 1 + 2 + 1 + 1)
