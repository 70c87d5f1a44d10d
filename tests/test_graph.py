"""Dependency graphs (W2, G1-G3) against direct plain-Python walks."""

import random

import pytest

from repolens.operators import graph as G


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def _nodes(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "node bigint")


def _adj(pairs):
    adj = {}
    for s, d in pairs:
        adj.setdefault(s, set()).add(d)
    return adj


def test_reachable_and_reverse(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (7, 1)]
    inst = _nodes(spark, [1, 2, 3, 4, 5, 6, 7])
    got = sorted(r.node for r in G.reachable(_edges(spark, pairs), _nodes(spark, [1, 99]), inst).collect())
    assert got == [1, 2, 3, 4]
    back = sorted(r.node for r in G.reachable(_edges(spark, pairs), _nodes(spark, [4]), inst, direction="in").collect())
    assert back == [1, 2, 3, 4, 7]


def _py_branches(adj, root, max_depth):
    out = []

    def walk(node, path, depth):
        for c in sorted(adj.get(node, ()), key=str):
            if c in path:
                out.append((root, depth + 1, node, c, True))
                continue
            out.append((root, depth + 1, node, c, False))
            if depth + 1 < max_depth:
                walk(c, path + [c], depth + 1)
    out.append((root, 0, None, root, False))
    walk(root, [root], 0)
    return out


def test_dep_tree_matches_recursive_walk(spark):
    rnd = random.Random(3)
    pairs = sorted({(rnd.randint(1, 12), rnd.randint(1, 12)) for _ in range(30)})
    pairs = [(a, b) for a, b in pairs if a != b]
    adj = _adj(pairs)
    roots = [1, 2, 3]
    got = sorted((r.root, r.depth, r.parent, r.node, r.recursive)
                 for r in G.dep_tree(_edges(spark, pairs), _nodes(spark, roots), max_depth=4).collect())
    want = sorted(x for root in roots for x in _py_branches(adj, root, 4))
    assert got == want


def _check_display(rows, edges, roots):
    """Properties that define the display tree: per root, every edge of a
    reached node is shown once; a node is expanded exactly once, at the
    smallest of its simple paths when children are read in name order; all
    other showings are marked repeated."""
    out = {}
    for s, d in edges:
        out.setdefault(str(s), set()).add(str(d))
    for root in map(str, roots):
        mine = [r for r in rows if r[0] == root]
        best, todo = {}, [(root,)]
        while todo:  # smallest simple path of every reached node
            path = todo.pop()
            if path[-1] not in best or path < best[path[-1]]:
                best[path[-1]] = path
                todo += [(*path, c) for c in out.get(path[-1], ()) if c not in path]
        assert sorted((r[2], r[3]) for r in mine if r[1]) == sorted((p, c) for p in best for c in out.get(p, ()))
        assert sorted(r[3] for r in mine if not r[4]) == sorted(best)
        for _, depth, parent, node, repeated in mine:
            if parent is not None:
                assert depth == len(best[parent]) and repeated == (best[node] != (*best[parent], node))


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_preorder_tree_matches_dfs(spark, seed):
    rnd = random.Random(seed)
    n = rnd.randint(5, 14)
    pairs = sorted({(rnd.randint(1, n), rnd.randint(1, n)) for _ in range(rnd.randint(n, 3 * n))})
    pairs = [(a, b) for a, b in pairs if a != b]
    roots = rnd.sample(range(1, n + 1), 3)
    _check_display([(r.root, r.depth, r.parent, r.node, r.repeated)
                    for r in G.preorder_tree(_edges(spark, pairs), _nodes(spark, roots)).collect()], pairs, roots)


def test_preorder_missing_root(spark):
    out = G.preorder_tree(_edges(spark, [(1, 2)]), _nodes(spark, [1, 42]), _nodes(spark, [1, 2])).collect()
    assert [(r.root, r.missing) for r in out if r.missing] == [("42", True)]


def test_reverse_deps_first_requirement(spark):
    dists = spark.createDataFrame([(1, "app", "1.0"), (2, "lib", "2.0")], "p_partkey bigint, name string, version string")
    req = spark.createDataFrame([(1, 0, "Target_Pkg>=1"), (1, 1, "target-pkg[x]<3"), (2, 0, "other"), (2, 1, "TARGET-PKG")],
                                "p_partkey bigint, pos int, requirement string")
    got = sorted((r.target, r.package, r.requirement) for r in G.reverse_deps(dists, req).collect())
    assert ("target-pkg", "app", "Target_Pkg>=1") in got and ("target-pkg", "lib", "TARGET-PKG") in got
    assert len([g for g in got if g[0] == "target-pkg"]) == 2


def test_registered_preorder_query_matches_dfs(spark):
    """The registered query itself, on the sf0.001 tables, against the
    properties of the display tree."""
    import __spark_entry__ as E
    from repolens.plans.graph_plans import _graph
    from repolens.sources.tables import Tables

    from .conftest import SF_SMALL

    edges, roots, inst = _graph(Tables(spark, SF_SMALL))
    pairs = [(r.src, r.dst) for r in edges.collect()]
    root_ids = [r.node for r in roots.collect()]
    got = [(r.root, r.depth, r.parent, r.node, r.repeated)
           for r in E.queries()["preorder_tree"](spark, SF_SMALL).where("NOT missing").collect()]
    assert {r[0] for r in got} == {str(x) for x in root_ids}
    _check_display(got, pairs, root_ids)


def test_dep_tree_unbounded_matches_full_walk(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (2, 4), (4, 5), (1, 5)]
    adj = _adj(pairs)
    got = sorted((r.root, r.depth, r.parent, r.node, r.recursive)
                 for r in G.dep_tree(_edges(spark, pairs), _nodes(spark, [1]), max_depth=None).collect())
    assert got == sorted(_py_branches(adj, 1, 10 ** 6))


def test_reachable_by_jumps_needs_few_rounds(spark, monkeypatch):
    """A chain of 10,000 nodes, rings and forks: the rows of a plain walk,
    in rounds that grow with the logarithm of the chain."""
    import random

    from repolens.operators import graph as G

    rounds = []
    plain = G._ckpt
    monkeypatch.setattr(G, "_ckpt", lambda df: rounds.append(1) or plain(df))
    chain = spark.range(10_000).selectExpr("id AS src", "id + 1 AS dst")
    start = spark.createDataFrame([(7,)], "node long")
    assert G.reachable_by_jumps(chain, start).agg({"node": "sum"}).first()[0] == sum(range(7, 10_001))
    assert len(rounds) < 60
    back = G.reachable_by_jumps(chain, start, direction="in")
    assert sorted(r["node"] for r in back.collect()) == list(range(8))
    random.seed(4)
    for _ in range(3):
        edges = {(a, (a + 1) % 30) for a in range(30)} | {(a, a + 1) for a in range(40, 60)} | {(random.randrange(70), random.randrange(70)) for _ in range(12)}
        reach = todo = {3, 45}
        while todo:
            todo = {b for a, b in edges if a in todo} - reach
            reach = reach | todo
        got = G.reachable_by_jumps(spark.createDataFrame(sorted(edges), "src long, dst long"), spark.createDataFrame([(3,), (45,), (45,)], "node long"))
        assert sorted(r["node"] for r in got.collect()) == sorted(reach)
    none = G.reachable_by_jumps(chain.limit(0), start)
    assert [r["node"] for r in none.collect()] == [7]


def _stored(monkeypatch):
    """Rows that the operators write or checkpoint."""
    counts = []
    for name in ("_ckpt", "_written"):
        if plain := getattr(G, name, None):
            def keep(df, plain=plain):
                counts.append((out := plain(df)).count())
                return out
            monkeypatch.setattr(G, name, keep)
    return counts


def test_trees_store_edges_not_branches_or_labels(spark, monkeypatch):
    """Twelve diamonds in a row have 2^12 branches on 48 edges, a chain has
    one label of each length: what is stored follows the edges."""
    stored = _stored(monkeypatch)
    diamonds = [(3 * k + a, 3 * k + b) for k in range(12) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3))]
    assert G.dep_tree(_edges(spark, diamonds), _nodes(spark, [0])).count() == 1 + sum(2 * 2 ** (k + 1) for k in range(12))
    assert sum(stored) < 250
    stored.clear()
    chain = [(k, k + 1) for k in range(30)]
    assert G.preorder_tree(_edges(spark, chain), _nodes(spark, [0])).count() == 31
    assert sum(stored) < 150


def test_roots_too_large_for_a_task(spark, monkeypatch):
    """Roots with more edges (1) or branches (41) than a task takes are walked by joins, with the same rows."""
    rnd = random.Random(5)
    pairs = sorted({(a, b) for a, b in ((rnd.randint(1, 6), rnd.randint(1, 6)) for _ in range(14)) if a != b})
    pairs += [(20, 21)] + [(a, b) for a in (41, 42, 43) for b in (41, 42, 43) if a != b]
    monkeypatch.setattr(G, "ROOT_EDGES", 7)
    monkeypatch.setattr(G, "ROOT_BRANCHES", 5)
    edges, roots = _edges(spark, pairs), _nodes(spark, [1, 20, 41])
    got = sorted((r.root, r.depth, r.parent, r.node, r.recursive) for r in G.dep_tree(edges, roots).collect())
    assert got == sorted(x for root in (1, 20, 41) for x in _py_branches(_adj(pairs), root, 10 ** 6))
    _check_display([(r.root, r.depth, r.parent, r.node, r.repeated) for r in G.preorder_tree(edges, roots).collect()], pairs, [1, 20, 41])


def test_no_table_passes_through_the_driver(spark, monkeypatch, capsys):
    """No join of a round or of the graph's views is a broadcast."""
    from repolens.plans.graph_plans import _graph, _tree
    from repolens.sources.tables import Tables

    from .conftest import SF_SMALL

    for name in ("_ckpt", "_written"):
        if plain := getattr(G, name, None):
            monkeypatch.setattr(G, name, lambda df, plain=plain: (df.explain(), plain(df))[1])
    for df in (*_graph(Tables(spark, SF_SMALL))[:2], *_tree(Tables(spark, SF_SMALL))[:2]):
        df.explain()
    edges, roots = _edges(spark, [(1, 2), (2, 3), (1, 3)]), _nodes(spark, [1])
    for walk in (G.reachable, G.reachable_by_jumps, G.dep_tree, G.preorder_tree):
        walk(edges, roots, roots).explain()
    plans = capsys.readouterr().out
    assert "SortMergeJoin" in plans and "Broadcast" not in plans


def test_dep_tree_stores_edges_shared_by_roots_once_a_group(spark, monkeypatch):
    """2,000 roots over a chain of 8 reach 18,000 edges: 8 for each of 64 groups and one for each root."""
    stored = _stored(monkeypatch)
    pairs = [(k, k + 1) for k in range(8)] + [(r, 0) for r in range(1000, 3000)]
    assert G.dep_tree(_edges(spark, pairs), _nodes(spark, range(1000, 3000))).count() == 2000 * 10
    assert sum(stored) < 12_000


@pytest.mark.parametrize("limits", [{"BATCH": 3, "BATCH_NODES": 5, "MASK": 2}, {"GROUP_EDGES": 4, "ROOT_EDGES": 11, "ROOT_BRANCHES": 6}])
def test_branches_in_arrays(spark, monkeypatch, limits):
    """Branches followed many at a time are those of a plain walk: edges that
    come twice, null children, loops, a hub, names with versions; paths as arrays or text."""
    for name, value in limits.items():
        monkeypatch.setattr(G, name, value)
    pairs = [(1, 2), (2, 3), (3, 1), (1, 3), (3, 4), (2, 2), (3, None), (None, 4), (5, 4), (1, 2)] + [(30, k) for k in range(31, 40)] + [(31, 30), (32, 1)]
    roots = [1, 3, 5, 30, 77, None]
    want = []

    def walk(path):
        for s, d in pairs:
            if s == path[-1] and s is not None:
                again = None if d is None else d in path
                want.append((path[0], len(path), s, d, (*path, d), again))
                if again is False:
                    walk((*path, d))
    for root in roots:
        want.append((root, 0, None, root, (root,), False))
        walk((root,))
    name = lambda k: None if k is None else f"n{k}"
    text = lambda path: ">".join(str(k) for k in path if k is not None)
    order = lambda rows: sorted(rows, key=str)
    edges, starts = _edges(spark, pairs), _nodes(spark, roots)
    rows = G.dep_tree(edges, starts).collect()
    assert order((r.root, r.depth, r.parent, r.node, tuple(r.path), r.recursive) for r in rows) == order(want)
    if "ROOT_EDGES" in limits:
        return
    rows = G.dep_tree(edges, starts, sep=">", max_depth=3).collect()
    assert order((r.root, r.depth, r.parent, r.node, r.path, r.recursive) for r in rows) == order((*w[:4], text(w[4]), w[5]) for w in want if w[1] <= 3)
    named = spark.createDataFrame([(name(s), name(d), f"v{d}") for s, d in pairs], "src string, dst string, version string")
    tops = spark.createDataFrame([(name(k), f"v{k}") for k in roots if k], "node string, version string")
    rows = G.dep_tree(named, tops, tag="version").collect()
    assert order((r.root, r.depth, r.parent, r.node, tuple(r.path), r.recursive, r.version) for r in rows) == order(
        (name(w[0]), w[1], name(w[2]), name(w[3]), tuple(map(name, w[4])), w[5], f"v{w[3]}") for w in want if w[0])
