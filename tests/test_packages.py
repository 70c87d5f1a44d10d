"""Package graphs by name against walks of the same graph in Python."""

import random

from repolens.operators import packages as P

DISTS = "p_partkey int, name string, version string"
REQS = "p_partkey int, pos int, requirement string"


def _graph(seed, n=40):
    """Names whose order is not that of their keys, edges with cycles."""
    random.seed(seed)
    names = {k: f"{random.choice('abcXYZ')}_{random.choice('pq')}{(k * 37) % 101}" for k in range(n)}
    edges = {(a, random.randrange(n)) for a in range(n) for _ in range(random.choice([0, 1, 1, 2]))}
    return names, edges


def _frames(spark, names, edges):
    dists = [(k, x, f"{k}.0") for k, x in names.items()] + [(1000, None, "9")]
    reqs = [(a, b, f"{names[b].upper().replace('_', '-')}[extra]>=1") for a, b in edges] + [(0, 99, "not-here>=2"), (0, 100, "(bad"), (0, 101, None)]
    return spark.createDataFrame(dists, DISTS), spark.createDataFrame(reqs, REQS)


def _norm(x):
    return x.replace("_", "-").lower()


def test_graph_operators_by_name(spark):
    for seed in (1, 2):
        names, edges = _graph(seed)
        norm = {k: _norm(x) for k, x in names.items()}
        shown = {norm[k]: (x, f"{k}.0") for k, x in names.items()}
        nxt = {}
        for a, b in edges:
            nxt.setdefault(norm[a], set()).add(norm[b])
        pkgs = P.package_graph(*_frames(spark, names, edges))
        assert [r["norm"] for r in sorted(pkgs.nodes.collect(), key=lambda r: r["node"])] == sorted(shown)
        start = [names[k] for k in (0, 3, 5)]
        refs = spark.createDataFrame([(x,) for x in [*start, start[0], "gone_pkg", None]], "ref string")
        roots = P.package_roots(pkgs, refs)

        tree = []

        def walk(root, node, path):
            tree.append((shown[root][0], shown[path[-1]][0] if path else None, shown[node][0], shown[node][1], len(path), node in path, [shown[p][0] for p in [*path, node]]))
            if node not in path:
                for c in nxt.get(node, ()):
                    walk(root, c, [*path, node])

        rows, reach = [], set()

        def display(root, node, parent, depth, seen):
            first = node not in seen
            rows.append((shown[root][0], parent, *shown[node], depth, not first, False))
            if first:
                seen.add(node)
                for c in sorted(nxt.get(node, ())):
                    display(root, c, shown[node][0], depth + 1, seen)

        for x in map(_norm, start):
            walk(x, x, [])
            seen = set()
            display(x, x, None, 0, seen)
            reach |= seen
        key = lambda rows: sorted(map(tuple, rows), key=str)
        assert key(P.package_tree(pkgs, roots).select("root", "parent", "node", "version", "depth", "recursive", "names").collect()) == key(tree)
        rows.append(("gone-pkg", None, "gone-pkg", None, 0, False, True))
        assert key(P.package_display(pkgs, roots).select("root", "parent", "node", "version", "depth", "repeated", "missing").collect()) == key(rows)
        assert key(P.package_reach(pkgs, roots).collect()) == key(shown[x] for x in reach)


def test_two_distributions_of_one_name_and_no_rows(spark):
    dists = spark.createDataFrame([(1, "A_b", "1"), (2, "a-B", "2"), (3, "c", "3")], DISTS)
    reqs = spark.createDataFrame([(2, 0, "c"), (1, 0, "c"), (3, 0, "a_b")], REQS)
    pkgs = P.package_graph(dists, reqs)
    assert sorted(tuple(r) for r in pkgs.nodes.collect()) == [(1, "a-b", "A_b", "1"), (2, "c", "c", "3")]
    assert sorted(tuple(r) for r in pkgs.edges.collect()) == [(1, 2), (2, 1)]
    none = P.package_roots(pkgs, spark.createDataFrame([], "ref string"))
    assert P.package_tree(pkgs, none).count() == P.package_reach(pkgs, none).count() == P.package_display(pkgs, none).count() == 0
    empty = P.package_graph(dists.limit(0), reqs.limit(0))
    roots = P.package_roots(empty, spark.createDataFrame([("x",)], "ref string"))
    assert P.package_display(empty, roots).count() == 1 and P.package_reach(empty, roots).count() == 0
