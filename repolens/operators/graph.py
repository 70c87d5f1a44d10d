"""Dependency graphs as edge tables.

Edges are ``(src, dst)`` rows between installed packages (see
``audit.installed_edges``).  Iterative operators run one Spark job per round
from the driver: a frontier join against the edge table, an anti join (or
min-label aggregate) against what is known, and a reliable ``checkpoint()``
into the session's checkpoint folder so lineage stays one round deep and a
lost executor only recomputes the current round.  The driver only reads
``isEmpty`` per round to decide termination; all joins are dealt by key
(``by_key``), so no table passes through it for a broadcast.

The display tree (G3) finds the edges that each root reaches in such rounds,
deals them by root and walks one root after another in tasks.  The tree of all
branches (G1) does so by groups of roots, whose shared edges are found, dealt
and held once, and lists the branches of a group many at a time, as arrays.
Roots with more edges or branches than a task should hold or list are walked
level by level with joins instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, IntegralType, StringType, StructField, StructType

from ..functions.names import normalize_name, requirement_name
from ..session import scratch_folder

#: Edges of one root that a task holds, branches of one root that it lists.
ROOT_EDGES, ROOT_BRANCHES = 500_000, 1_000_000
#: Edges of a group of roots that a task holds; roots of a group, and groups that share a mask.
GROUP_EDGES, GROUP_ROOTS, MASK = 2_000_000, 50_000, 64
#: Rows of an Arrow batch that a walk returns (up to twice as many in G1), and nodes on their paths.
BATCH, BATCH_NODES = 10_000, 1_000_000


def _ckpt(df: DataFrame) -> DataFrame:
    return df.checkpoint(eager=True)


def _written(df: DataFrame) -> DataFrame:
    """As ``_ckpt``, in compressed columns: for tables that grow with the result."""
    path = scratch_folder(df.sparkSession, "graph")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_key(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the graph: dealt by key, never broadcast."""
    return df.hint("merge")


def reverse_deps(dists: DataFrame, requires: DataFrame, key_col: str = "p_partkey") -> DataFrame:
    """For every target name, the packages that require it, each with
    the *first* (lowest position) of its matching requirement strings.
    Output ``target, package, version, requirement``."""
    r = requires.select(F.col(key_col).alias("_k"), "pos", "requirement",
                        normalize_name(requirement_name("requirement"), strip_extras=False).alias("target"))
    r = r.where(F.col("target").isNotNull())
    first = r.groupBy("_k", "target").agg(F.min_by("requirement", "pos").alias("requirement"))
    d = dists.select(F.col(key_col).alias("_k"), F.col("name").alias("package"), "version")
    return first.join(d, "_k").select("target", "package", "version", "requirement")


def _installed_roots(roots: DataFrame, installed: DataFrame | None) -> DataFrame:
    r = roots.select(F.col("node")).distinct()
    if installed is not None:
        r = r.join(by_key(installed.select("node").distinct()), "node", "left_semi")
    return r


def reachable(edges: DataFrame, roots: DataFrame, installed: DataFrame | None = None, direction: str = "out",
              compact_every: int = 8) -> DataFrame:
    """The distinct nodes reachable from any root (roots included; a root
    that is not installed is omitted).  ``direction="in"`` walks edges
    backwards (transitive reverse dependencies).

    Each round joins the frontier to the edges and keeps what is new; only
    the new frontier is checkpointed.  The visited set is the union of the
    rounds' frontiers, written as one table every ``compact_every`` rounds.
    Rounds go on until nothing new is found (graph depth)."""
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")) if direction == "out" else \
        edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    e = _ckpt(e)  # read in every round
    frontier = _ckpt(_installed_roots(roots, installed))
    visited, parts = frontier, 1
    while True:
        nxt = (frontier.join(by_key(e), frontier.node == e.a).select(F.col("b").alias("node")).distinct()
               .join(by_key(visited), "node", "left_anti"))
        nxt = _ckpt(nxt)
        if nxt.isEmpty():
            return visited
        visited, parts = visited.unionAll(nxt), parts + 1
        if parts > compact_every:
            visited, parts = _ckpt(visited), 1
        frontier = nxt


def reachable_by_jumps(edges: DataFrame, roots: DataFrame, installed: DataFrame | None = None, direction: str = "out") -> DataFrame:
    """G2 on graphs with long chains: the rows of ``reachable`` in a number of
    rounds that grows with the branchings on a path and the logarithm of its
    chains, not with its length.

    Nodes with one successor are linked to the nodes 1, 2, 4, ... steps on
    (path doubling; a level has at most one row a node, the last level covers
    the longest chain or ring).  A round marks everything on the chains of its
    new nodes, level by level, then follows the edges of branching nodes."""
    src, dst = ("src", "dst") if direction == "out" else ("dst", "src")
    e = _ckpt(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct())
    degree = e.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
    single = _ckpt(degree.where("n = 1").select("a", "b"))
    forks = _ckpt(e.join(by_key(degree.where("n > 1").select("a")), "a", "left_semi"))
    jumps, steps, most = [single], 1, single.count()
    while steps < most:
        last = jumps[-1]
        further = _ckpt(last.join(by_key(last.select(F.col("a").alias("b"), F.col("b").alias("c"))), "b").select("a", F.col("c").alias("b")))
        if further.isEmpty():
            break
        jumps, steps = [*jumps, further], 2 * steps
    new = _ckpt(_installed_roots(roots, installed))
    known = new
    while not new.isEmpty():
        chain = new
        for jump in jumps:
            ahead = _ckpt(chain.join(by_key(jump), chain.node == jump.a).select(F.col("b").alias("node")).distinct())
            if ahead.isEmpty():
                break
            chain = _ckpt(chain.union(ahead).distinct())
        known = _ckpt(known.union(chain).distinct())
        new = _ckpt(chain.join(by_key(forks), chain.node == forks.a).select(F.col("b").alias("node")).distinct().join(by_key(known), "node", "left_anti"))
        known = known.union(new)
    return known


def _reached_edges(e: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Per root, the edges that leave the nodes it reaches (in at most
    ``max_depth`` steps): ``root`` and the columns of ``e (_s, _d, ..)``.
    Each (root, node) is followed once."""
    frontier = _written(roots.select(F.col("node").alias("root"), "node"))
    known, found = frontier, []
    while max_depth is None or len(found) < max_depth:
        step = _written(frontier.join(by_key(e), F.col("node") == F.col("_s")).select("root", *e.columns))
        found.append(step)
        frontier = _written(step.where(F.col("_d").isNotNull()).select("root", F.col("_d").alias("node")).distinct()
                            .join(by_key(known), ["root", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        known = known.unionAll(frontier)
    return reduce(DataFrame.unionAll, found) if found else e.select(F.col("_s").alias("root"), *e.columns).limit(0)


def _in_tasks(reached: DataFrame, rows_of, columns: list, *order) -> DataFrame:
    """Deals reached edges by root and gives ``rows_of(root, children)`` of
    each root, children in ``order`` by parent.  ``columns``: name, Spark type
    and Arrow type of the rows; None stands for that of a node."""
    node = reached.schema["root"].dataType
    schema = StructType([StructField(name, (ArrayType(node) if name == "path" else node) if kind is None else kind) for name, kind, _ in columns])

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        node_of = {"path": pa.list_(first.schema.field("root").type)}
        out = pa.schema([(name, node_of.get(name, first.schema.field("root").type) if kind is None else kind) for name, _, kind in columns])
        edges = (row for b in chain([first], batches) for row in zip(*(c.to_pylist() for c in b.columns)))

        def rows():
            for root, group in groupby(edges, itemgetter(0)):
                children: dict = {}
                for _, parent, *child in group:
                    children.setdefault(parent, []).append(child)
                yield from rows_of(root, children)

        found = rows()
        while held := list(islice(found, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), out.types)], schema=out)

    return reached.repartition("root").sortWithinPartitions("root", "_s", *order).mapInArrow(run, schema)


def _roots_with_many_edges(e: DataFrame, reached: DataFrame) -> DataFrame | None:
    """``root``s of more than ``ROOT_EDGES`` reached edges, None if there are none."""
    if e.count() <= ROOT_EDGES:
        return None
    large = _ckpt(reached.groupBy("root").count().where(F.col("count") > ROOT_EDGES).select("root"))
    return None if large.isEmpty() else large


def _without(reached: DataFrame, large: DataFrame | None) -> DataFrame:
    return reached if large is None else reached.join(by_key(large), "root", "left_anti")


def _reached_by_groups(e: DataFrame, starts: DataFrame, max_depth: int | None, compact_every: int = 8) -> DataFrame:
    """As ``_reached_edges`` for groups of roots: ``group`` and the columns of
    ``e``.  ``starts (group, node)``; the groups that reach a node are bits of
    masks (``word, node, mask``), so a round handles a node once for ``MASK`` groups."""
    known = frontier = _written(starts.groupBy((F.col("group") / MASK).cast("int").alias("word"), "node")
                                .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(group % {MASK} AS int))")).alias("mask")))
    rounds, parts = 1, 1
    while max_depth is None or rounds < max_depth:
        step = (frontier.join(by_key(e), F.col("node") == F.col("_s")).where(F.col("_d").isNotNull())
                .groupBy("word", F.col("_d").alias("node")).agg(F.bit_or("mask").alias("mask")))
        both = known.withColumn("new", F.lit(0).cast("bigint")).unionByName(step.select("word", "node", F.lit(0).cast("bigint").alias("mask"), F.col("mask").alias("new")))
        frontier = _written(both.groupBy("word", "node").agg(F.bit_or("mask").alias("old"), F.bit_or("new").alias("new"))
                            .select("word", "node", F.col("new").bitwiseAND(F.bitwise_not("old")).alias("mask")).where("mask <> 0"))
        if frontier.isEmpty():
            break
        known, rounds, parts = known.unionAll(frontier), rounds + 1, parts + 1
        if parts > compact_every:
            known, parts = _written(known.groupBy("word", "node").agg(F.bit_or("mask").alias("mask"))), 1
    # The rounds of a node have no group in common.
    found = known.join(by_key(e), F.col("node") == F.col("_s"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(MASK - 1)), lambda bit: F.getbit("mask", bit) == 1)
    return found.select("word", F.explode(bits).alias("bit"), *e.columns).select((F.col("word") * MASK + F.col("bit")).alias("group"), *e.columns)


class _Held:
    """The edges of a group in arrays, in ``order`` of their sources: nodes are
    numbered, -1 is null, the children of node ``i`` are
    ``child[start[i]:start[i] + degree[i]]``."""

    def __init__(self, source: pa.Array, target: pa.Array):
        coded = pa.concat_arrays([source, target]).dictionary_encode()
        codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        self.nodes, of = coded.dictionary, codes[:len(source)]
        self.order = np.argsort(of, kind="stable")
        self.child = codes[len(source):][self.order]
        self.degree = np.append(np.bincount(of, minlength=len(self.nodes)), 0)  # the last one is that of null
        self.start = np.cumsum(self.degree) - self.degree
        text = pa.types.is_string(self.nodes.type) or pa.types.is_binary(self.nodes.type)
        #: Long names count as several nodes.
        self.width = 1 + (pc.max(pc.binary_length(self.nodes)).as_py() or 0) // 32 if text else 1

    def codes(self, nodes: pa.Array) -> np.ndarray:
        """The numbers of those of ``nodes`` that have edges."""
        return pc.index_in(nodes, self.nodes).drop_null().to_numpy(zero_copy_only=False).astype(np.int32)

    def named(self, codes: np.ndarray, names: pa.Array | None = None) -> pa.Array:
        """Nodes (or their ``names``) of numbers."""
        none = codes < 0
        return (self.nodes if names is None else names).take(pa.array(codes, mask=none if none.any() else None))

    def branches(self, roots: np.ndarray, max_depth: int | None, texts: pa.Array | None = None, sep: str = "", go_on=None) -> Iterator[tuple]:
        """Every branch below ``roots``, many at a time: their paths to the
        child (numbers, a column each), whether the child is on the path before,
        the child's edge, and the path's ``texts`` joined by ``sep``.  Of what
        is found, ``go_on(roots)`` tells the branches to follow.

        Branches of one depth are followed together, about as many as have
        ``BATCH`` children; the others wait, so what is held grows with the depth."""
        todo = [(roots[None, :], None if texts is None else self.named(roots, texts))]
        while todo:
            paths, text = todo.pop()
            length, last = len(paths), paths[-1]
            degree = self.degree[last]
            ends = np.cumsum(degree)
            most = max(1, min(BATCH, BATCH_NODES // self.width // (length + 1)))
            if len(last) > 1 and ends[-1] > 2 * most:
                cuts = np.unique(np.searchsorted(ends, np.arange(most, ends[-1], most)))
                cuts = cuts[(cuts > 0) & (cuts < len(last))]
                cuts = [0, *(cuts if len(cuts) else [len(last) // 2]), len(last)]
                todo += [(paths[:, a:b], None if text is None else text.slice(a, b - a)) for a, b in zip(cuts[-2::-1], cuts[:0:-1])]
                continue
            parents = np.repeat(np.arange(len(last)), degree)
            edges = np.arange(len(parents)) + np.repeat(self.start[last] - ends + degree, degree)
            for at in range(0, len(edges), 2 * most):  # more than one for a path with many children
                of, edge = parents[at:at + 2 * most], edges[at:at + 2 * most]
                child = self.child[edge]
                found = np.append(paths.take(of, axis=1), child[None, :], axis=0)
                again = (found[:-1] == child).any(axis=0)
                joined = None if text is None else pc.binary_join_element_wise(text.take(pa.array(of)), self.named(child, texts), sep, null_handling="skip")
                yield found, again, edge, joined
                if max_depth is None or length < max_depth:
                    more = ~again & (self.degree[child] > 0)
                    if go_on is not None:
                        more &= go_on(found[0])
                    more = np.flatnonzero(more)
                    if len(more):
                        todo.append((found.take(more, axis=1), None if text is None else joined.take(pa.array(more))))


def _many(held: _Held, roots: np.ndarray, max_depth: int | None) -> np.ndarray:
    """Those of ``roots`` that have more than ``ROOT_BRANCHES`` branches."""
    counts = np.zeros(len(held.nodes), np.int64)
    for found, *_ in held.branches(roots, max_depth, go_on=lambda root: counts[root] <= ROOT_BRANCHES):
        root = found[0]
        first = np.flatnonzero(np.append(True, root[1:] != root[:-1]))  # a root's branches lie together
        counts[root[first]] += np.diff(np.append(first, len(root)))
    return roots[counts[roots] > ROOT_BRANCHES]


def _by_groups(edges: DataFrame, roots: DataFrame, groups: int | None, rows_of, schema: StructType) -> DataFrame:
    """Deals ``edges (group, _s, _d, ..)`` and ``roots (group, node)`` by group
    and gives the record batches ``rows_of(held, roots, about)`` of each, where
    ``about`` are the further columns of the edges in their held order.
    ``groups``: how many, if they are numbered."""
    both = edges.unionByName(roots.select("group", F.col("node").alias("_s"), F.lit(True).alias("_root")), allowMissingColumns=True)
    # A task has one numbered group, or groups that follow each other.
    dealt = both.repartition("group").sortWithinPartitions("group") if groups is None else both.repartitionById(groups, "group")

    def one(batches):
        t = pa.Table.from_batches(batches).combine_chunks()
        is_root = t["_root"].is_valid()
        edges, roots = t.filter(pc.invert(is_root)), t.filter(is_root)
        column = lambda t, c: pa.concat_arrays(t[c].chunks) if t[c].num_chunks else pa.array([], t.schema.field(c).type)
        if not edges.num_rows or not roots.num_rows:
            return
        held = _Held(column(edges, "_s"), column(edges, "_d"))
        about = [column(edges, c).take(pa.array(held.order)) for c in edges.column_names if c not in ("group", "_s", "_d", "_root")]
        starts = held.codes(column(roots, "_s"))
        del t, edges, roots, is_root
        yield from rows_of(held, starts, about)

    def run(batches):
        kept, now = [], None
        for batch in batches:
            runs, at = pc.run_end_encode(batch.column("group")), 0
            for end, group in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                if kept and group != now:
                    yield from one(kept)
                    kept = []
                now = group
                kept.append(batch.slice(at, end - at))
                at = end
        if kept:
            yield from one(kept)

    return dealt.mapInArrow(run, schema)


def _levels(e: DataFrame, level: DataFrame, max_depth: int | None) -> DataFrame:
    """The branches below those of ``level`` (depth 0), level by level."""
    levels, d = [], 0
    while max_depth is None or d < max_depth:
        d += 1
        level = _written(level.where(~F.col("recursive")).select("root", "node", "path").join(by_key(e), F.col("node") == F.col("_s"))
                         .select("root", F.lit(d).alias("depth"), F.col("node").alias("parent"), F.col("_d").alias("node"),
                                 F.concat("path", F.array("_d")).alias("path"),
                                 F.array_contains("path", F.col("_d")).alias("recursive"), *e.columns[2:]))
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels) if levels else level.limit(0)


def dep_tree(edges: DataFrame, roots: DataFrame, installed: DataFrame | None = None,
             max_depth: int | None = None, tag: str | None = None, sep: str | None = None) -> DataFrame:
    """G1: every branch from every root; a child already on its own branch
    becomes a leaf marked ``recursive`` and is not expanded (the guard is
    per branch, so shared nodes expand once per branch).  Output ``root,
    depth, parent, node, path ARRAY, recursive``, and ``tag``: a column of
    ``edges`` about ``dst`` and of ``roots`` about ``node``, if one is named.
    With ``sep``, ``path`` is text: its nodes joined by ``sep``, as ``array_join`` does.

    Every simple branch is walked to its end, so the output is as large as
    the number of branches; ``max_depth`` cuts it where a caller asks for a
    cut.  ``reachable`` (G2) and ``preorder_tree`` (G3) hold the same
    structure in at most one row per root and edge.  The branches are listed
    while they are read: what is stored grows with the edges that groups of
    roots reach, not with the branches.  Roots of a group that reaches more
    than ``GROUP_EDGES`` are walked each for itself."""
    extra = [tag] if tag else []
    kind = reduce(DataFrame.unionAll, [edges.select("src"), edges.select("dst"), roots.select("node")]).schema[0].dataType
    e = _ckpt(edges.select(F.col("src").cast(kind).alias("_s"), F.col("dst").cast(kind).alias("_d"), *extra))
    r = _installed_roots(roots, installed)
    if tag:
        r = r.join(by_key(roots.groupBy("node").agg(F.min(tag).alias(tag))), "node")
    r = _ckpt(r.withColumn("node", F.col("node").cast(kind)))
    top = r.select(F.col("node").alias("root"), F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent"), "node",
                   F.array("node").alias("path"), F.lit(False).alias("recursive"), *extra)

    def shown(rows):
        return rows if sep is None else rows.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), sep))

    if max_depth is not None and max_depth < 1:
        return shown(top)
    # Numbers and texts are joined in the tasks, other kinds after them.
    as_text = sep is not None and isinstance(kind, IntegralType | StringType)
    schema = StructType([StructField("root", kind), StructField("depth", IntegerType()), StructField("parent", kind), StructField("node", kind),
                         StructField("path", StringType() if as_text else ArrayType(kind)), StructField("recursive", BooleanType()),
                         *([StructField(tag, e.schema[tag].dataType)] if tag else [])])

    def many(held, starts, about):
        yield pa.RecordBatch.from_arrays([held.named(_many(held, starts, max_depth))], names=["root"])

    def walk(held, starts, about):
        texts = held.nodes.cast(pa.string()) if as_text else None
        for found, again, edge, text in held.branches(starts, max_depth, texts, sep):
            length, n = found.shape
            recursive = pa.array(again, mask=found[-1] < 0)  # null of a null child
            path = text if as_text else pa.ListArray.from_arrays(np.arange(0, n * length + 1, length, dtype=np.int32), held.named(found.T.ravel()))
            yield pa.RecordBatch.from_arrays(
                [held.named(found[0]), pa.array(np.full(n, length - 1, np.int32)), held.named(found[-2]), held.named(found[-1]), path, recursive,
                 *(c.take(pa.array(edge)) for c in about)], names=schema.names)

    n = r.count()
    groups = min(max(1, n), max(MASK, 2 * e.sparkSession.sparkContext.defaultParallelism, -(-n // GROUP_ROOTS)))
    starts = r.where(F.col("node").isNotNull()).select(F.pmod(F.xxhash64("node"), F.lit(groups)).cast("int").alias("group"), "node")
    reached = _written(_reached_by_groups(e, starts, max_depth))
    dealt, large = [(reached, starts, groups)], None
    if e.count() > GROUP_EDGES:
        full = _ckpt(reached.groupBy("group").count().where(F.col("count") > GROUP_EDGES).select("group"))
        if not full.isEmpty():
            alone = _ckpt(starts.join(by_key(full), "group", "left_semi").select("node"))
            of_root = _reached_edges(e, alone, max_depth)
            large = _roots_with_many_edges(e, of_root)
            dealt = [(reached.join(by_key(full), "group", "left_anti"), starts.join(by_key(full), "group", "left_anti"), groups),
                     (_without(of_root, large).withColumnRenamed("root", "group"),
                      _without(alone.select(F.col("node").alias("root")), large).select(F.col("root").alias("group"), F.col("root").alias("node")), None)]
    # Roots that one task would not list.
    more = _ckpt(reduce(DataFrame.unionAll, [_by_groups(edges, nodes, k, many, StructType([StructField("root", kind)])) for edges, nodes, k in dealt]))
    if not more.isEmpty():
        dealt = [(edges, nodes.join(by_key(more), F.col("node") == F.col("root"), "left_anti"), k) for edges, nodes, k in dealt]
        large = more if large is None else large.union(more)
    walked = reduce(DataFrame.unionAll, [_by_groups(edges, nodes, k, walk, schema) for edges, nodes, k in dealt])
    rest = [] if large is None else [_levels(e, _ckpt(top.join(by_key(large), "root", "left_semi")), max_depth)]
    if as_text:
        return reduce(DataFrame.unionByName, [shown(top), walked, *map(shown, rest)])
    return shown(reduce(DataFrame.unionByName, [top, walked, *rest]))


def _display(root, children: dict) -> Iterator[tuple]:
    """The rows below ``root`` of a depth-first walk: depth, parent, node,
    whether the node was shown before."""
    seen, path, todo = {root}, [root], [iter(children.get(root, ()))]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
            path.pop()
            continue
        node = child[0]
        again = node in seen if node is not None else None
        yield root, len(path), path[-1], node, again
        if again is False:
            seen.add(node)
            path.append(node)
            todo.append(iter(children.get(node, ())))


def _labelled_display(e: DataFrame, r: DataFrame) -> DataFrame:
    """The rows of ``_display`` by label correcting.  The first-visit path of a
    node is its lexicographically smallest simple path from the root: each
    round relaxes the edges of the labels that the last round changed and
    keeps the minimum label per (root, node), until no label changes.  Then
    every edge leaving a reached node is one displayed row, ``repeated``
    unless it is the child's own first-visit path."""
    labels = _written(r.select(F.col("node").alias("root"), "node", F.array("node").alias("label"), F.lit(1).alias("_new")))
    while not labels.where(F.col("_new") == 1).isEmpty():
        cand = (labels.where(F.col("_new") == 1).join(by_key(e), F.col("node") == F.col("_s"))
                .where(~F.array_contains("label", F.col("_d")))
                .select("root", F.col("_d").alias("node"), F.concat("label", F.array("_d")).alias("label")))
        # Tag where the winning label comes from: 0 = already known, 1 = new
        # this round (ties keep the known one), so "did anything change" is a
        # filter on the written result instead of another shuffle join.
        both = labels.withColumn("_new", F.lit(0)).unionByName(cand.withColumn("_new", F.lit(1)))
        best = both.groupBy("root", "node").agg(F.min(F.struct("label", "_new")).alias("b"))
        labels = _written(best.select("root", "node", F.col("b.label").alias("label"), F.col("b._new").alias("_new")))
    labels = labels.drop("_new")
    return (labels.alias("p").join(by_key(e), F.col("p.node") == F.col("_s"))
            .join(by_key(labels.select("root", F.col("node").alias("_d"), F.col("label").alias("child_label"))), ["root", "_d"], "left")
            .select("root", F.size("p.label").alias("depth"), F.col("p.node").alias("parent"), F.col("_d").alias("node"),
                    (F.col("child_label") != F.concat("p.label", F.array("_d"))).alias("repeated")))


def preorder_tree(edges: DataFrame, roots: DataFrame, installed: DataFrame | None = None,
                  as_text: bool = True) -> DataFrame:
    """The display tree per root with children in name order (nodes
    compared as text or, with ``as_text=False``, as they are), where the
    first visit of a node in preorder is expanded and later visits are shown
    as ``repeated`` leaves: every edge leaving a reached node is one row.  A
    root without metadata is one ``missing`` row.  Output ``root, depth,
    parent, node, repeated, missing``.

    The edges that each root reaches are dealt by root and walked depth first
    in tasks; roots that reach more than ``ROOT_EDGES`` are labelled by joins."""
    shown = (lambda c: F.col(c).cast("string")) if as_text else F.col
    # Whole numbers travel as such and are compared as text.
    whole = all(isinstance(f.dataType, IntegralType) for f in (edges.schema["src"], edges.schema["dst"], roots.schema["node"]))
    kind = (lambda c: F.col(c).cast("bigint")) if as_text and whole else shown
    e = _ckpt(edges.select(kind("src").alias("_s"), kind("dst").alias("_d")).distinct())
    all_roots = _ckpt(roots.select(kind("node").alias("node")).distinct())
    inst = (installed.select(kind("node").alias("node")).distinct()
            if installed is not None else None)
    r = all_roots if inst is None else _ckpt(all_roots.join(by_key(inst), "node", "left_semi"))
    reached = _reached_edges(e, r)
    large = _roots_with_many_edges(e, reached)
    rows = _in_tasks(_without(reached, large), _display, [
        ("root", None, None), ("depth", IntegerType(), pa.int32()), ("parent", None, None), ("node", None, None),
        ("repeated", BooleanType(), pa.bool_())], shown("_d"))
    in_text = lambda df, *cols: df.withColumns({c: shown(c) for c in cols})
    rows = in_text(rows, "root", "parent", "node")
    if large is not None:
        rows = rows.unionByName(_labelled_display(in_text(e, "_s", "_d"), in_text(large.select(F.col("root").alias("node")), "node")))
    rows = rows.withColumn("missing", F.lit(False))

    def alone(nodes, missing):
        n = nodes.select(shown("node").alias("node"))
        return n.select(F.col("node").alias("root"), F.lit(0).alias("depth"), F.lit(None).cast(n.schema["node"].dataType).alias("parent"),
                        "node", F.lit(False).alias("repeated"), F.lit(missing).alias("missing"))

    out = alone(r, False).unionByName(rows)
    return out if inst is None else out.unionByName(alone(all_roots.join(by_key(inst), "node", "left_anti"), True))
