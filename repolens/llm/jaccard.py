"""N-gram Jaccard join with a token-group matrix (operator 6).

Documents are sets of five-word shingles; two are linked if their Jaccard
similarity is at least ``SIMILAR_PERCENT``.  Documents of one set are one
node.  Of a node's tokens (shingle hashes in one global order) a prefix of
``n - ceil(3n/4) + 1`` suffices: linked nodes share a token of their prefixes.
A node's prefix also holds all its tokens in the first quarter of the order,
so that what stands behind that quarter bounds the rest of any overlap.

1. Groups: nodes are partitioned by their first shared prefix token and size
   class; similar nodes mostly have the same ones.
2. Matrix: for every shared token the groups whose token union holds it, with
   the range of their set sizes.
3. Bound: the prefix tokens that a query node shares with a group's union,
   plus the tokens behind the first quarter, limit its overlap with any member
   of a fitting size; only groups that can reach the threshold are opened.
4. Opening: a query's group and the groups that it opens form a family.  The
   members of a family are compared exactly, in blocks of bounded size; in a
   pair of blocks, again only nodes whose overlap with the other block's
   token union reaches the threshold are opened, and counted by one matrix
   product.  A task returns a spanning forest of the links, never the pairs.

Frequent tokens come last in the global order, so that only documents made
up of them have them in their prefix; which they are is estimated from a
hash sample and touches speed alone.  A prefix token that more than
``MAX_NODES`` nodes share puts all of them into one family, unbounded by
counting but still compared in blocks.

Defined results: a null, empty or blank text has no shingles and is its own
component; a text of one to four words has one shingle.  Rows of equal sets
are one component, whatever their ids.  A null id has a null component and
links nothing.  Repeated rows give repeated results; an empty table gives an
empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import broadcast_if_small, is_small, write_table
from .components import components

SHINGLE, SIMILAR_PERCENT = 5, 75
#: Share of texts in the frequency sample, occurrences in it that make a token
#: frequent, and the largest number of frequent tokens listed.
SAMPLE_ONE_IN, FREQUENT, MAX_FREQUENT = 16, 8, 1 << 20
#: Nodes of a token whose query-group pairs are counted.
MAX_NODES = 256
#: Shared tokens that may be broadcast (8 bytes each).
BROADCAST_TOKENS = 4_000_000
#: Nodes and shingles of a block.
BLOCK_NODES, BLOCK_TOKENS = 512, 1_000_000
#: Growth of set sizes from one size class to the next.
CLASS_GROWTH = 1.1
#: Tokens are 62-bit hashes; frequent ones are moved behind all others.
_LAST, _QUARTER = np.int64(1 << 62), np.int64(1 << 60)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of the lower-cased text."""
    return np.unique(W.shingles(W.split(text, lower=True), SHINGLE))


def _least_overlap(n):
    """Smallest overlap of a linked pair seen from one set: ceil(t n)."""
    return -(-SIMILAR_PERCENT * n // 100)


def _frequent_tokens(texts: DataFrame) -> np.ndarray:
    """Sorted 62-bit tokens that many texts of the sample hold."""
    def tokens(batches):
        for b in batches:
            sets = [shingle_set(s.as_py()) for s in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets) >> np.uint64(2) if sets else [], pa.int64())], names=["t"])
            del sets
            W.give_back()
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_ONE_IN)) == 0).distinct()
    often = sample.mapInArrow(tokens, "t long").groupBy("t").count().where(F.col("count") >= FREQUENT)
    often = write_table(often, "jaccard-frequent")
    return np.sort(often.orderBy(F.desc("count"), "t").limit(MAX_FREQUENT).select("t").toArrow()["t"].to_numpy())


def _nodes(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(doc_id, node, n, behind, prefix) of every document; ``behind`` is the
    number of tokens that don't stand in the first quarter of the order."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    kind = pa.struct([("node", pa.int64()), ("n", pa.int64()), ("behind", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<node:bigint,n:bigint,behind:bigint,prefix:array<bigint>>")
    def sketch(texts: pa.Array) -> pa.Array:
        often, nodes, sizes, behind, prefixes = shared.value, [], [], [], []
        for s in texts:
            tokens = shingle_set(s.as_py())
            n = len(tokens)
            nodes.append(xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63))
            sizes.append(n)
            t = (tokens >> np.uint64(2)).astype(np.int64)
            if len(often):
                t[often[np.minimum(np.searchsorted(often, t), len(often) - 1)] == t] += _LAST
            t.sort()
            early = int(np.searchsorted(t, _QUARTER))
            behind.append(n - early)
            prefixes.append(t[:max(n - _least_overlap(n) + 1, early)] if n else t)
        offsets = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
        flat = pa.array(np.concatenate(prefixes) if prefixes else np.empty(0, np.int64), pa.int64())
        del prefixes
        W.give_back()
        return pa.StructArray.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(behind, pa.int64()),
                                           pa.ListArray.from_arrays(offsets, flat)], fields=list(kind))

    return docs.select("doc_id", sketch(F.col("text")).alias("s")).select("doc_id", "s.*")


def _shared_tokens(sketch: DataFrame) -> DataFrame:
    """(t, node, n, behind): the prefix tokens that several nodes hold."""
    rows = sketch.select("node", "n", "behind", F.explode("prefix").alias("t"))
    several = write_table(rows.groupBy("t").agg(F.min("node").alias("a"), F.max("node").alias("b"))
                          .where(F.col("a") < F.col("b")).select("t"), "jaccard-tokens")
    if is_small(several, BROADCAST_TOKENS):
        known = np.sort(several.toArrow()["t"].to_numpy())
        shared = sketch.sparkSession.sparkContext.broadcast(known)

        @F.arrow_udf("array<bigint>")
        def only_shared(prefixes: pa.Array) -> pa.Array:
            flat, offsets = prefixes.flatten().to_numpy(), prefixes.offsets.to_numpy()
            offsets = offsets - offsets[0]
            k = shared.value
            keep = k[np.minimum(np.searchsorted(k, flat), len(k) - 1)] == flat if len(k) else np.zeros(len(flat), bool)
            before = np.concatenate([[0], np.cumsum(keep)])
            out = pa.ListArray.from_arrays(before[offsets].astype(np.int32), pa.array(flat[keep], pa.int64()))
            del flat, keep, before
            W.give_back()
            return out

        rows = sketch.select("node", "n", "behind", F.explode(only_shared(F.col("prefix"))).alias("t"))
    else:
        rows = rows.join(several, "t")
    return write_table(rows.select("t", "node", "n", "behind").dropDuplicates(["t", "node"]), "jaccard-rows")


def _families(rows: DataFrame) -> DataFrame:
    """(node, n, family) of the nodes that may have a link."""
    # 1. Groups, named by their smallest node.
    first = rows.groupBy("node", "n", "behind").agg(F.min("t").alias("t"))
    first = first.withColumn("class", F.floor(F.log("n") / math.log(CLASS_GROWTH)))
    heads = first.groupBy("t", "class").agg(F.min("node").alias("g"))
    group = write_table(first.join(heads, ["t", "class"]).select("node", "n", "behind", "g"), "jaccard-groups")
    # 2. The matrix, with the sizes of the members that have the token.
    holders = write_table(rows.groupBy("t").agg(F.count(F.lit(1)).alias("nodes")), "jaccard-holders")
    placed = write_table(rows.join(holders, "t").join(group.select("node", "g"), "node"), "jaccard-placed")
    few = placed.where(F.col("nodes") <= MAX_NODES)
    matrix = few.groupBy("t", "g").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).withColumnRenamed("g", "to")
    sizes = group.groupBy(F.col("g").alias("s_g")).agg(F.min("n").alias("g_lo"), F.max("behind").alias("g_behind"))
    # 3. The bound.  A partner's size s lies in [t n, n / t], and the overlap
    # is at least p (n + s) / (100 + p).
    p, n = SIMILAR_PERCENT, F.col("n")
    fits = (100 * F.col("hi") >= p * n) & (p * F.col("lo") <= 100 * n) & (F.col("to") != F.col("g"))
    met = (few.select("t", "node", "n", "behind", "g").join(matrix, "t").where(fits)
           .groupBy("node", "n", "behind", "g", "to").agg(F.count(F.lit(1)).alias("c")))
    least = F.ceil(p * (n + F.greatest("g_lo", F.ceil(p * n / 100.0))) / float(100 + p)) - F.least("behind", "g_behind")
    # Tokens that more nodes share than are counted may add to c.
    many = placed.where(F.col("nodes") > MAX_NODES).groupBy(F.col("node").alias("m_node")).agg(F.count(F.lit(1)).alias("m"))
    opened = (met.join(sizes, F.col("to") == F.col("s_g")).join(many, F.col("node") == F.col("m_node"), "left")
              .where(F.col("c") + F.coalesce("m", F.lit(0)) >= least).select(F.col("g").alias("u"), F.col("to").alias("v")))
    common = placed.where(F.col("nodes") > MAX_NODES).groupBy("t", "g").agg(F.count(F.lit(1)))
    top = common.groupBy("t").agg(F.min("g").alias("top"))
    opened = opened.union(common.join(top, "t").select(F.col("g").alias("u"), F.col("top").alias("v"))).distinct()
    merged = components(opened)
    return write_table(group.join(merged, F.col("g") == F.col("vertex"), "left")
                       .select("node", "n", F.coalesce("component", "g").alias("family")), "jaccard-families")


def _linked(a: list[np.ndarray], b: list[np.ndarray] | None) -> list[tuple[int, int]]:
    """Places (i, j) of all linked pairs of a and b, or within a."""
    every = a if b is None else a + b
    tokens, owner = np.concatenate(every), np.repeat(np.arange(len(every), dtype=np.int32), [len(x) for x in every])
    _, token, times = np.unique(tokens, return_inverse=True, return_counts=True)
    keep = times[token] > 1  # a token of one node only adds to no overlap
    token, owner, size = token[keep], owner[keep], np.array([len(x) for x in every])
    most = np.bincount(owner, minlength=len(every))
    open_ = 100 * most >= SIMILAR_PERCENT * size
    if b is not None:  # overlap with the other block's token union
        side = owner < len(a)
        in_a, in_b = np.zeros(len(times), bool), np.zeros(len(times), bool)
        in_a[token[side]], in_b[token[~side]] = True, True
        met = np.bincount(owner, np.where(side, in_b[token], in_a[token]), minlength=len(every))
        open_ = 100 * met >= SIMILAR_PERCENT * size
    rows = np.flatnonzero(open_)
    if len(rows) < 2:
        return []
    place = np.full(len(every), -1)
    place[rows] = np.arange(len(rows))
    keep = place[owner] >= 0
    _, token = np.unique(token[keep], return_inverse=True)
    owner = place[owner[keep]]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    split = int(np.searchsorted(rows, len(a))) if b is not None else 0
    left, right = (len(rows), len(rows)) if b is None else (split, len(rows) - split)
    both, step = np.zeros((left, right), np.float32), 2048
    for at in range(0, int(token[-1]) + 1 if len(token) else 0, step):
        lo, hi = np.searchsorted(token, [at, at + step])
        m = np.zeros((len(rows), min(step, int(token[-1]) + 1 - at)), np.float32)
        m[owner[lo:hi], token[lo:hi] - at] = 1
        both += m @ m.T if b is None else m[:split] @ m[split:].T
    s = size[rows].astype(np.int64)
    sl, sr = (s, s) if b is None else (s[:split], s[split:])
    inter = both.astype(np.int64)
    i, j = np.nonzero(100 * inter >= SIMILAR_PERCENT * (sl[:, None] + sr[None, :] - inter))
    if b is None:
        return [(int(rows[x]), int(rows[y])) for x, y in zip(i, j) if x < y]
    return [(int(rows[x]), int(rows[split + y])) for x, y in zip(i, j)]


def _forest(docs: list[int], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges (document, root) of the pairs' components."""
    root = list(range(len(docs)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for i, j in pairs:
        root[find(i)] = find(j)
    return [(docs[i], docs[find(i)]) for i in range(len(docs)) if find(i) != i]


def _open(batches, counted: bool = False):
    """Sorted rows (family, i, j, side, doc, node, text, size) of pairs of
    blocks -> spanning edges (u, v) between documents; if ``counted``, also
    (node, links), the documents of all nodes linked to a node here.  Two
    nodes meet in one pair of blocks, so a node's links add up over them."""
    key, sets, docs, seen = None, ([], []), ([], []), set()
    nodes, sizes = ([], []), ([], [])

    def edges():
        a, b = sets
        pairs = _linked(a, b if key[1] != key[2] else None) if len(a) + len(b) > 1 and (key[1] == key[2] or (a and b)) else []
        out = _forest(docs[0] + docs[1], pairs)
        if not counted:
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["u", "v"])
        name, size = nodes[0] + nodes[1], np.array(sizes[0] + sizes[1], np.int64)
        at, links = np.array(pairs, np.int64).reshape(-1, 2), np.zeros(len(name), np.int64)
        np.add.at(links, at[:, 0], size[at[:, 1]])
        np.add.at(links, at[:, 1], size[at[:, 0]])
        some = np.flatnonzero(links)
        none_e, none_n = [None] * len(out), [None] * len(some)
        cols = ([e[0] for e in out] + none_n, [e[1] for e in out] + none_n, none_e + [name[k] for k in some], none_e + links[some].tolist())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["u", "v", "node", "links"])
    for batch in batches:
        for family, i, j, side, doc, node, text, size in zip(*batch.columns):
            now = family.as_py(), i.as_py(), j.as_py()
            if now != key:
                if key is not None:
                    yield edges()
                key, sets, docs, seen = now, ([], []), ([], []), set()
                nodes, sizes = ([], []), ([], [])
            tokens = shingle_set(text.as_py())
            # Another text under the same id isn't this node.
            if node.as_py() not in seen and xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63) == node.as_py():
                seen.add(node.as_py())
                sets[side.as_py()].append(tokens)
                docs[side.as_py()].append(doc.as_py())
                nodes[side.as_py()].append(node.as_py())
                sizes[side.as_py()].append(size.as_py())
        W.give_back()
    if key is not None:
        yield edges()
    W.give_back()


def _links(docs: DataFrame, family: DataFrame, classes: DataFrame, counted: bool = False) -> DataFrame:
    """Spanning edges (u, v) of the links, between the smallest ids of nodes;
    if ``counted``, also the partial counts (node, links)."""
    blocks = (family.groupBy("family").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("tokens")).where(F.col("nodes") > 1)
              .select("family", F.greatest(F.ceil(F.col("nodes") / BLOCK_NODES), F.ceil(F.col("tokens") / BLOCK_TOKENS)).alias("blocks")))
    # Written first, so that the join can split a hot family's members.
    blocks = write_table(blocks, "jaccard-blocks")
    members = write_table(family.join(blocks, "family").join(classes, "node").select("family", "blocks", "node", "rep", "size"), "jaccard-members")
    b = F.pmod(F.xxhash64("node"), F.col("blocks"))
    # A block meets itself and every other block: (i, j) with i <= j.
    meet = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
                       lambda x: F.struct(F.least(b, x).alias("i"), F.greatest(b, x).alias("j"), F.when(b <= x, 0).otherwise(1).alias("side")))
    texts = docs.join(broadcast_if_small(members), F.col("doc_id") == F.col("rep"))
    rows = (texts.select("family", F.explode(meet).alias("m"), "rep", "node", "text", "size")
            .select("family", "m.i", "m.j", "m.side", "rep", "node", "text", "size"))
    pairs = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    return pairs.mapInArrow(lambda batches: _open(batches, counted), "u long, v long" + (", node long, links long" if counted else ""))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", links: bool = False) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest document id
    that links reach); with ``links`` also n_links, the number of other
    documents linked to the row's.  Rows of one id and set are one document,
    rows of one id and different sets are several."""
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketch = write_table(_nodes(every, _frequent_tokens(every.select("text"))), "jaccard-sketch")
    known = sketch.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    alike = known.select("node", "doc_id").distinct() if links else known
    classes = write_table(alike.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")), "jaccard-classes")
    family = _families(_shared_tokens(known))
    found = write_table(_links(every.where(F.col("doc_id").isNotNull()), family, classes, links), "jaccard-links")
    merged = components(found.where(F.col("u").isNotNull()).select("u", "v") if links else found)
    named = classes.join(merged, F.col("rep") == F.col("vertex"), "left")
    if links:
        degrees = found.where(F.col("node").isNotNull()).groupBy(F.col("node").alias("d_node")).agg(F.sum("links").alias("links"))
        named = named.join(degrees, F.col("node") == F.col("d_node"), "left")
    count = (F.coalesce("links", F.lit(0)) + F.col("size") - 1 if links else F.lit(None).cast("long")).alias("n_links")
    named = write_table(named.select(F.col("node").alias("c_node"), F.coalesce("component", "rep").alias("component"), count), "jaccard-components")
    rows = sketch.select("doc_id", "n", "node")
    # Texts without shingles have one hash; they are left out of the join.
    joined = rows.where(F.col("n") > 0).join(named, F.col("node") == F.col("c_node"), "left")
    alone = rows.where(F.col("n") == 0).select("doc_id", "n", F.col("doc_id").alias("component"), F.lit(0).cast("long").alias("n_links"))
    out = joined.select("doc_id", "n", "component", "n_links").union(alone)
    real = F.col("doc_id").isNotNull()
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(real, F.col("component")).alias("component_id"),
                     F.when(real, F.col("n_links")).alias("n_links"))
    return out if links else out.drop("n_links")
