"""Hard negatives by a cover tree over norm-augmented candidates.

A candidate x of a label becomes (x, sqrt(M^2 - |x|^2)), M being the largest norm: all
have the norm M, and the inner product with an anchor (q, 0) falls as the distance
grows.  Rows are brought together by label and nearest of a few centres; each chunk of
them is a cover tree: a greedy net, every level of it with half the radius of the one
above, nodes under the nearest node of the level above, each with the radius that
covers all rows below it.

For a node with centre c, radius r and distance d of the anchor to c, every row below
lies within d - r and d + r, which bounds its inner product on both sides; so does
q.c - |q|r and q.c + |q|r.  Anchors go down a tree together, to the nodes that may
hold a row that they want, best node first; leaves are scored exactly.  Positives are
looked for in the trees of the anchor's label, with the k-th best so far as the bound;
negatives in all others, within the window of each positive's score.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnspark.llm.common import BestOf, best_of_tasks, one_by_one, settle
from churnspark.llm.topk import matrices

#: Rows of a chunk at most (about, as they are dealt by a hash), rows of a leaf on average, levels of a tree.
CHUNK, LEAF, LEVELS = 4096, 32, 4
#: Rows that the centres are drawn from, and centres: they only say which rows lie together.
SAMPLE, CENTRES = 2048, 24
#: Numbers in the vectors of a block of anchors.
BLOCK_NUMBERS = 1 << 19


def greedy_net(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows chosen farthest first, the distance of each to those before it, and for every row its nearest chosen one (by place)."""
    norms = (x * x).sum(axis=1)
    far, near = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    chosen, gaps, at, gap = [], [], 0, np.inf
    while True:
        chosen.append(at)
        gaps.append(gap)
        d = np.sqrt(np.maximum(norms + norms[at] - 2 * (x @ x[at]), 0))
        closer = d < far
        far[closer], near[closer] = d[closer], len(chosen) - 1
        at = int(far.argmax())
        gap = far[at]
        if len(chosen) >= most or gap <= 1e-6 * (1 + np.sqrt(norms.max())):
            return np.array(chosen), np.array(gaps), near


def tree_paths(x: np.ndarray) -> np.ndarray:
    """For each row of a chunk the nodes above it, one a level, the leaf last; a node is named by its centre's row."""
    chosen, gaps, near = greedy_net(x, max(1, len(x) // LEAF))
    paths = np.empty((len(x), LEVELS), np.int32)
    up = np.arange(len(chosen))  # the net's members under their node at the level
    for level in range(LEVELS - 1, -1, -1):
        if level == LEVELS - 1:
            stay = np.arange(len(chosen))
        else:
            radius = gaps[1] / 2**level if len(gaps) > 1 else 0
            stay = np.flatnonzero(gaps > radius) if level else np.zeros(1, np.int64)
        nodes = np.unique(up)
        stay = np.intersect1d(stay, nodes)
        centres, parents = x[chosen[nodes]], x[chosen[stay]]
        d = (centres * centres).sum(axis=1)[:, None] + (parents * parents).sum(axis=1)[None, :] - 2 * centres @ parents.T
        parent_of = dict(zip(nodes.tolist(), stay[d.argmin(axis=1)].tolist(), strict=True))
        up = np.array([parent_of[u] for u in up.tolist()])
        paths[:, level] = chosen[up[near]]
    return paths


@dataclass
class Tree:
    """A chunk: its rows, and for each level the centres' rows, the radii (plain, augmented) and the parents' places; ``rows`` are the leaves'."""

    ids: np.ndarray
    x: np.ndarray
    largest: float
    levels: list
    rows: list


def read_tree(ids: np.ndarray, x: np.ndarray, paths: np.ndarray) -> Tree:
    """The tree of a chunk from its rows' paths; radii are measured over all rows below a node."""
    norms = (x * x).sum(axis=1)
    largest = float(np.sqrt(norms.max()))
    rest = np.sqrt(np.maximum(largest * largest - norms, 0))
    levels, above = [], np.zeros(len(x), np.int64)
    for level in range(paths.shape[1]):
        nodes, place = np.unique(paths[:, level], return_inverse=True)
        radii, parent = np.zeros((2, len(nodes))), np.zeros(len(nodes), np.int64)
        plain = ((x - x[paths[:, level]]) ** 2).sum(axis=1)
        np.maximum.at(radii[0], place, plain)
        np.maximum.at(radii[1], place, plain + (rest - rest[paths[:, level]]) ** 2)
        parent[place] = above
        levels.append((nodes, np.sqrt(radii), parent))
        above = place
    order = np.argsort(above, kind="stable")
    return Tree(ids, x, largest, levels, np.split(order, np.flatnonzero(np.diff(above[order])) + 1))


def descend(tree: Tree, q: np.ndarray, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Down the tree with all anchors ``q``: anchors, leaves and upper bounds of the pairs that ``wanted(anchors, low, high)`` lets pass on every level."""
    norms = np.sqrt((q * q).sum(axis=1))
    slack = 1 + 1e-9 * norms.max(initial=0) * tree.largest
    a, above, high = np.arange(len(q)), np.zeros(len(q), np.int64), np.zeros(len(q))
    for nodes, (plain, full), parent in tree.levels:
        children = np.argsort(parent, kind="stable")
        begins = np.searchsorted(parent[children], np.arange(parent.max() + 2))
        sizes = begins[above + 1] - begins[above]
        node = children[np.repeat(begins[above] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        a = np.repeat(a, sizes)
        centre, norm = (q @ tree.x[nodes].T)[a, node], norms[a]
        middle = (norm * norm + tree.largest**2) / 2
        d = np.sqrt(np.maximum(2 * (middle - centre), 0))
        high = np.minimum(middle - np.maximum(d - full[node], 0) ** 2 / 2, centre + norm * plain[node]) + slack
        low = np.maximum(middle - (d + full[node]) ** 2 / 2, centre - norm * plain[node]) - slack
        keep = wanted(a, low, high)
        a, above, high = a[keep], node[keep], high[keep]
    return a, above, high


def chunks(batches: Iterator) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """label, ids, vectors and paths of each chunk; its rows come one after the other, from place 0 on."""
    def whole(rows):
        n = len(rows[0])
        return rows[1][0], rows[2], np.frombuffer(b"".join(rows[3]), "<f8").reshape(n, -1), np.frombuffer(b"".join(rows[4]), "<i4").reshape(n, -1)

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)] + [np.array(batch.column(i).to_pylist(), object) for i in (3, 4)]
        held = now if held is None else [np.concatenate(z) for z in zip(held, now, strict=True)]
        cuts = np.flatnonzero(held[0] == 0).tolist()
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield whole([z[i:j] for z in held])
        held = [z[cuts[-1]:] for z in held]
    if held is not None:
        yield whole(held)


def clean(table: DataFrame, vec_id: str, vector: str, label: Column, scale: float) -> DataFrame:
    """id, label (as text), dims, sqr (the squared norm) and v (components floor(scale * x)) of the rows that take part."""
    import pyarrow as pa

    def run(batches: Iterator):
        for batch in batches:
            labels = dict(zip(range(batch.num_rows), batch.column(2).to_pylist(), strict=True))
            # places stand for the ids meanwhile: ids may repeat
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            places = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(1)], ["at", "v"])
            for at, block in matrices(places, scale):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at].astype(np.int64)), pa.array([labels[i] for i in at.tolist()], pa.string()), pa.array(np.full(len(at), block.shape[1], np.int64)), pa.array((block * block).sum(axis=1)),
                     pa.array([row.tobytes() for row in block.astype("<f8")], pa.binary())], ["id", "label", "dims", "sqr", "v"])

    rows = table.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), label.cast("string").alias("label"))
    return rows.filter("id IS NOT NULL AND v IS NOT NULL AND label IS NOT NULL").mapInArrow(run, "id long, label string, dims long, sqr double, v binary")


def index(rows: DataFrame) -> DataFrame:
    """chunk, place (in the chunk), label, dims, v, path, id: the cover trees, a row for each row."""
    import pandas as pd
    import pyarrow as pa
    spark = rows.sparkSession
    # a bounded sample: the rows with the smallest hashes
    sample = defaultdict(list)
    for r in rows.select("dims", "v").orderBy(F.xxhash64("id", "v")).limit(SAMPLE).collect():
        sample[r["dims"]].append(np.frombuffer(r["v"], "<f8"))
    centres = {}
    for d, vs in sample.items():
        x = np.stack(vs)
        centres[d] = x[greedy_net(x, CENTRES)[0]]
    shared = spark.sparkContext.broadcast(centres)

    def nearest(batches: Iterator):
        for batch in batches:
            dims, vs = batch.column(2).to_numpy(), batch.column(4).to_pylist()
            cell = np.zeros(len(dims), np.int64)
            for d in np.unique(dims):
                c, at = shared.value.get(int(d)), np.flatnonzero(dims == d)
                if c is not None:
                    x = np.frombuffer(b"".join(vs[i] for i in at), "<f8").reshape(len(at), d)
                    cell[at] = ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    placed = settle(rows.select("id", "label", "dims", "sqr", "v").mapInArrow(nearest, "id long, label string, dims long, sqr double, v binary, cell long"))
    key = ["label", "dims", "cell"]
    sizes = settle(placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")))
    many = sizes.filter(F.col("n") > CHUNK).withColumn("pieces", F.ceil(F.col("n") / CHUNK)).drop("n")  # a large cell has several chunks; by rank of size
    dealt = placed.join(many, key, "left").withColumn("chunk", F.xxhash64(*key, F.pmod(F.xxhash64("id", "v"), F.coalesce("pieces", F.lit(1)))))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(frame["v"]), "<f8").reshape(len(frame), -1)
        rest = np.sqrt(np.maximum(frame["sqr"].max() - frame["sqr"].to_numpy(), 0))
        paths = tree_paths(np.concatenate([x, rest[:, None]], axis=1)).astype("<i4")
        return frame.assign(place=np.arange(len(frame)), path=[p.tobytes() for p in paths])[["chunk", "place", "label", "dims", "v", "path", "id"]]

    return settle(dealt.select("chunk", "label", "dims", "sqr", "v", "id").groupBy("chunk", "label", "dims")
                  .applyInPandas(build, "chunk long, place long, label string, dims long, v binary, path binary, id long"))


def search(trees: DataFrame, anchors, same: bool, k: int, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """anchor (place), window, id, score and rank: the ``k`` best rows in each window of each anchor's scores.

    ``anchors`` is a broadcast (ids, labels, vectors) and the trees have vectors of that
    length; ``low`` and ``high`` are the windows, anchor by window.  Rows of the ``same``
    label as the anchor are looked at, or those of any other.
    """
    import pyarrow as pa
    windows = low.shape[1]
    edges = trees.sparkSession.sparkContext.broadcast((low, high))

    def run(batches: Iterator):
        (own, labels, q), (lo, hi) = anchors.value, edges.value
        best = BestOf(len(own) * windows, k, lo.ravel())
        exact_in_floats = q.shape[1] * float(np.abs(q).max(initial=0))

        def look(tree: Tree, who: np.ndarray) -> None:
            def wanted(a, low, high):
                floor = best.bound.reshape(-1, windows)[who[a]]
                return ((high[:, None] >= floor) & (low[:, None] <= hi[who[a]]) & (lo[who[a]] <= hi[who[a]])).any(axis=1)

            def verify(a: np.ndarray, leaf: int) -> None:
                rows, at = tree.rows[leaf], who[a]
                if exact_in_floats * float(np.abs(tree.x[rows]).max(initial=0)) < 2.0**52:
                    scores = (q[at] @ tree.x[rows].T).astype(np.int64)
                else:
                    scores = q[at].astype(np.int64) @ tree.x[rows].T.astype(np.int64)
                other = own[at][:, None] != tree.ids[rows][None, :]
                for w in range(windows):
                    i, j = np.nonzero(other & (scores >= best.bound[at * windows + w][:, None]) & (scores <= hi[at, w][:, None]))
                    if len(i):
                        best.add(at[i] * windows + w, scores[i, j], tree.ids[rows[j]])

            a, leaf, high = descend(tree, q[who], wanted)
            if not len(a):
                return
            order = np.lexsort((-high, a))
            first = np.zeros(len(a), bool)  # each anchor's leaf with the highest bound
            first[order[np.concatenate([[True], a[order][1:] != a[order][:-1]])]] = True
            top = np.full(len(tree.rows), -np.inf)
            np.maximum.at(top, leaf, high)
            for now in (first, ~first):
                for l in sorted(np.unique(leaf[now]).tolist(), key=lambda l: -top[l]):
                    mine = np.flatnonzero(now & (leaf == l))
                    mine = mine[wanted(a[mine], np.full(len(mine), -np.inf), high[mine])]
                    if len(mine):
                        verify(a[mine], l)
                best.trim()

        for label, ids, x, paths in chunks(batches):
            who = np.flatnonzero((labels == label) == same)
            tree = read_tree(ids, x, paths) if len(who) else None
            for i in range(0, len(who), 512):
                look(tree, who[i : i + 512])
        key, score, ids = best.trim()
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array(key // windows), pa.array(key % windows), pa.array(ids), pa.array(score)], ["anchor", "window", "id", "score"])

    found = trees.select("place", "label", "id", "v", "path").mapInArrow(run, "anchor long, window long, id long, score long")
    return best_of_tasks(found, ["anchor", "window"], k, "score", "id")


def hard_negatives(table: DataFrame, anchors: DataFrame, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, vec_id: str = "vec_id",
                   vector: str = "embedding", label: str = "label", scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Components are floor(scale * x), a score is the inner product with the anchor; higher
    scores come first, ties by the smaller id.  An anchor's positives are its first
    ``positives`` rows of the same label and another id; to each belong the first
    ``negatives`` rows of other labels with ``low`` * positive_score <= 100 *
    negative_score <= ``high`` * positive_score.  Fewer than that are all returned.  Rows
    with a null id, label or vector, or a null or non-finite component, take no part;
    vectors of another length than the anchor's are not scored with it.  An anchor's id
    that repeats is asked once, with its smallest row; other rows that repeat an id count
    each.  Other columns are not read; no rows for empty tables.  Anchors go in blocks of
    about BLOCK_NUMBERS components, one block after the other.
    """
    spark = table.sparkSession
    columns = (vec_id, vector, F.col(label), scale)
    trees = index(clean(table, *columns))
    asked = settle(clean(anchors, *columns).groupBy("id").agg(F.min(F.struct("label", "dims", "v")).alias("r")).select("id", "r.*"))
    lengths = {r["dims"]: r["n"] for r in asked.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = [(d, b, many) for d, n in sorted(lengths.items()) if d for many in [-(-n * d // BLOCK_NUMBERS)] for b in range(many)]

    def results() -> Iterator[DataFrame]:
        for d, b, many in blocks:
            rows = asked.filter((F.col("dims") == d) & (F.pmod(F.xxhash64("id"), F.lit(many)) == b)).collect()  # about BLOCK_NUMBERS components
            if not rows:
                continue
            ids = np.array([r["id"] for r in rows], np.int64)
            held = spark.sparkContext.broadcast((ids, np.array([r["label"] for r in rows], object), np.stack([np.frombuffer(r["v"], "<f8") for r in rows])))
            mine = trees.filter(F.col("dims") == d)
            every = np.full((len(ids), 1), 2**60)
            found = search(mine, held, True, positives, -every, every).collect()  # `positives` rows an anchor at most
            lo, hi = np.ones((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)
            for r in found:
                lo[r["anchor"], r["rank"] - 1] = -(-low * r["score"] // 100)
                hi[r["anchor"], r["rank"] - 1] = high * r["score"] // 100
            if not found:
                continue
            named = spark.createDataFrame([(r["anchor"], r["rank"] - 1, int(ids[r["anchor"]]), r["id"], r["score"]) for r in found],
                                          "anchor long, window long, anchor_id long, positive_id long, positive_score long")
            yield (search(mine, held, False, negatives, lo, hi).join(F.broadcast(named), ["anchor", "window"])
                   .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))

    out = one_by_one(spark, results(), len(blocks) > 1)
    return out if out is not None else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
