"""Near-duplicate documents by chosen-path set similarity join.

Each document's shingle set gives minwise values.  In each of several independent
trees, each with coordinates of its own, a document follows paths: a node chooses one
or two of its tree's coordinates that its path has not used, and sends its documents to
children by their values there.  Two sets with Jaccard similarity J stay together along
a branch with probability J, and a node has 1 / threshold children on average, so a pair
at the threshold meets in as many nodes at any depth, while less similar ones die out.
:func:`survival` is the probability that a pair at the threshold meets in a tree, and
:func:`trees_for` the number of trees that a target recall takes.

A document is first compared with the smallest member of its nodes, and the links
found are joined to components; then with the likeliest member of another component
in its block of a node, so that copies of one text are one component before anything
else is compared.  Members of different components that share a small
node are then compared exhaustively, by their minwise values; a large node branches
again, and at the last depth is compared block by block.  For the members of large nodes
that are still apart, :func:`rare_values` says which of their values few of them hold.
Two sets that share none of these share the others at most, which leaves out most pairs
below the threshold before they are made; those that share some are found by them.
Links are always confirmed on full sets.  Sets that are equal are one class from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnspark.llm.common import WordHashes, heavy_light_join, settle, settle_snug, texts

#: Coordinates of a tree: more than its depth, so that the branches of a node mostly go by others.
OWN = 8
#: Depths at which members are compared: large nodes branch on from one to the next.
DEPTHS = (3, 5)
#: Members of a node that are compared exhaustively; at the last depth, of a block of a larger node.
SMALL_NODE = 64
#: Members outside the largest component of a large node that go to each of its blocks, and members of such a block.
OTHERS = 512
#: Sets of members of large nodes that hold a rare value, at most: these are compared by it.
RARE = 64
#: Bytes of sets that are compared in one place: a cell whose pairs need more is cut into tiles.
TILE_BYTES = 16 << 20
#: Pairs at the threshold that share too few minwise values to be confirmed on full sets: a share of one in so many.
GATE_MISS = 1e-7
#: Coordinates at most, and so trees.
MOST_TREES = 16
#: Odd multipliers, from a fixed seed: of a shingle's words, of the coordinates, of node names.
_RANDOM = np.random.default_rng(20240607)
WORD_FACTORS = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
COORDINATE_FACTORS = _RANDOM.integers(0, 2**63, MOST_TREES * OWN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
NODE_FACTORS = _RANDOM.integers(0, 2**63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: A node's name: a hash, then the tree, then the coordinates that its path has used.
TREE_SHIFT, HASH_MASK = np.uint64(OWN), np.uint64(2**64 - 2 ** (OWN + 5))


def survival(percent: int, depth: int) -> float:
    """Probability that a pair at exactly the threshold shares a node of one tree at a depth, if no two branches go by the same coordinate."""
    j, (few, more) = percent / 100, child_counts(percent)
    alive = 1.0
    for _ in range(depth):
        alive = 1 - (1 - more) * (1 - j * alive) ** few - more * (1 - j * alive) ** (few + 1)
    return alive


def child_counts(percent: int) -> tuple[int, float]:
    """Children that every node has, and the share of nodes with one more: 1 / threshold on average."""
    mean = min(100 / percent, OWN / 2)
    return int(mean), mean - int(mean)


def trees_for(recall: float, percent: int) -> int:
    """Trees in which a pair at the threshold meets with probability ``recall`` even at the last depth."""
    return max(1, min(MOST_TREES, math.ceil(math.log(1 - recall) / math.log(1 - survival(percent, DEPTHS[-1])))))


def gate(percent: int, coordinates: int) -> int:
    """Minwise values that a pair must share to be confirmed on full sets: of those at the threshold GATE_MISS share fewer."""
    j, below = percent / 100, 0.0
    for k in range(coordinates + 1):
        below += math.comb(coordinates, k) * j**k * (1 - j) ** (coordinates - k)
        if below > GATE_MISS:
            return k
    return coordinates


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, by multiplication and shifts."""
    x = (x ^ (x >> np.uint64(32))) * NODE_FACTORS[0]
    x = (x ^ (x >> np.uint64(29))) * NODE_FACTORS[1]
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, words: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``size``-word shingles; one for a shorter text; none without words."""
    tokens = (text or b"").lower().split()
    m = len(tokens)
    if not m:
        return np.zeros(0, np.uint64)
    x = np.fromiter(map(words.__getitem__, tokens), np.uint64, m)
    span = min(size, m)
    h = np.full(m - span + 1, np.uint64(span))
    for j in range(span):
        h += x[j : j + m - span + 1] * WORD_FACTORS[j]
    return np.unique(mix(h))


def minwise(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Minwise values of each set, 32 bits each; no set may be empty."""
    x = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), coordinates), "<u4")
    for i, factor in enumerate(COORDINATE_FACTORS[:coordinates]):
        out[:, i] = np.minimum.reduceat(x * factor, starts) >> np.uint64(32)
    return out


def roots(tree: int) -> np.uint64:
    return (mix(np.array([tree + 1], np.uint64))[0] & HASH_MASK) | np.uint64(tree) << TREE_SHIFT


def children(nodes: np.ndarray, mins: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(children, rows): each row's node's children; the node's name alone says how many and which coordinates."""
    draw = mix(nodes ^ NODE_FACTORS[2])
    used, tree = nodes & np.uint64(2**OWN - 1), (nodes >> TREE_SHIFT) & np.uint64(31)
    free = (~(used[:, None] >> np.arange(OWN, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.int64)
    left, rank = free.sum(axis=1), np.cumsum(free, axis=1) - 1
    few, more = child_counts(percent)
    count = np.minimum(few + ((draw >> np.uint64(40)).astype(float) < more * 2.0**24), left)
    found, rows = [], []
    for b in range(few + 1):
        row = np.flatnonzero(count > b)
        wanted = ((draw[row] % left[row].astype(np.uint64)).astype(np.int64) + b) % left[row]
        at = ((rank[row] == wanted[:, None]) & (free[row] > 0)).argmax(axis=1)
        column = tree[row].astype(np.int64) * OWN + at
        value = mins[row, column].astype(np.uint64) + (column.astype(np.uint64) << np.uint64(32))
        name = mix(nodes[row] * NODE_FACTORS[3] + mix(value)) & HASH_MASK
        found.append(name | tree[row] << TREE_SHIFT | used[row] | np.uint64(1) << at.astype(np.uint64))
        rows.append(row)
    return np.concatenate(found), np.concatenate(rows)


def _down(nodes: np.ndarray, rows: np.ndarray, mins: np.ndarray, levels: int, percent: int):
    for _ in range(levels):
        nodes, at = children(nodes, mins[rows], percent)
        rows = rows[at]
    return nodes, rows


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), -1)


def describe(docs: DataFrame, doc_id: str, text: str, size: int, coordinates: int) -> DataFrame:
    """id, n (set size), sig (digest of the set) and mins (minwise values); the last two null for an empty set."""
    import pyarrow as pa

    def run(batches: Iterator):
        words = WordHashes()
        for batch in batches:
            n, sig, mins, todo = [], [], [], texts(batch.column(1))
            for i in range(0, len(todo), 128):
                sets = [shingle_set(t, words, size) for t in todo[i : i + 128]]
                full = [s for s in sets if len(s)]
                values = iter(minwise(full, coordinates) if full else ())
                n += map(len, sets)
                sig += [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                mins += [next(values).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(mins, pa.binary())], ["id", "n", "sig", "mins"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n long, sig binary, mins binary")


def first_nodes(reps: DataFrame, trees: int, percent: int) -> DataFrame:
    """(node, id): every document's nodes at the first of DEPTHS in every tree."""
    import pyarrow as pa

    def run(batches: Iterator):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, mins = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for t in range(trees):
                nodes, rows = _down(np.full(len(ids), roots(t)), np.arange(len(ids)), mins, DEPTHS[0], percent)
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(ids[rows])], ["node", "id"])

    return reps.select("id", "mins").mapInArrow(run, "node long, id long")


def branch(members: DataFrame, reps: DataFrame, levels: int, percent: int) -> DataFrame:
    """(node, id) that many levels further down."""
    import pyarrow as pa

    def run(batches: Iterator):
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, rows = _down(batch.column(0).to_numpy().view(np.uint64), np.arange(batch.num_rows), _matrix(batch.column(2)), levels, percent)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(batch.column(1).to_numpy()[rows])], ["node", "id"])

    rows = members.select("node", "id").join(reps.select("id", "mins"), "id").select("node", "id", "mins")
    return rows.mapInArrow(run, "node long, id long")


def shared_nodes(members: DataFrame) -> DataFrame:
    """(node, id, size, first) of the members of nodes with two or more."""
    stats = settle(members.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first")).filter("size > 1"))
    return settle(heavy_light_join(members, stats, "node", "size"))


def hubs(members: DataFrame) -> DataFrame:
    """(cell, weight, a, b): each member b of the nodes with a, the smallest id that it shares a node with, if smaller than its own."""
    return (members.groupBy("id").agg(F.min("first").alias("a")).filter("a < id")
            .select(F.xxhash64("a").alias("cell"), F.lit(0).cast("long").alias("weight"), "a", F.col("id").alias("b")))


def alike(members: DataFrame, reps: DataFrame, percent: int, agree: int, nearest: bool = False) -> DataFrame:
    """(cell, weight, a, b): pairs a < b of different components that share a node and may be linked; cell is where they met, with ``weight`` pairs in all.

    ``members`` has (node, id, size, component).  Of a node of more than SMALL_NODE
    members, most of them in one component, the others meet that one's members block by
    block; any other large node is cut into blocks of about SMALL_NODE by a hash of the
    id, and every two blocks meet.  A task never holds more than two blocks, or a block
    and the others.  Sizes too different for
    ``percent`` and pairs that share fewer than ``agree`` minwise values are left out.
    With ``nearest`` a block is only compared with itself, and each member gets one
    partner, that with which it shares most values.  With ``common`` of ``reps`` (null
    where not known), so are pairs that cannot be linked if they share no rare value.  A pair comes once for each cell
    that it meets in; :func:`once` chooses one.
    """
    import pyarrow as pa

    def compare(ids, component, own, n, common, mins) -> np.ndarray:
        """Columns (a, b, shared values)."""
        x, y = np.triu_indices(len(ids), 1)
        ok = component[x] != component[y]
        if (own >= 0).any():
            ok &= own[x] != own[y]
        ok &= 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
        most = np.minimum(common[x], common[y])        # -1: not known
        ok &= (most < 0) | ((100 + percent) * most >= percent * (n[x] + n[y]))
        x, y = x[ok], y[ok]
        shared = (mins[x] == mins[y]).sum(axis=1)
        ok = shared >= agree
        x, y, shared = ids[x[ok]], ids[y[ok]], shared[ok]
        if nearest:
            both, of = np.concatenate([x, y]), np.concatenate([y, x])
            order = np.lexsort((of, -np.tile(shared, 2), both))
            both, of, shared = both[order], of[order], np.tile(shared, 2)[order]
            first = np.concatenate([[True], both[1:] != both[:-1]])[: len(both)]
            return np.stack([both[first], of[first], shared[first]])
        return np.stack([np.minimum(x, y), np.maximum(x, y), shared])

    def found(*held) -> np.ndarray:
        pairs = compare(*held[1:])
        return np.concatenate([np.full((1, pairs.shape[1]), held[0][0]), np.full((1, pairs.shape[1]), pairs.shape[1]), pairs])

    def run(batches: Iterator):
        """Rows come sorted by cell; the last cell of a batch waits for the next batch."""
        held, names = None, ["cell", "weight", "a", "b", "shared"]
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy() for i in range(6)] + [_matrix(batch.column(6))]
            held = now if held is None else [np.concatenate(z) for z in zip(held, now, strict=True)]
            cuts = [0, *(np.flatnonzero(held[0][1:] != held[0][:-1]) + 1).tolist()]
            pairs = [found(*(z[i:j] for z in held)) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j - i > 1]
            held = [z[cuts[-1]:] for z in held]
            if pairs:
                pairs = np.concatenate(pairs, axis=1)
                order = np.lexsort((-pairs[1], pairs[3], pairs[2]))      # of a pair's cells, that with most pairs
                pairs = pairs[:, order]
                pairs = pairs[:, np.concatenate([[True], (pairs[2:4, 1:] != pairs[2:4, :-1]).any(axis=0)])[: pairs.shape[1]]]
                yield pa.RecordBatch.from_arrays([pa.array(z) for z in pairs], names)
        if held is not None and len(held[0]) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(z) for z in found(*held)], names)

    def cell(first, second):
        return F.xxhash64("node", F.least(first, second), F.greatest(first, second)).alias("cell")

    blocks = F.ceil(F.col("size") / SMALL_NODE)
    block = F.pmod(F.xxhash64("id"), blocks)
    whole = F.lit(-1).cast("long").alias("own")
    if nearest:
        cells = members.select(cell(block, block), "id", "component", whole)
    else:
        large = members.filter(F.col("size") > SMALL_NODE)
        most = (large.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("node")
                .agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"))
                .select("node", F.col("top.component").alias("major"), (F.col("all") - F.col("top.n") <= OTHERS).alias("few")))
        large = large.join(most, "node")
        # one component and few others: these go to every block of that one
        strips = F.ceil(F.col("size") / OTHERS)
        strip = F.when(F.col("component") == F.col("major"), F.array(F.pmod(F.xxhash64("id"), strips))).otherwise(F.sequence(F.lit(0).cast("long"), strips - 1))
        crowd = large.filter("few").withColumn("at", F.explode(strip)).select(cell(F.col("at"), F.lit(-2).cast("long")), "id", "component", whole)
        mixed = (large.filter("NOT few").withColumns({"own": block, "other": F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))})
                 .select(cell(F.col("own"), F.col("other")), "id", "component", F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own")).cast("long").alias("own")))
        alone = members.filter(F.col("size") <= SMALL_NODE).select(cell(F.lit(0).cast("long"), F.lit(0).cast("long")), "id", "component", whole)
        cells = alone.union(crowd).union(mixed)
    known = F.coalesce("common", F.lit(-1).cast("long")).alias("common")
    rows = cells.join(reps.select("id", "n", known, "mins"), "id").select("cell", "id", "component", "own", "n", "common", "mins")
    pairs = rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "cell long, weight long, a long, b long, shared long")
    if nearest:  # of all its nodes
        pairs = pairs.groupBy("a").agg(F.max(F.struct("shared", "b", "weight", "cell")).alias("best")).select("a", "best.*")
    return pairs.select("cell", "weight", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def once(pairs: DataFrame) -> DataFrame:
    """(cell, a, b): each pair once, in the cell with most pairs of those that it meets in, so that few cells need its sets."""
    return pairs.groupBy("a", "b").agg(F.max(F.struct("weight", "cell")).alias("at")).select("at.cell", "a", "b")


def rare_values(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(value, id) of the values that 2 to RARE of ``sets`` hold; (id, alone): how many values only this set holds."""
    import pyarrow as pa

    def run(batches: Iterator):
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                held = [np.frombuffer(v, "<i8") for v in part.column(1).to_pylist()]
                ids = np.repeat(part.column(0).to_numpy(), list(map(len, held)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(ids)], ["value", "id"])

    values = sets.select("id", "set").mapInArrow(run, "value long, id long")
    holders = values.groupBy("value").agg(F.count(F.lit(1)).alias("holders"), F.min("id").alias("id"))
    alone = holders.filter("holders = 1").groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    return values.join(holders.filter(F.col("holders").between(2, RARE)).select("value"), "value"), alone


def shares(sets: DataFrame, rare: DataFrame, alone: DataFrame) -> DataFrame:
    """(id, n, found, common): a set's size, how many of its values any other of ``sets`` holds, and how many of these are not rare.

    No set shares more than ``found`` values with another, nor more than ``common`` besides
    the rare ones.  Ids with several sets are not in the result.
    """
    one = sets.groupBy("id").agg(F.count(F.lit(1)).alias("sets"), F.max(F.octet_length("set") / 8).cast("long").alias("n")).filter("sets = 1")
    few = rare.groupBy("id").agg(F.count(F.lit(1)).alias("rare"))
    found = F.col("n") - F.coalesce("alone", F.lit(0))
    return one.join(alone, "id", "left").join(few, "id", "left").select("id", "n", found.alias("found"), (found - F.coalesce("rare", F.lit(0))).alias("common"))


def by_rare_values(rare: DataFrame, known: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """(cell, weight, a, b): pairs a < b of different components that share so many rare values that they may be linked; ``known`` is of :func:`shares`."""
    able = known.filter(100 * F.col("found") >= percent * F.col("n")).select("id", "n", "common")
    rows = rare.join(able, "id").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = rows.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("value")
    rows = rows.join(apart, "value", "left_semi")
    x, y = (rows.select("value", *(F.col(c).alias(end + c) for c in ("id", "n", "common", "component"))) for end in "xy")
    met = x.join(y, "value").filter("xid < yid AND xcomponent <> ycomponent").groupBy("xid", "yid", "xn", "yn", "xcommon", "ycommon").agg(F.count(F.lit(1)).alias("shared"))
    enough = (100 + percent) * (F.least("xcommon", "ycommon") + F.col("shared")) >= percent * (F.col("xn") + F.col("yn"))
    return met.filter(enough).select(F.xxhash64("xid").alias("cell"), F.lit(0).cast("long").alias("weight"), F.col("xid").alias("a"), F.col("yid").alias("b"))


def central(members: DataFrame, known: DataFrame) -> DataFrame:
    """(cell, weight, a, b): each member of nodes with the one of these whose set has most of its values in others, of all in its nodes."""
    rows = members.select("node", "id").join(known.select("id", (F.col("found") / F.col("n")).alias("part")), "id")
    best = rows.groupBy("node").agg(F.max(F.struct("part", (-F.col("id")).alias("last"))).alias("best"))
    hub = rows.join(best, "node").groupBy("id").agg(F.max("best").alias("best")).select("id", (-F.col("best.last")).alias("hub")).filter("hub <> id")
    return hub.select(F.xxhash64("hub").alias("cell"), F.lit(0).cast("long").alias("weight"), F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))


def linked(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of (cell, a, b) whose sets have 100 * intersection >= percent * union.

    A set goes once to each cell with a pair of it, not once a pair.  A cell that needs
    more than TILE_BYTES of sets (``sizes`` has n, the numbers of 8 byte values) is cut into tiles
    by hashes of both ids, each of which needs about that much or two sets.
    ``pairs`` and ``sets`` should be settled, as they are read twice.
    """
    import pyarrow as pa

    def alike_enough(x: np.ndarray, y: np.ndarray) -> bool:
        small, large = sorted((x, y), key=len)
        if 100 * len(small) < percent * len(large):
            return False
        at = np.searchsorted(large, small)
        both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
        return 100 * both >= percent * (len(small) + len(large) - both)

    def run(batches: Iterator):
        """Rows come sorted by tile, and in a tile the sets come first."""
        tile, held = None, {}
        for batch in batches:
            out = [], []
            for t, a, b, values in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if t != tile:
                    tile, held = t, {}
                if values is not None:
                    held.setdefault(a, []).append(np.frombuffer(values, "<u8"))
                elif any(alike_enough(x, y) for x in held[a] for y in held[b]):    # rows that repeat an id have a set each
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in out], ["a", "b"])

    def ends(rows: DataFrame, at: str) -> DataFrame:
        return rows.select(at, F.explode(F.array("a", "b")).alias("id")).distinct()

    total = F.sum(8 * F.col("n"))
    large = settle_snug(ends(pairs, "cell").join(sizes, "id").groupBy("cell").agg(F.ceil(total / TILE_BYTES).alias("tiles")).filter("tiles > 1"))
    if large.isEmpty():
        tiled = pairs.select(F.col("cell").alias("tile"), "a", "b")
    else:
        # Spark splits the join where one cell has very many pairs
        tiles = F.coalesce("tiles", F.lit(1).cast("long"))
        tiled = pairs.join(large, "cell", "left").select(F.xxhash64("cell", F.pmod(F.xxhash64("a"), tiles), F.pmod(F.xxhash64("b"), tiles)).alias("tile"), "a", "b")
    needed = ends(tiled, "tile").join(sets, "id").select("tile", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "set")
    rows = needed.union(tiled.select("tile", "a", "b", F.lit(None).cast("binary")))
    return rows.repartition("tile").sortWithinPartitions("tile", F.col("set").isNull()).mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in a link, by alternating large and small stars."""
    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        near = both if large else both.filter("v < u")
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # an id in very many links is skewed here, and Spark splits it
        rows = near.join(least, "u")
        out = rows.filter("v > u").select("v", "m") if large else rows.select("v", "m").union(least.select("u", "m"))
        # edges only get fewer: as many tasks as there were carry them on
        return settle_snug(out.filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).coalesce(edges.rdd.getNumPartitions()).distinct())

    edges = settle_snug(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        # done when every id has one edge to a smaller id, and that one has none
        roles = edges.select(F.col("b").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("a", F.lit(0), F.lit(1)))
        if roles.groupBy("id").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below + above > 1").isEmpty():
            return edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
        edges = star(star(edges, True), False)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75, recall: float = 0.99) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id and kept for every row of ``docs``.

    Words are split at ASCII white space, A-Z in lower case; a set holds the distinct
    ``size``-word shingles (the whole text, if it has fewer words), as 64-bit hashes.
    Documents are linked if 100 * intersection >= ``percent`` * union.  class_id is
    the smallest id with an equal set, component_id the smallest that links lead to;
    kept says that the row's id is that.  ``recall`` is the least share of links at the
    threshold that are found directly, even in the largest groups; of others more are.  Null, empty and wordless texts are linked
    with nothing (class_id null).  Rows that repeat an id are one document with all
    their links.  Rows with a null id are linked with nothing: component_id is null,
    kept is true.  Other columns are not read.
    """
    import pyarrow as pa
    trees = trees_for(recall, percent)
    agree = gate(percent, trees * OWN)
    base = settle(describe(docs, doc_id, text, size, trees * OWN))
    some = base.filter("id IS NOT NULL AND sig IS NOT NULL")
    classes = settle(some.groupBy("sig").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_docs"), F.any_value("n").alias("n"), F.any_value("mins").alias("mins")))

    def sets_of(batches: Iterator):
        words = WordHashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([shingle_set(t, words, size).astype("<u8").tobytes() for t in texts(batch.column(1))], pa.binary())], ["id", "set"])

    members = shared_nodes(first_nodes(classes, trees, percent))
    candidates = settle(members.select("id").distinct())
    sets = settle(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(candidates, "id", "left_semi")
                  .mapInArrow(sets_of, "id long, set binary").filter(F.octet_length("set") > 0).distinct())
    tested = settle_snug(hubs(members))
    sizes = classes.select("id", "n")
    links = settle_snug(linked(tested, sets, sizes, percent))
    tested = tested.select("a", "b")
    comp = components(links)
    reps, sharing = classes.withColumn("common", F.lit(None).cast("long")), None

    def still_open(members: DataFrame) -> DataFrame:
        """The members of nodes that hold several components."""
        marked = members.select("node", "id", "size").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = marked.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("node")
        return settle(marked.join(mixed, "node", "left_semi"))

    def confirm(pairs: DataFrame) -> bool:
        """Test what has not been tested, and join the components that are linked."""
        nonlocal tested, comp
        of = comp.select(F.col("id").alias("a"), F.col("component").alias("ca")), comp.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        apart = (once(pairs).join(tested, ["a", "b"], "left_anti").join(of[0], "a", "left").join(of[1], "b", "left")
                 .filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")))
        fresh = settle_snug(apart.select("cell", "a", "b"))
        tested = tested.union(fresh.select("a", "b"))
        found = settle_snug(linked(fresh, sets, sizes, percent))
        if found.isEmpty():
            return False
        comp = components(comp.select(F.col("component").alias("a"), F.col("id").alias("b")).union(found))
        return True

    def without_lonely(members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The members of nodes that are still open when those of large nodes are linked with the central ones, and pairs that share rare values.

        Members of large nodes that can be linked with no other of these leave them.  All
        members of a large node are counted, and so are those of the nodes below it."""
        nonlocal reps
        crowded = F.col("size") > SMALL_NODE
        large = members.filter(crowded)
        crowd = settle(sets.join(large.select("id").distinct(), "id", "left_semi"))
        rare, alone = rare_values(crowd)
        rare = settle(rare)
        known = settle(shares(crowd, rare, alone))
        reps = classes.join(known.select("id", "common"), "id", "left")
        confirm(central(large, known))
        lonely = known.filter(100 * F.col("found") < percent * F.col("n")).select("id", F.lit(True).alias("lonely"))
        left = members.join(lonely, "id", "left").filter(~(crowded & F.coalesce("lonely", F.lit(False)))).select("node", "id")
        sizes = left.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        return still_open(left.join(sizes, "node")), by_rare_values(rare, known, comp, percent)

    for depth, deeper_by in zip(DEPTHS, [*np.diff(DEPTHS).tolist(), 0], strict=True):
        open_ = still_open(members)
        if not open_.isEmpty() and confirm(alike(open_, reps, percent, agree, nearest=True)):
            open_ = still_open(members)
        if depth == DEPTHS[0] and not open_.filter(F.col("size") > SMALL_NODE).isEmpty():
            open_, sharing = without_lonely(open_)
        if open_.isEmpty() and sharing is None:
            break
        last = depth == DEPTHS[-1]
        small = open_ if last else open_.filter(F.col("size") <= SMALL_NODE)
        across = alike(small, reps, percent, agree)
        if sharing is not None:
            across, sharing = across.union(sharing), None
        members = None
        if not last:
            deeper = open_.filter(F.col("size") > SMALL_NODE)
            if not deeper.isEmpty():
                members = shared_nodes(settle(branch(deeper, classes, deeper_by, percent)))
                across = across.union(hubs(members))
        confirm(across)
        if members is None:
            break

    named = settle(classes.select("sig", F.col("id").alias("class_id"), "n_docs").join(comp.withColumnRenamed("id", "class_id"), "class_id", "left")
                   .select("sig", "class_id", F.coalesce("component", "class_id").alias("component"), "n_docs"))
    placed = heavy_light_join(some.select("id", "n", "sig"), named, "sig", "n_docs").select("id", "n", "class_id", "component")
    alone = base.filter("id IS NULL OR sig IS NULL").select("id", "n", F.lit(None).cast("long").alias("class_id"), F.col("id").alias("component"))
    return placed.union(alone).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "class_id", F.col("component").alias("component_id"),
                                      F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
