"""Sharding by a k-d tree over document metadata.

Each node that holds more than one shard is split along the dimension in which its
rows spread widest, at the weighted quantile that gives each side its share of the
bytes.  The quantile is located by histograms: bins of the sort key are summed over
all rows, the bin that holds the wanted weight is divided again, and so on.  The
sort key is (dimension, hash of the text, hash of the id): equal texts lie together
and are divided only when a cut falls inside their group, as it must in a group
larger than a shard.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnspark.llm.common import rank_within, settle

#: Bits of a dimension, of the text's hash below it, of the id's hash, and of one histogram.
DIM_BITS, TEXT_BITS, ID_BITS, STEP_BITS = 20, 28, 48, 16


@dataclass
class Node:
    """A node of the tree; a cut (low, high) sends rows with key < low, or key = low and id hash < high, to the left."""

    shards: int
    weight: int = 0
    dim: int = 0
    cut: tuple[int, int] | None = None
    children: tuple[int, int] = (0, 0)
    # the search for the cut: level 0 looks at the key, level 1 at the id hash of rows whose key is `at`
    level: int = 0
    left_bits: int = DIM_BITS + TEXT_BITS
    prefix: int = 0
    at: int = 0
    want: float = field(default=0.0)


def unit_hash(value: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(value), 64 - bits)


def dimensions(size: Column, lang: Column) -> list[Column]:
    """Metadata as integers of DIM_BITS bits: the text's size on a log scale, and its language."""
    log_size = F.floor(F.log2(size.cast("double")) * F.lit((1 << DIM_BITS) / 48.0)).cast("long")
    return [log_size, F.when(lang.isNull(), F.lit(0).cast("long")).otherwise(unit_hash(lang, DIM_BITS))]


def place(tree: list[Node]) -> Column:
    """The node that a row falls in, by walking down from the root."""
    depth, todo = 0, [(0, 0)]
    while todo:
        i, d = todo.pop()
        depth = max(depth, d)
        if tree[i].cut is not None:
            todo += [(c, d + 1) for c in tree[i].children]
    if not depth:
        return F.lit(0)

    def table(values, kind):
        return F.array(*[F.lit(v).cast(kind) for v in values])

    dims, lows, highs = table([n.dim for n in tree], "int"), table([(n.cut or (0, 0))[0] for n in tree], "long"), table([(n.cut or (0, 0))[1] for n in tree], "long")
    inner, lefts, rights = table([n.cut is not None for n in tree], "boolean"), table([n.children[0] for n in tree], "int"), table([n.children[1] for n in tree], "int")

    def step(node: Column, _: Column) -> Column:
        key, low = F.get(F.col("keys"), F.get(dims, node)), F.get(lows, node)
        left = (key < low) | ((key == low) & (F.col("id_hash") < F.get(highs, node)))
        return F.when(~F.get(inner, node), node).when(left, F.get(lefts, node)).otherwise(F.get(rights, node))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)


def find_cuts(rows: DataFrame, tree: list[Node], active: list[int], tolerance: float) -> None:
    """Locate the cuts of the ``active`` nodes, all of them in the same passes."""
    spark = rows.sparkSession
    found = rows.withColumn("node", place(tree))
    spread = found.groupBy("node").agg(F.sum("size").alias("weight"), *[f(F.get("keys", F.lit(d))).alias(f"{name}{d}") for d in range(2) for name, f in (("lo", F.min), ("hi", F.max))]).collect()
    whole = [max(1, max(r[f"hi{d}"] for r in spread) - min(r[f"lo{d}"] for r in spread)) for d in range(2)] if spread else [1, 1]
    by_node = {r["node"]: r for r in spread}  # a row for each node of this depth
    for i in active:
        n, r = tree[i], by_node.get(i)
        if r is None:  # no rows: any cut does
            n.cut = (0, 0)
            continue
        n.weight = r["weight"]
        n.dim = max(range(2), key=lambda d: ((r[f"hi{d}"] - r[f"lo{d}"]) / whole[d], -d))
        n.want = n.weight * (n.shards // 2) / n.shards
    pending = [i for i in active if tree[i].cut is None]
    while pending:
        state = spark.createDataFrame(
            [(i, n.dim, n.level, n.left_bits, n.prefix, n.at, float(n.want)) for i in pending for n in [tree[i]]],
            "node int, dim int, level int, left_bits int, prefix long, at long, want double")  # a row for each node
        value = F.when(F.col("level") == 0, F.get("keys", F.col("dim"))).otherwise(F.col("id_hash"))
        inside = ((F.col("level") == 0) | (F.get("keys", F.col("dim")) == F.col("at"))) & (F.expr("shiftright(value, left_bits)") == F.col("prefix"))
        bins = (found.join(F.broadcast(state), "node").withColumn("value", value).filter(inside)
                .withColumn("bin", F.expr(f"shiftright(value, left_bits - {STEP_BITS})"))
                .groupBy("node", "want", "bin").agg(F.sum("size").alias("w")))
        running = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        crossing = (bins.withColumn("upto", F.sum("w").over(running)).filter(F.col("upto") >= F.col("want"))
                    .groupBy("node").agg(F.min(F.struct("bin", "w", "upto")).alias("b")))
        for r in crossing.collect():  # a row for each node
            n, (b, w, upto) = tree[r["node"]], r["b"]
            n.left_bits -= STEP_BITS
            before = upto - w
            if w > tolerance and n.left_bits > 0:
                n.prefix, n.want = b, n.want - before
            elif w > tolerance and n.level == 0:  # one key holds too much: divide it by the ids' hashes
                n.level, n.at, n.left_bits, n.prefix, n.want = 1, b, ID_BITS, 0, n.want - before
            else:
                edge = (b if n.want - before < upto - n.want else b + 1) << n.left_bits
                n.cut = (edge, 0) if n.level == 0 else (n.at, edge)
        pending = [i for i in pending if tree[i].cut is None]


def build_tree(rows: DataFrame, shards: int, tolerance: float) -> list[Node]:
    tree, active = [Node(shards)], [0] if shards > 1 else []
    while active:
        find_cuts(rows, tree, active, tolerance)
        following = []
        for i in active:
            n = tree[i]
            n.children = (len(tree), len(tree) + 1)
            for part in (n.shards // 2, n.shards - n.shards // 2):
                if part > 1:
                    following.append(len(tree))
                tree.append(Node(part))
        active = following
    return tree


def shard(docs: DataFrame, shards: int = 40, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          tolerance: float = 5e-4) -> DataFrame:
    """Put every row into one of ``shards`` shards of near-equal bytes.

    Returns doc_id, size (UTF-8 bytes of the text plus 16, a null text having none),
    text_crc32, shard, slot (gapless from 0 in each shard, in the order of the id's
    hash).  A search ends at a bin with less than ``tolerance`` of a shard's bytes;
    beyond that, shards differ by whole documents only.  Rows that repeat an id stay
    together; a null id hashes as null.  Null languages form one value.  Other
    columns are not read; an empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    size = (F.octet_length(body) + 16).cast("long")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), size.alias("size"), F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
                       unit_hash(body, TEXT_BITS).alias("text_hash"), F.col(lang).alias("lang"))
    keys = [F.shiftleft(d, TEXT_BITS).bitwiseOR(F.col("text_hash")) for d in dimensions(F.col("size"), F.col("lang"))]
    rows = settle(base.select("doc_id", "size", "text_crc32", F.array(*keys).alias("keys"), unit_hash(F.col("doc_id"), ID_BITS).alias("id_hash")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    tree = build_tree(rows, shards, tolerance * total / shards)
    leaves: list[int] = []

    def visit(i: int) -> None:
        if tree[i].cut is None:
            leaves.append(i)
        else:
            for c in tree[i].children:
                visit(c)

    visit(0)
    number = {leaf: k for k, leaf in enumerate(leaves)}
    numbers = F.array(*[F.lit(number.get(i, -1)) for i in range(len(tree))])
    placed = rows.withColumn("shard", F.get(numbers, place(tree))).drop("keys")
    ranked = rank_within(placed, "shard", F.shiftrightunsigned("id_hash", ID_BITS - 10), [F.col("id_hash"), F.col("doc_id"), F.col("text_crc32")], "slot")
    return ranked.select("doc_id", "size", "text_crc32", "shard", "slot")
