"""Mixing sources to target weights, by a budget that runs down a tree of domains, languages and sources.

A node's budget is split among its children in proportion to their weights, but no
child gets more than its leaves can supply.  What a child cannot take goes to its
siblings first, as the split is among the children of one node; only what all of
them cannot take is missing in that node's own supply, and so goes to the node's
siblings.  Solved by sorting, without iterations: with children in the order of
supply / weight, those before some place are full and the others share the rest.

A leaf's documents are laid out in epochs, each in an order drawn from the seed and
the epoch's number; the leaf takes the prefix of whole documents that fits its budget.

Everything is DataFrame expressions, with token counts in integers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnspark.llm.common import SPACE_RE, own_name, settle

#: Bits of a document's place in an epoch's order, and of the bins that find where a prefix ends.
ORDER_BITS, BIN_BITS = 48, 16
LEVELS = ("domain", "language", "source")


def count_tokens(text: Column) -> Column:
    """White-space separated words; 0 for a null text."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RE), "")).cast("long")


def weight_of(level: str, weights: dict[str, int]) -> Column:
    """The node's weight by its name, 1 if it has none."""
    return reduce(lambda out, w: F.when(F.col(level).eqNullSafe(F.lit(w[0])), F.lit(w[1])).otherwise(out), weights.items(), F.lit(1)).cast("long")


def place_in(epoch: Column, key: Column, seed: int) -> Column:
    """The document's place in an epoch's order: the first ORDER_BITS of a digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key)), 1, ORDER_BITS // 4), 16, 10).cast("long")


def split_budget(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Replace each node's ``budget`` (its parent's) by its own share.

    ``nodes`` has supply, weight (long, 0 or more) and budget.  A node with weight 0
    or no supply gets nothing.  Shares are whole tokens: the floor of the running
    exact share less that of the node before.
    """
    able = (F.col("weight") > 0) & (F.col("supply") > 0)
    weight, supply = F.when(able, F.col("weight")).otherwise(F.lit(0)), F.when(able, F.col("supply")).otherwise(F.lit(0))
    rows = nodes.withColumns({"w": weight, "s": supply})
    # exact order of s / w by cross multiplication is not sortable; as doubles it is, and equal quotients give equal shares
    order = Window.partitionBy(*parents).orderBy(F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(F.lit(-1.0)), F.col(name).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"s_before": F.coalesce(F.sum("s").over(before), F.lit(0)),
                             "w_from": F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    dec = lambda c: F.col(c).cast("decimal(19,0)")
    # full if its supply is no more than its share of what those before have left
    full = (F.col("w") == 0) | (dec("s") * dec("w_from") <= dec("w") * (dec("budget") - dec("s_before")))
    rows = rows.withColumn("full", full)
    rows = rows.withColumn("all_full", F.min(F.col("full").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1)
    whole = Window.partitionBy(*parents)
    rows = rows.withColumns({
        "rest": F.greatest(F.lit(0), F.col("budget") - F.coalesce(F.sum(F.when(F.col("all_full"), F.col("s"))).over(whole), F.lit(0))),
        "w_open": F.coalesce(F.sum(F.when(~F.col("all_full"), F.col("w"))).over(whole), F.lit(0)),
        "w_upto": F.coalesce(F.sum(F.when(~F.col("all_full"), F.col("w"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)),
    })

    def floor_share(upto: Column) -> Column:
        """rest * upto div w_open, in exact integers."""
        return F.call_function("div", upto.cast("decimal(18,0)") * F.col("rest").cast("decimal(18,0)"), F.greatest(F.col("w_open"), F.lit(1)).cast("decimal(18,0)")).cast("long")

    share = floor_share(F.col("w_upto")) - floor_share(F.col("w_upto") - F.col("w"))
    return (rows.withColumn("budget", F.when(F.col("all_full"), F.col("s")).otherwise(share).cast("long"))
            .drop("w", "s", "s_before", "w_from", "full", "all_full", "rest", "w_open", "w_upto"))


def leaf_budgets(leaves: DataFrame, budget: int, weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """(domain, language, source, tokens, budget): the tree's leaves with their shares of ``budget``.

    ``leaves`` has the three names and tokens.  The tree is a table with a row for each node.
    """
    supply = leaves.withColumn("supply", F.col("tokens") * F.lit(max_epochs))
    known = None
    for depth, level in enumerate(LEVELS):
        path, parents = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        nodes = supply.groupBy(*path).agg(F.sum("supply").alias("supply")).withColumn("weight", weight_of(level, weights.get(level, {})))
        if known is None:
            nodes = nodes.withColumn("budget", F.lit(budget).cast("long"))
            parents = [own_name(nodes, "root")]
            nodes = nodes.withColumn(parents[0], F.lit(0))
        else:
            up = known.select(*[F.col(p).alias(f"up_{p}") for p in parents], "budget")
            same = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(f"up_{p}")) for p in parents])
            nodes = nodes.join(up, same).drop(*[f"up_{p}" for p in parents])
        known = settle(split_budget(nodes, parents, level).select(*path, "budget"))
    same = reduce(lambda a, b: a & b, [leaves[p].eqNullSafe(known[p]) for p in LEVELS])
    return leaves.join(known, same).select(*[leaves[p] for p in LEVELS], "tokens", "budget")


def mix(docs: DataFrame, *, domain: Column, language: str = "lang", source: str = "source", doc_id: str = "doc_id", text: str = "text",
        budget: int | float = 1.0, weights: dict[str, dict[str, int]] | None = None, max_epochs: int = 1, seed: int = 0) -> DataFrame:
    """Every row and column of ``docs``, with domain, tokens and copies (columns of these names are replaced).

    ``budget`` is a number of tokens, or as a float the share of all tokens.
    ``weights[level][name]`` are whole numbers, 1 where none is given, 0 to leave a
    node out.  copies is how often the mix takes the row: once for each whole epoch
    of its leaf, and once more if it lies in the last epoch's prefix (its running
    sum of tokens is within what is left).  Null names are nodes of their own; rows
    without words cost nothing and are taken in whole epochs, or with the prefix.
    An epoch's order goes by a digest of seed, epoch and id, then by id; rows that
    share an id (or have none) stand together and are taken together, or not at all.
    An empty table gives no rows.
    """
    weights = weights or {}
    shadow = {level: own_name(docs, f"mix_{level}") for level in LEVELS}
    n, key, leaf = own_name(docs, "mix_tokens"), own_name(docs, "mix_key"), own_name(docs, "mix_leaf")
    named = docs.withColumns({shadow["domain"]: domain.cast("string"), shadow["language"]: F.col(language).cast("string"),
                              shadow["source"]: F.col(source).cast("string"), n: count_tokens(F.col(text)),
                              key: F.coalesce(F.col(doc_id).cast("string"), F.lit(""))})
    leaf_name = F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(shadow[x])), F.lit("")) for x in LEVELS])
    # one narrow row for each document; the texts are read again at the end
    narrow = settle(named.select(F.col(key).alias("key"), F.col(n).alias("n"), leaf_name.alias("leaf"), *[F.col(shadow[x]).alias(x) for x in LEVELS]))
    leaves = settle(narrow.groupBy("leaf", *LEVELS).agg(F.sum("n").alias("tokens")))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    wanted = int(budget * total) if isinstance(budget, float) else int(budget)
    shares = leaf_budgets(leaves, min(wanted, total * max_epochs), weights, max_epochs)
    shares = shares.withColumn("leaf", F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(x)), F.lit("")) for x in LEVELS]))
    # whole epochs, and what is left for the prefix of the next
    plan = settle(shares.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div greatest(tokens, 1)")).otherwise(0).cast("long"))
                  .withColumn("left", F.col("budget") - F.col("epochs") * F.col("tokens")).select("leaf", "epochs", "left", "tokens"))
    n_leaves = plan.count()
    small = F.broadcast(plan) if n_leaves <= 100_000 else plan

    placed = narrow.select("leaf", "key", "n").join(small, "leaf").filter((F.col("left") > 0) | (F.col("tokens") == 0)).withColumn("place", place_in(F.col("epochs"), F.col("key"), seed))
    # where does the prefix end? sums by bin find the bin; only its documents are put in order
    bins = placed.withColumn("bin", F.shiftright("place", ORDER_BITS - BIN_BITS)).groupBy("leaf", "left", "bin").agg(F.sum("n").alias("w"))
    running = Window.partitionBy("leaf").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = settle(bins.withColumn("upto", F.sum("w").over(running)).filter(F.col("upto") > F.col("left"))
                  .groupBy("leaf").agg(F.min(F.struct("bin", "w", "upto")).alias("e")).select("leaf", F.col("e.bin").alias("edge"), (F.col("e.upto") - F.col("e.w")).alias("before")))
    inside = placed.join(F.broadcast(edge) if n_leaves <= 100_000 else edge, "leaf").filter(F.shiftright("place", ORDER_BITS - BIN_BITS) == F.col("edge"))
    in_order = Window.partitionBy("leaf").orderBy("place", "key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    first_out = (inside.withColumn("upto", F.col("before") + F.sum("n").over(in_order)).filter(F.col("upto") > F.col("left"))
                 .groupBy("leaf").agg(F.min(F.struct("place", "key")).alias("f")))
    # each leaf: whole epochs, and the first (place, key) that the prefix leaves out
    final = settle(plan.join(first_out, "leaf", "left").select("leaf", "epochs", F.col("f.place").alias("stop"), F.col("f.key").alias("stop_key"),
                                                             ((F.col("left") > 0) | (F.col("tokens") == 0)).alias("partly")))
    rules = final.withColumnRenamed("leaf", leaf)
    rows = named.withColumn(leaf, leaf_name).join(F.broadcast(rules) if n_leaves <= 100_000 else rules, leaf)
    at = place_in(F.col("epochs"), F.col(key), seed)
    ahead = F.col("stop").isNull() | (at < F.col("stop")) | ((at == F.col("stop")) & (F.col(key) < F.col("stop_key")))
    out = rows.withColumn("copies", (F.col("epochs") + F.when(F.col("partly") & ahead, 1).otherwise(0)).cast("int"))
    return out.select(*[F.col(c) for c in docs.columns if c not in ("domain", "tokens", "copies")], F.col(shadow["domain"]).alias("domain"), F.col(n).alias("tokens"), "copies")
