"""Ranked lexical search of many items at once, by shared sums.

An item's score in a document is the sum of what each of its terms adds there.  Terms
that several items share are added up once: the items of a block are mined for sets
of terms in common, pair by pair (the two summands that most items hold together
become one), which gives a graph of sums whose roots are the items.  Tasks work
documents off in batches, fill in what each term adds, evaluate the graph level by
level, each sum once for all items that use it, and keep the best rows of each item.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnspark.llm.common import BestOf, best_of_tasks, one_by_one, settle, texts

#: (item, term) pairs of a block of items: bounds what the driver mines and every task holds.
BLOCK_TERMS = 200_000
#: Summands of an item that are mined together; a longer item is mined piece by piece.
PIECE = 200
#: Numbers that a batch's sums may take.
CELLS = 1 << 21
#: Term characters stay, A-Z in lower case; others become blanks.  All bytes of characters beyond ASCII belong to terms.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


@dataclass
class SumGraph:
    """Sums of terms: node i < ``terms`` is a term; ``levels`` has (node, left, right) arrays, in an order that fits; an item is the sum of ``roots[begins[i]:]``."""

    terms: int
    nodes: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    roots: np.ndarray
    begins: np.ndarray

    def evaluate(self, sums: np.ndarray) -> np.ndarray:
        """Item by document, from ``sums`` (node by document) with the terms' rows filled in."""
        for node, left, right in self.levels:
            sums[node] = sums[left] + sums[right]
        return np.add.reduceat(sums[self.roots], self.begins, axis=0)


def mine(items: list[list[int]], terms: int) -> SumGraph:
    """The graph of sums for ``items``, lists of distinct terms that are not empty: greedily, the pair that most items share becomes a node."""
    pieces = [set(item[i : i + PIECE]) for item in items for i in range(0, len(item), PIECE)]
    of_item = [k for k, item in enumerate(items) for _ in range(0, len(item), PIECE)]
    made: list[tuple[int, int]] = []
    users = defaultdict(set)
    for p, piece in enumerate(pieces):
        for t in piece:
            users[t].add(p)

    def put(a: int, b: int, where: set[int]) -> int:
        node = terms + len(made)
        made.append((a, b))
        users[node] = set(where)
        for p in where:
            pieces[p] -= {a, b}
            pieces[p].add(node)
        users[a] -= where
        users[b] -= where
        return node

    # terms that the very same pieces hold are one summand from the start
    alike = defaultdict(list)
    for t in sorted(users):
        alike[frozenset(users[t])].append(t)
    for where, group in alike.items():
        if len(where) > 1:
            node = group[0]
            for t in group[1:]:
                node = put(node, t, set(where))
    count = Counter(pair for piece in pieces for pair in combinations(sorted(t for t in piece if len(users[t]) > 1), 2))
    queue = [(-n, pair) for pair, n in count.items() if n > 1]
    heapq.heapify(queue)
    while queue:
        n, pair = heapq.heappop(queue)
        now = len(users[pair[0]] & users[pair[1]])
        if now < 2:
            continue
        if now < -n:  # fewer items since it was counted
            heapq.heappush(queue, (-now, pair))
            continue
        where = users[pair[0]] & users[pair[1]]
        node = put(*pair, where)
        others = Counter(t for p in where for t in pieces[p] if t != node and len(users[t]) > 1)
        for t, m in others.items():
            if m > 1:
                heapq.heappush(queue, (-m, (t, node)))
    depth = [0] * (terms + len(made))
    for i, (a, b) in enumerate(made):
        depth[terms + i] = 1 + max(depth[a], depth[b])
    by_depth = defaultdict(list)
    for i, (a, b) in enumerate(made):
        by_depth[depth[terms + i]].append((terms + i, a, b))
    roots = [[] for _ in items]
    for k, piece in zip(of_item, pieces, strict=True):
        roots[k] += sorted(piece)
    return SumGraph(terms, len(depth), [tuple(np.array(z) for z in zip(*by_depth[d], strict=True)) for d in sorted(by_depth)],
                    np.array([t for r in roots for t in r], np.int64), np.cumsum([0, *map(len, roots)])[:-1])


def statistics(docs: DataFrame, vocabulary) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, their terms in all, and for each term of the (broadcast) vocabulary the documents that hold it."""
    import pyarrow as pa

    def run(batches: Iterator):
        known, df, some, total = vocabulary.value, Counter(), 0, 0
        for batch in batches:
            for text in texts(batch.column(1)):
                terms = terms_of(text)
                some += bool(terms)
                total += len(terms)
                df.update(known[t] for t in known.keys() & set(terms))
        rows = [(-1, some), (-2, total), *df.items()]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())], ["term", "n"])

    # a row for each term of the block at most
    found = {r["term"]: r["n"] for r in docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return found.pop(-1, 0), found.pop(-2, 0), found


def search_block(docs: DataFrame, items: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    """The ``k`` best documents of each item of a block; each has a term at least."""
    import pyarrow as pa
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    known = spark.sparkContext.broadcast(vocabulary)
    some, total, df = statistics(docs, known)
    weights = np.array([np.floor(1000 * np.log((2 * some + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))]).astype(np.int64)
    names = np.array([i for i, _ in items], np.int64)
    shared = spark.sparkContext.broadcast((mine([[vocabulary[t] for t in terms] for _, terms in items], len(vocabulary)), weights, names))

    def run(batches: Iterator):
        graph, weight, items_ = shared.value
        best = BestOf(len(items_), k, 1)
        wide = max(1, CELLS // (graph.nodes + len(graph.roots)))
        for batch in batches:
            ids, bodies = batch.column(0), texts(batch.column(1))
            for at in range(0, len(bodies), wide):
                rows, docs_at, lengths, numbers = [], [], [], ids.slice(at, wide).to_numpy(zero_copy_only=False)
                terms_at, tf = [], []
                for text in bodies[at : at + wide]:
                    terms = terms_of(text)
                    counts = Counter(terms)
                    held = known.value.keys() & counts.keys()
                    if held:
                        docs_at.append(len(rows))
                        terms_at += [known.value[t] for t in held]
                        tf += [counts[t] for t in held]
                        lengths += [len(terms)] * len(held)
                    rows.append(len(held))
                if not tf:
                    continue
                where = np.repeat(np.arange(len(rows)), rows)
                tf, terms_at = np.array(tf, np.int64), np.array(terms_at, np.int64)
                m = 50 + 50 * np.array(lengths, np.int64) * some // total
                sums = np.zeros((graph.nodes, len(rows)), np.int64)
                sums[terms_at, where] = weight[terms_at] * (1_000_000_000 * tf // (1000 * tf + 20 * m))
                scores = graph.evaluate(sums)
                item, doc = np.nonzero(scores >= best.bound[:, None])
                best.add(item, scores[item, doc], numbers[doc].astype(np.int64))
        item, score, doc = best.trim()
        if len(item):
            yield pa.RecordBatch.from_arrays([pa.array(items_[item]), pa.array(doc), pa.array(score)], ["item_id", "doc_id", "score"])

    named = docs.filter("doc_id IS NOT NULL")
    return best_of_tasks(named.mapInArrow(run, "item_id long, doc_id long, score long"), ["item_id"], k, "score", "doc_id")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, *, doc_id: str = "doc_id", text: str = "text",
                   item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score: the ``k`` documents with the highest scores above 0 for each item, ties to the smaller id.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z in lower case.
    Null, empty and termless texts are found by no item and count in no statistic; so
    do items without terms, which find nothing.  Rows that repeat an item's id are one
    item with all their terms; rows that repeat a document's id are documents of their
    own.  Documents with a null id count in the statistics and are not ranked; items
    with a null id are left out.  Other columns are not read.  Items go in blocks of
    about BLOCK_TERMS terms in all, one block after the other; no rows for empty tables.
    """
    import pyarrow as pa
    spark = docs.sparkSession

    def split(batches: Iterator):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(set(terms_of(t))) for t in texts(batch.column(1))], pa.list_(pa.binary()))], ["item", "terms"])

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = settle(items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text")).filter("item IS NOT NULL")
                   .mapInArrow(split, "item long, terms array<binary>").select("item", F.explode("terms").alias("term")).distinct())
    blocks = -(-asked.count() // BLOCK_TERMS)

    def results() -> Iterator[DataFrame]:
        for b in range(blocks):
            held = defaultdict(list)
            for r in asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect():  # about BLOCK_TERMS rows
                held[r["item"]].append(bytes(r["term"]))
            if held:
                yield search_block(docs, sorted((i, sorted(t)) for i, t in held.items()), k)

    out = one_by_one(spark, results(), blocks > 1)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out.select("item_id", "rank", "doc_id", "score")
