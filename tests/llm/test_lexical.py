import math
import random
import re

import numpy as np
from churnspark.llm import lexical
from churnspark.llm.lexical import mine, rank_documents
from conftest import words

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    total = sum(len(t) for _, t in held)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        df = {t: sum(t in d for _, d in held) for t in wanted}
        scores = []
        for i, d in held:
            if i is None:
                continue
            m = 50 + 50 * len(d) * len(held) // total
            s = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * d.count(t) // (1000 * d.count(t) + 20 * m)) for t in wanted & set(d))
            if s > 0:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def check(docs, items, k):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()]
    got = rank_documents(docs, items, k).collect()
    assert sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == brute(*rows, k)


def some_items(spark):
    rows = [(i, words(i, 12)) for i in range(1, 12)] + [(20, words(1, 120)), (21, words(1, 60) + " Unheard-of é's"), (22, None), (23, ""), (24, "?! --"), (25, words(1, 12)), (None, words(1, 5)),
                                                          (26, "one"), (26, "two, ALPHA3"), (27, "spam")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_edge_rows(spark, edge_docs):
    check(edge_docs.repartition(4), some_items(spark), 5)


def test_ties_copies_and_blocks_of_items(spark, monkeypatch):
    rows = [(i, words(i % 7, 40)) for i in range(90)] + [(100 + i, words(1, 3)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(docs, some_items(spark), 10)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 60)
    monkeypatch.setattr(lexical, "PIECE", 5)
    monkeypatch.setattr(lexical, "CELLS", 500)
    check(docs, some_items(spark), 10)


def test_shared_sums(spark):
    r = random.Random(1)
    items = [r.sample(range(60), r.randrange(1, 25)) for _ in range(40)] + [[5], list(range(60)), list(range(60))]
    graph = mine(items, 60)
    adds = np.random.default_rng(0).integers(0, 100, (60, 7))
    sums = np.zeros((graph.nodes, 7), np.int64)
    sums[:60] = adds
    assert (graph.evaluate(sums) == np.stack([adds[i].sum(axis=0) for i in items])).all()
    work = graph.nodes - 60 + len(graph.roots) - len(items)  # additions
    assert work < 0.7 * sum(len(i) - 1 for i in items)


def test_empty_tables_and_clashing_columns(spark, edge_docs, no_docs):
    items = some_items(spark)
    assert rank_documents(no_docs, items).count() == 0
    assert rank_documents(edge_docs, items.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, "alpha beta", 5, 6, 7)], "doc_id long, text string, item_id long, rank int, score long")
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in rank_documents(docs, spark.createDataFrame([(3, "beta", 1)], "item_id long, text string, doc_id long")).collect()] == [(3, 1, 1)]
