from collections import Counter

from churnspark.llm.substrdedup import COVER, PERIOD, drop_repeats
from conftest import words


def brute(texts, window):
    tokens = [(t or "").split() for t in texts]
    n = Counter(tuple(w[i : i + window]) for w in tokens for i in range(len(w) - window + 1))
    out = []
    for w in tokens:
        gone = {j for i in range(len(w) - window + 1) if n[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def check(docs, window=35):
    rows = docs.select("doc_id", "text").collect()
    want = sorted((str(r["doc_id"]), *b) for r, b in zip(rows, brute([r["text"] for r in rows], window), strict=True))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["text"]) for r in drop_repeats(docs, window=window, keep_layout=False).collect())
    assert got == want


def test_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_edge_rows(spark, edge_docs):
    check(edge_docs)


def test_passages_at_every_alignment(spark):
    passage = words(1, 35)
    rows = [(i, words(10 + i, i) + " " + passage + " " + words(500 + i, 7)) for i in range(45)]
    rows += [(100, words(1, 34)), (101, words(900, 20) + " " + words(901, 34) + " " + words(902, 20)), (102, words(901, 34)),
             (103, words(5, 50) + " x " + words(5, 50)), (104, "same " * 200)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window=21)


def test_layout_extra_columns_and_empty_table(spark, no_docs):
    docs = spark.createDataFrame([(1, "a\n b", 9, 8), (2, None, 9, 8)], "doc_id long, text string, n_words int, row_key int")
    got = sorted((r["doc_id"], r["text"], r["n_words"], r["n_removed"], r["row_key"]) for r in drop_repeats(docs).collect())
    assert got == [(1, "a\n b", 2, 0, 8), (2, None, 0, 0, 8)]
    assert drop_repeats(no_docs).count() == 0
