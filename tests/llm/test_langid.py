from churnspark.llm.langid import identify
from churnspark.llm.queries import doc_fold, op2_language_id
from conftest import words
from pyspark.sql import functions as F


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) > 0
    sure = [r for r in held if r["accepted"]]
    assert sum(r["lang"] == r["lang_pred"] for r in sure) >= 0.97 * len(sure)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.createDataFrame([(i, words(i, 30) if i % 2 else f"der die das {i} und nicht " * 9, "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string")
    other = docs.withColumn("lang", F.when(doc_fold(5) == 0, "xx").otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, identify(d.select("doc_id", "text"), d.filter(doc_fold(5) != 0)).select("doc_id", "lang_pred", "score").collect())) for d in (docs, other))
    assert a == b


def test_texts_that_open_alike(spark):
    opening = "Copyright notice: free to copy under the terms of the public licence. " * 4
    german = "der die das und nicht ein eine ist wir sie haben werden auch nach bei einer um am sind noch wie".split()
    docs = spark.createDataFrame(
        [(i, opening + (" ".join(german[(i * 7 + j * j) % len(german)] for j in range(150)) if i % 3 == 0 else words(i, 150)), "de" if i % 3 == 0 else "en") for i in range(300)],
        "doc_id long, text string, lang string")
    held = identify(docs.filter("doc_id % 5 = 0"), docs.filter("doc_id % 5 <> 0")).collect()
    assert all(r["lang_pred"] == r["lang"] for r in held)


def test_edge_rows(spark, edge_docs, no_docs):
    rows = identify(edge_docs, edge_docs).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert letters or (r["score"], r["accepted"]) == (0.0, False)
    assert identify(no_docs, edge_docs).count() == 0
    assert {r["lang_pred"] for r in identify(edge_docs, no_docs).collect()} == {"und"}


def test_long_text_of_symbols_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "1 " * 5000 + "word", 7), (2, "1 " * 5000, 7)], "doc_id long, text string, score int")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(docs, docs.withColumn("lang", F.lit("en"))).collect()}
    assert got == {1: ("en", 1.0), 2: ("und", 0.0)}
