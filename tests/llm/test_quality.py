import math
import re

from churnspark.llm import quality as Q
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)} if len(words) < 1000 else None
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), hit and len(hit) or 0


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_measures_of_edge_rows(spark, edge_docs):
    out = Q.apply_rules(edge_docs, labels(spark, [(0, 1, 0), (0, None, None), (None, 1, 1), (11, 0, 0)])).join(
        edge_docs.select(F.col("doc_id").alias("i"), "text").distinct(), F.col("doc_id").eqNullSafe(F.col("i")) & (F.xxhash64("doc_id", "text") == F.col("row_key")))
    rows = out.collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        want = brute(r["text"])
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        if r["doc_id"] == 12:
            want = (*want[:4], got[4])
        assert got == want, r["doc_id"]
        assert r["base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert r["kept"] == (not r["base_failed"])  # one good label certifies nothing


def test_binomial_tail(spark):
    cases = [(0, 5, 0.1), (3, 10, 0.3), (10, 10, 0.2), (7, 4000, 0.004), (0, 90000, 0.01), (850, 90000, 0.01)]
    for k, n, p in cases:
        got = spark.range(1).select(Q.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))
        assert abs(got - want) <= 1e-9 + 1e-7 * want


def test_steps_stop_at_the_first_that_fails(spark):
    # 2000 good documents; step 4 would reject 100 of them
    good = spark.createDataFrame([("en", 11)] * 1900 + [("en", 4)] * 100 + [(None, 11)] * 20, "stratum string, first int")
    strata = spark.createDataFrame([("en",), (None,), ("xx",)], "stratum string")
    got = {r["stratum"]: r["step"] for r in Q.choose_steps(good, strata, 3, "stratum", 0.01, 0.05).collect()}
    assert got == {"en": 3, None: 0, "xx": 0}


def test_learned_rules_reject_junk_and_keep_the_rest(spark):
    from conftest import words
    good = [(i, words(i, 60), "en") for i in range(900)]
    junk = [(1000 + i, " ".join(w + "###" for w in words(5000 + i, 60).split()), "en") for i in range(30)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string")
    out = Q.apply_rules(docs, labels(spark, [(i, 1, 0) for i, _, _ in good])).select("doc_id", "kept").collect()
    assert {r["doc_id"] for r in out if not r["kept"]} == {i for i, _, _ in junk}


def test_empty_table(spark, no_docs):
    assert Q.apply_rules(no_docs, labels(spark, [])).count() == 0


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b", "en", 5, 6)], "doc_id long, text string, lang string, measures int, line_counts int")
    r = Q.measured(docs).first()
    assert (r["measures"], r["line_counts"], r["n_words"]) == (5, 6, 2)
