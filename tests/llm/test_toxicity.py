import itertools
import random

import numpy as np
from churnspark.llm import toxicity as X
from conftest import WORDS


def test_token_bins_are_those_of_the_lexicon():
    lex = X.Lexicon({"poison": (9, 0), "4|pois": (20, 1), "6|poison": (9, 3), "5|mildl": (1, 30), "mild": (1, 30)}, 25, 40)
    words = ["poison", "poisonous", "poise", "pois", "4|pois", "(poison)", "mildly", "mild", "...", "", "other"]
    bins = X.TokenBins(lex)
    want = [lex.token(w)[0] for w in words]
    lex.token = None     # no word is looked up by its list of units
    assert [bins[w] for w in words] == want and len(set(want)) > 3


def test_odds_give_the_marginals_of_the_passes():
    r = np.random.default_rng(5)
    lines = [r.integers(0, 36, n) for n in (1, 700, 3, 0, 40, 40, 2)]
    for scale in (1, 15, 100):
        f = X.Field(scale * r.normal(size=36), scale * r.normal(size=(2, 2)))
        for a, b in zip(f.chances(lines), f.passes(lines)[0], strict=True):
            assert np.allclose(a, b, rtol=1e-9, atol=1e-12)
    assert f.chances([]) == []


def test_marginals_equal_enumeration():
    r = np.random.default_rng(0)
    f = X.Field(r.normal(size=36), r.normal(size=(2, 2)))
    lines = [r.integers(0, 36, n) for n in (1, 3, 6, 2)]
    got, moves = f.passes(lines)
    expected = np.zeros((2, 2))
    for x, p in zip(lines, got, strict=True):
        weights, ones = 0.0, np.zeros(len(x))
        counts = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=len(x)):
            w = np.exp(sum(f.theta[a] for a, s in zip(x, y, strict=True) if s) + sum(f.move[y[i], y[i + 1]] for i in range(len(y) - 1)))
            weights += w
            ones += w * np.array(y)
            for i in range(len(y) - 1):
                counts[y[i], y[i + 1]] += w
        assert np.allclose(p, ones / weights)
        expected += counts / weights
    assert np.allclose(moves, expected)
    assert all(np.allclose(a, b) for a, b in zip(f.marginals(lines), got, strict=True))


def test_fit_raises_the_likelihood_of_its_tags():
    r = np.random.default_rng(1)
    lines = [r.integers(0, 4, 30) for _ in range(40)]
    tags = [(x == 3).astype(np.int64) for x in lines]
    p = np.concatenate(X.fit_field(lines, tags).passes(lines)[0])
    y = np.concatenate(tags)
    assert p[y == 1].min() > 0.7 and p[y == 0].max() < 0.3


def corpus(n=500):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(WORDS) + str(r.randrange(300)) for _ in range(r.randrange(20, 90))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(r.randrange(1, 4)):
                w.insert(r.randrange(len(w)), "vile" + r.choice("abcdefghijkl") + r.choice("xyz"))
        rows.append((i, "\n".join(" ".join(w[j : j + 25]) for j in range(0, len(w), 25))))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_documents_and_their_spans(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame([x for x in labels if x[0] % 4 != 2], "doc_id long, quality int, toxic int")
    out = X.score(docs, X.fit(docs, marked)).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r["doc_id"] % 4 == 2]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        for s in r["spans"]:
            assert "vile" in r["text"][s["start"] : s["end"]]


def test_texts_that_open_alike_all_count(spark):
    rows, labels = corpus()
    opening = "this text is free to copy under the terms of the licence below\n"
    docs = spark.createDataFrame([(i, opening + t) for i, t in rows], "doc_id long, text string")
    marked = spark.createDataFrame([x for x in labels if x[0] % 4 != 2], "doc_id long, quality int, toxic int")
    model = X.fit(docs, marked)
    assert (model.lexicon.toxic, model.lexicon.clean) == (sum(t for i, _, t in labels if i % 4 != 2), sum(1 - t for i, _, t in labels if i % 4 != 2))
    truth = {i: t for i, _, t in labels}
    held = X.score(docs.filter("doc_id % 4 = 2"), model).collect()
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_copies_and_near_copies_count_once(spark):
    rows, labels = corpus(120)
    long = " ".join(f"w{i}" for i in range(200))
    for i in range(12):  # four copies, four in capitals, four with another word in the middle
        rows.append((1000 + i, long if i < 4 else long.upper() if i < 8 else long.replace("w100 ", f"other{i} ")))
        labels.append((1000 + i, 1, 1))
    model = X.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.lexicon.toxic == 21 and "w5" not in model.lexicon.counts


def test_edge_rows_missing_labels_and_empty_table(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, None, None), (None, 1, 1), (9, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    model = X.fit(edge_docs, labels)
    out = X.score(edge_docs, model).collect()
    assert len(out) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in out)
    empty = {r["score"] for r in out if not (r["text"] or "").strip()}
    assert len(empty) == 1 and all(r["spans"] == [] for r in out if not r["text"])
    assert X.score(no_docs, model).count() == 0
    nothing = X.fit(no_docs, labels.limit(0))
    assert {r["score"] for r in X.score(edge_docs, nothing).collect()} == {0.5}


def test_offsets_count_code_points_and_clashing_names(spark):
    model = X.Model(X.Lexicon({"vile": (50, 0)}, 60, 600), np.where(np.arange(36) >= 6, 9.0, -9.0), np.zeros((2, 2)), np.array([0.0, 1.0, 1.0]))
    text = "\U0001f600 é fine\nso VILE, über vile"
    r = X.score(spark.createDataFrame([(1, text, "mine")], "doc_id long, text string, spans string"), model).first()
    assert [text[s["start"] : s["end"]] for s in r["spans"]] == ["VILE,", "vile"]
