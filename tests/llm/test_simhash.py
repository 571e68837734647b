import random

import pytest
import xxhash
from churnspark.llm import simhash
from churnspark.llm.simhash import block_masks, near_duplicates
from conftest import words


def fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    """Over rows, those that share an id being one document."""
    prints = [(i, fingerprint(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(prints):
        for j, y in prints[a + 1 :]:
            if (x ^ y).bit_count() <= 4:
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return sorted((i, f"{x:016x}", find(i)) for i, x in prints)


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.filter("doc_id IS NOT NULL").collect()]
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in near_duplicates(docs).filter("doc_id IS NOT NULL").collect()]
    assert sorted(got) == brute(rows)


def varied(n, seed=3):
    """Near copies of one text (some near to others only), equal texts, and texts of their own."""
    r = random.Random(seed)
    base = words(50, 150).split()
    rows = [(1000 + i, " ".join(base)) for i in range(30)]
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(1, 6)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows + [(2000 + i, words(300 + i, 30)) for i in range(60)]


def test_edge_rows(edge_docs):
    check(edge_docs)
    alone = near_duplicates(edge_docs).filter("doc_id IS NULL").collect()
    assert [(r["class_id"], r["component_id"]) for r in alone] == [(None, None)] * 2


def test_near_copies(spark):
    check(spark.createDataFrame(varied(200), "doc_id long, text string").repartition(5))


@pytest.mark.parametrize("large", [4, 12])
def test_cells_too_large_for_a_task(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    check(spark.createDataFrame(varied(120, 4), "doc_id long, text string").repartition(3))


def test_a_repeated_id_is_one_document(spark):
    rows = [(5, words(1, 80)), (3, words(1, 80)), (5, words(2, 80)), (9, words(2, 80)), (7, words(3, 80))]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_pigeonholes_leave_no_close_pair_apart():
    r = random.Random(1)
    for parts in (6, 7, 8):
        masks = block_masks((1 << 64) - 1, parts, 4)
        for _ in range(300):
            x = r.getrandbits(64)
            y = x
            for b in r.sample(range(64), 4):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)
            m = next(m for m in masks if x & m == y & m)
            assert any(x & s == y & s for s in block_masks(~m & ((1 << 64) - 1), 6, 4))


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 100)
    t = words(9, 3000)
    assert simhash.fingerprint(t.encode()) == fingerprint(t)


def test_clashing_columns_and_empty_table(spark, no_docs):
    assert near_duplicates(no_docs).count() == 0
    docs = spark.createDataFrame([(1, words(1, 30), 7, 8, 9, 1, 2), (2, words(1, 30), 7, 8, 9, 1, 2)],
                                 "doc_id long, text string, id long, fp long, component long, n_docs long, t long")
    assert sorted((r["doc_id"], r["component_id"]) for r in near_duplicates(docs).collect()) == [(1, 1), (2, 1)]
