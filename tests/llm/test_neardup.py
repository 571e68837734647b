import random

import pytest

from churnspark.llm import neardup
from churnspark.llm.neardup import components, near_duplicates
from conftest import words


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.filter("doc_id IS NOT NULL").collect()]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs.filter("doc_id IS NOT NULL")).collect()]
    assert sorted(got) == brute(rows)


def test_edge_rows(spark, edge_docs):
    check(edge_docs)
    alone = near_duplicates(edge_docs.filter("doc_id IS NULL")).collect()
    assert [(r["component_id"], r["kept"]) for r in alone] == [(None, True)] * 2


def test_large_groups_chains_and_neighbours_below_the_threshold(spark):
    r = random.Random(3)
    base = words(50, 90).split()
    rows = [(1000 + i, " ".join(base)) for i in range(40)]  # equal texts
    for i in range(150):  # near copies, some of them near to others only
        w = list(base)
        for _ in range(r.randrange(1, 5)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    chain = words(60, 100).split()
    for i in range(25):  # each linked to the one before
        chain = list(chain)
        chain[4 * i % 100] = f"c{i}"
        rows.append((300 + i, " ".join(chain)))
    rows += [(400 + i, words(70, 30) + " " + words(7000 + i, 45)) for i in range(90)]  # a shared passage, no links
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


@pytest.mark.parametrize("others", [0, 6, 512])
def test_blocks_of_large_nodes(spark, monkeypatch, others):
    monkeypatch.setattr(neardup, "OTHERS", max(others, 1))
    monkeypatch.setattr(neardup, "SMALL_NODE", 4)
    monkeypatch.setattr(neardup, "DEPTHS", (2,))  # the first depth is the last: every node is compared in blocks
    r = random.Random(5)
    base, rows = words(51, 90).split(), []
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(1, 5)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 150: 100, 200: 100}


def test_empty_table(spark, no_docs):
    assert near_duplicates(no_docs).count() == 0


def test_pairs_at_the_threshold_meet_and_others_die_out():
    import numpy as np
    r, n, trees = np.random.default_rng(1), 1500, neardup.trees_for(0.99, 75)
    width = trees * neardup.OWN
    shared = {}
    for j in (0.75, 0.5):
        a = r.integers(0, 2**32, (n, width)).astype("<u4")
        b = np.where(r.random((n, width)) < j, a, r.integers(0, 2**32, (n, width)).astype("<u4"))
        for depth in neardup.DEPTHS:
            met, nodes, common = np.zeros(n, bool), 0, 0
            for t in range(trees):
                (x, rx), (y, ry) = (neardup._down(np.full(n, neardup.roots(t)), np.arange(n), m, depth, 75) for m in (a, b))
                both = set(zip(rx.tolist(), x.tolist()))
                hit = [i for i, v in zip(ry.tolist(), y.tolist()) if (i, v) in both]
                met[hit] = True
                nodes, common = nodes + len(x) / n, common + len(hit) / n
            shared[j, depth] = met.mean(), common / trees
            assert nodes < 1.1 * trees * (4 / 3) ** depth
    assert shared[0.75, 3][0] > 0.995 and shared[0.75, 5][0] > 0.97
    assert 0.9 < shared[0.75, 3][1] < 1.1 and shared[0.5, 5][1] < 0.2  # nodes that a pair shares, in a tree
    assert neardup.gate(75, width) < 0.5 * width


def test_links_are_the_same_however_small_the_tiles(spark, monkeypatch):
    import numpy as np
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 40)
    data = [np.unique(np.concatenate([rng.choice(base, 36, replace=False), rng.integers(0, 2**62, int(rng.integers(0, 8)))])).astype("<u8") for _ in range(40)]
    owner = [min(i, 37) for i in range(40)]                     # id 37 has three sets
    sets = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in zip(owner, data)], "id long, set binary")
    sizes = spark.createDataFrame([(i, len(x)) for i, x in zip(owner, data)], "id long, n long")
    pairs = [(a, b) for a in range(38) for b in range(a + 1, 38)]
    rows = spark.createDataFrame([(c, c, a, b) for a, b in pairs for c in (a % 3, 7)], "cell long, weight long, a long, b long")

    def enough(x, y):
        both = len(np.intersect1d(x, y))
        return 100 * both >= 75 * (len(x) + len(y) - both)

    of = {i: [x for j, x in zip(owner, data) if j == i] for i in range(38)}
    want = sorted((a, b) for a, b in pairs if any(enough(x, y) for x in of[a] for y in of[b]))
    assert 0 < len(want) < len(pairs)
    met = neardup.once(rows)
    assert met.count() == len(pairs) and met.select("cell").distinct().count() == 1
    for size in (16 << 20, 2000, 100):
        monkeypatch.setattr(neardup, "TILE_BYTES", size)
        assert sorted(map(tuple, neardup.linked(met, sets, sizes, 75).collect())) == want


def test_pairs_of_a_large_group_below_the_threshold_are_left_out_unmade(spark, monkeypatch):
    r = random.Random(11)
    base, rows = words(52, 150).split(), []
    for i in range(400):  # near copies: a few linked, most of them below the threshold with all others
        w = list(base)
        for _ in range(r.randrange(1, 18)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    compared, linked = [], neardup.linked
    monkeypatch.setattr(neardup, "linked", lambda pairs, *rest: compared.append(pairs.count()) or linked(pairs, *rest))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert 0 < sum(compared) < 10 * len(rows)


def test_values_that_few_sets_hold(spark, monkeypatch):
    import numpy as np
    monkeypatch.setattr(neardup, "RARE", 2)
    data = [(1, [1, 2, 3, 4]), (2, [3, 4, 5]), (3, [9]), (4, [4, 10]), (4, [11, 12])]
    sets = spark.createDataFrame([(i, bytearray(np.array(x, "<i8").tobytes())) for i, x in data], "id long, set binary")
    rare, alone = neardup.rare_values(sets)
    assert sorted(tuple(r) for r in rare.collect()) == [(3, 1), (3, 2)]
    got = {r["id"]: (r["n"], r["found"], r["common"]) for r in neardup.shares(sets, rare, alone).collect()}
    assert got == {1: (4, 2, 1), 2: (3, 2, 1), 3: (1, 0, 0)}
