from collections import Counter

from churnspark.llm.linededup import dedup_lines

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_docs, keep_first):
    keys = [[key(x) for x in (t or "").split("\n")] for _, t in rows]
    n = Counter(k for ks in keys for k in set(ks) if k)
    home = {}
    for (i, _), ks in zip(rows, keys, strict=True):
        for k in set(ks):
            home[k] = min(home.get(k, i), i)
    out = []
    for (i, t), ks in zip(rows, keys, strict=True):
        stay, seen = [], set()
        for line, k in zip((t or "").split("\n"), ks, strict=True):
            if k and n[k] >= min_docs and not (keep_first and home[k] == i and k not in seen):
                continue
            seen.add(k)
            stay.append(line)
        out.append((i, None if t is None else "\n".join(stay), len(ks), len(ks) - len(stay)))
    return out


def compare(spark, docs, min_docs, keep_first, **how):
    rows = [(r["doc_id"], r["text"]) for r in docs.filter("doc_id IS NOT NULL").collect()]
    got = dedup_lines(docs.filter("doc_id IS NOT NULL"), min_docs=min_docs, keep_first=keep_first, **how)
    have = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()]
    assert sorted(have, key=str) == sorted(brute(rows, min_docs, keep_first), key=str)


def test_against_brute_force(spark, edge_docs):
    for min_docs, keep_first in ((10, False), (2, True), (2, False)):
        compare(spark, edge_docs, min_docs, keep_first)


def test_full_filter_changes_nothing(spark, edge_docs):
    compare(spark, edge_docs, 2, False, filter_power=18)


def test_light_and_heavy_keys(spark):
    # 6000 keys found twice each and one in all documents: the first are too many to be heavy
    rows = [(i, f"everywhere\nline {i // 2}\nown {i}") for i in range(12000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs, min_docs=2, keep_first=True).collect()}
    want = {i: "\n".join(([x] if i == 0 else []) + ([f"line {i // 2}"] if i % 2 == 0 else []) + [f"own {i}"]) for i, _ in rows for x in ["everywhere"]}
    assert got == want


def test_null_ids_extra_columns_and_empty_table(spark, edge_docs, no_docs):
    docs = spark.createDataFrame([(None, "x\ny", 1, "a"), (None, "x\nz", 2, "b"), (3, "X ", 3, "c")], "doc_id long, text string, n_lines int, drops string")
    got = sorted((r["text"], r["n_lines"], r["n_dropped"], r["drops"]) for r in dedup_lines(docs, min_docs=3, keep_first=False).collect())
    assert got == [("", 1, 1, "c"), ("y", 2, 1, "a"), ("z", 2, 1, "b")]
    assert dedup_lines(no_docs).count() == 0
