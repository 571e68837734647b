import zlib
from collections import defaultdict

from churnspark.llm.sharding import shard
from conftest import words


def check(docs, shards):
    rows, out = docs.collect(), shard(docs, shards).collect()
    size = lambda t: len((t or "").encode()) + 16
    want = sorted((str(r["doc_id"]), size(r["text"]), zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == want
    slots, weight = defaultdict(list), dict.fromkeys(range(shards), 0)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        weight[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(weight) == set(range(shards))
    return out, weight, max(s for _, s, _ in want)


def test_edge_rows(spark, edge_docs):
    for shards in (1, 2, 7):
        check(edge_docs, shards)


def test_near_equal_bytes_with_a_hot_group(spark):
    rows = [(i, words(i, 10 + i % 90), "en" if i % 3 else "de") for i in range(3000)] + [(10000 + i, words(1, 50), "en") for i in range(1500)]
    out, weight, largest = check(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(9), 40)
    mean = sum(weight.values()) / 40
    assert max(weight.values()) - mean <= 3 * largest and mean - min(weight.values()) <= 3 * largest


def test_equal_texts_stay_together(spark):
    rows = [(i, words(i // 3, 40), "en") for i in range(3000)]
    out, _, _ = check(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 8)
    homes = defaultdict(set)
    for r in out:
        homes[r["text_crc32"]].add(r["shard"])
    assert sum(len(h) > 1 for h in homes.values()) <= 7  # a cut divides one group at most


def test_empty_table_and_other_columns(spark, no_docs):
    assert shard(no_docs, 5).count() == 0
    docs = spark.createDataFrame([(1, "a", None, 3, 4, 5)], "doc_id long, text string, lang string, node int, keys int, size int")
    assert shard(docs, 3).first()["size"] == 17
