import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from churnspark.llm.packing import TokenBytes, integer_plan, pack, solve_patterns
from conftest import words
from tokenizers import Tokenizer

FILE = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return [*Tokenizer.from_file(FILE).encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, out, capacity, ids=None):
    """Every id in exactly one piece, pieces as described, sequences within capacity and gapless; returns padding."""
    ids = ids or [(i, ids_of(t)) for i, t in rows]
    want = sorted((str(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    have = sorted({(str(i), len(x)) for i, x in ids})
    assert sorted((str(i), n) for i, n in by_doc) == have
    pieces = sorted((str(i), a, min(capacity, len(x) - a), zlib.crc32(np.array(x[a : a + capacity], "<u4").tobytes())) for i, x in ids for a in range(0, len(x), capacity))
    assert sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"]) for r in out) == pieces and len(want) == len(ids)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return 1 - sum(len(x) for _, x in ids) / (capacity * len(by_seq))


def test_edge_rows(spark, edge_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    check(rows, pack(edge_docs, FILE).collect(), 4096)
    check(rows, pack(edge_docs, FILE, capacity=256).collect(), 256)


def test_little_padding(spark):
    rows = [(i, words(i, 20 + (i * 37) % 400)) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    ids = [(i, [*TokenBytes(FILE).tokenizer.encode(t, add_special_tokens=False).ids, 2]) for i, t in rows]
    assert check(rows, pack(docs, FILE).collect(), 4096, ids) < 0.02


def test_words_one_by_one_are_the_whole_text():
    w = TokenBytes(FILE, limit=20)
    for text in ("Don't STOP, it's 12ab: ÉTÉ été İx Σς", "a<|endoftext|>b <|startoftext|> x", "a b c ## &&&x.. word, word. 'll", words(1, 200)):
        got = np.frombuffer(b"".join(map(w.__getitem__, text.encode().split())), "<u4").tolist()
        assert got == ids_of(text)[:-1]


def test_plan_meets_the_demand():
    for seed in range(4):
        r = np.random.default_rng(seed)
        demand = r.integers(0, 400, 64) * (r.random(64) < 0.6)
        plan = integer_plan(demand)
        assert (sum(times * pattern for pattern, times in plan) == demand).all()
        assert all((pattern * np.arange(1, 65)).sum() <= 64 for pattern, _ in plan)
        bound = solve_patterns(demand)[1].sum()
        assert sum(times for _, times in plan) <= 1.02 * bound + 8
    assert integer_plan(np.zeros(8, int)) == []


def test_empty_table_and_other_columns(spark, no_docs):
    assert pack(no_docs, FILE).count() == 0
    docs = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, size int, slot string")
    assert pack(docs, FILE).first()["doc_tokens"] == 3
