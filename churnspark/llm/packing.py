"""Packing documents into sequences by cutting-stock column generation.

Documents longer than a sequence give full pieces and one remainder.  Remainders
are counted by length, in steps of ``grain`` tokens; this histogram has at most
capacity / grain entries, whatever the input, and a linear program over cutting
patterns is solved on it: the columns (patterns) are priced by a knapsack dynamic
program.  Patterns are rounded down, what is left is placed first-fit decreasing,
and the pieces, ranked within their length step by Spark, take the slots.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnspark.llm.common import rank_within, settle, texts

#: Buckets of the ranking within one length step.
RANK_BITS = 10


class TokenBytes(dict):
    """Ids of a white-space separated word as little-endian unsigned 32-bit bytes, remembered.

    The vocabulary drops white space, so a text's ids are those of its words in
    order.  A run of Latin letters is one word of the vocabulary's model once it
    is in lower case; any other word goes through the whole tokenizer.  At most
    twice ``limit`` words are remembered: at ``limit``, those of the time before go.
    """

    def __init__(self, tokenizer_file: str, limit: int = 400_000):
        super().__init__()
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.limit, self.before = limit, {}
        self.spelled = byte_letters()
        kinds = [x["type"] for x in json.loads(self.tokenizer.to_str())["normalizer"]["normalizers"]]
        self.plain = kinds == ["NFC", "Replace", "Lowercase"]

    def __missing__(self, word: bytes) -> bytes:
        out = self.before.get(word)
        if out is None:
            out = self.ids_of(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.before = dict(self)
                self.clear()
            self[word] = out
        return out

    def ids_of(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.plain and text.isalpha() and max(text) < "\u0250" and "\u0130" not in text:
            low = text.lower()
            if low != text:
                return self[low.encode()]
            ids = [t.id for t in self.tokenizer.model.tokenize(word.decode("latin-1").translate(self.spelled))]
        elif len(word) > 1 and word[-1:] in b".," and (core := text[:-1]).isalpha() and max(core) < "\u0250":
            return self[word[:-1]] + self[word[-1:]]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()


def byte_letters() -> dict[int, int]:
    """How byte-level vocabularies spell a byte: printable Latin-1 as itself, the others from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 0x100 + i for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def token_bytes(tokenizer_file: str) -> TokenBytes:
    """One for each Python worker, kept between its tasks."""
    return TokenBytes(tokenizer_file)


def pieces_of(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int, doc_id: str, text: str) -> DataFrame:
    """One row per piece: full pieces, then the remainder."""
    import pyarrow as pa
    end = np.asarray([end_id], "<u4").tobytes()
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]

    def run(batches: Iterator):
        words = token_bytes(tokenizer_file)
        for batch in batches:
            rows: list[list] = [[] for _ in fields]
            for i, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = b"".join([*map(words.__getitem__, (t or b"").split()), end])
                view, total = memoryview(ids), len(ids) // 4
                for start in range(0, total, capacity):
                    part = view[4 * start : 4 * (start + capacity)]
                    for column, value in zip(rows, (i, start, len(part) // 4, zlib.crc32(part), total), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(rows, fields, strict=True)], [n for n, _ in fields])

    return (docs.select(F.col(doc_id).cast("long"), F.col(text))
            .mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"))


def best_pattern(values: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """Knapsack: how many of each size 1..units, filling at most ``units``, have the largest total value."""
    best, last = np.zeros(units + 1), np.zeros(units + 1, int)
    for room in range(1, units + 1):
        gain = values[:room] + best[room - 1 :: -1][:room]  # size s = 1..room, then best[room - s]
        s = int(np.argmax(gain))
        if gain[s] > best[room - 1]:
            best[room], last[room] = gain[s], s + 1
        else:
            best[room], last[room] = best[room - 1], 0
    pattern, room = np.zeros(units, int), units
    while room > 0:
        if last[room]:
            pattern[last[room] - 1] += 1
            room -= last[room]
        else:
            room -= 1
    return float(best[units]), pattern


def solve_patterns(demand: np.ndarray, max_rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Column generation: patterns (rows) and their amounts in the linear program's optimum.

    ``demand[s - 1]`` pieces of size s; a pattern's sizes sum to len(demand) at most.
    Stops when no pattern's reduced cost is below -1e-9, or after ``max_rounds``
    columns, when the patterns at hand still meet the demand.
    """
    units = len(demand)
    sizes = np.flatnonzero(demand) + 1
    if not len(sizes):
        return np.zeros((0, units), int), np.zeros(0)
    m = len(sizes)
    patterns = np.zeros((m, units), int)
    patterns[np.arange(m), sizes - 1] = units // sizes
    basis = patterns[:, sizes - 1].T.astype(float)  # a column for each pattern
    inverse, need = np.linalg.inv(basis), demand[sizes - 1].astype(float)
    for round_ in range(max_rounds):
        if round_ % 50 == 49:
            inverse = np.linalg.inv(patterns[:, sizes - 1].T.astype(float))
        prices = np.zeros(units)
        prices[sizes - 1] = np.maximum(inverse.sum(axis=0), 0)
        value, pattern = best_pattern(prices, units)
        if value <= 1 + 1e-9:
            break
        pattern = np.where(demand > 0, pattern, 0)
        step, amounts = inverse @ pattern[sizes - 1], inverse @ need
        able = step > 1e-9
        ratio = np.where(able, np.maximum(amounts, 0) / np.where(able, step, 1), np.inf)
        out = int(np.argmin(ratio))
        patterns[out] = pattern
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    inverse = np.linalg.inv(patterns[:, sizes - 1].T.astype(float))
    return patterns, np.maximum(inverse @ need, 0)


def integer_plan(demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that hold the demand exactly: rounded-down patterns, then first-fit decreasing for the rest."""
    units = len(demand)
    patterns, amounts = solve_patterns(demand)
    left, plan = demand.copy(), []
    for pattern, amount in zip(patterns, amounts, strict=True):
        times = int(amount + 1e-6)
        used = pattern > 0
        if times and used.any():
            times = min(times, int((left[used] // pattern[used]).min()))
        if times > 0 and used.any():
            plan.append((pattern.copy(), times))
            left = left - times * pattern
    while left.any():  # one pattern for as many times as it fits: the rest is less than a piece of each size and pattern
        pattern, room = np.zeros(units, int), units
        for s in np.flatnonzero(left)[::-1] + 1:
            n = min(room // s, int(left[s - 1]))
            pattern[s - 1] += n
            room -= n * s
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        plan.append((pattern, times))
        left = left - times * pattern
    return plan


def slot_table(plan: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first rank, next rank, pieces of this size in a sequence, first sequence, place of the size) for each pattern and size."""
    rows, seen, sequence = [], {}, 0
    for pattern, times in plan:
        place = 0
        for s in np.flatnonzero(pattern)[::-1] + 1:  # large pieces first
            n = int(pattern[s - 1])
            rank = seen.get(int(s), 0)
            rows.append((int(s), rank, rank + n * times, n, sequence, place))
            seen[int(s)] = rank + n * times
            place += n
        sequence += times
    return rows


def pack(docs: DataFrame, tokenizer_file: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 2,
         capacity: int = 4096, grain: int = 16) -> DataFrame:
    """Pack every document's ids, ended by ``end_id``, into sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (all long).  A null or empty text is its end id alone.
    Repeated rows are packed each; rows with a null id too, with that null id.
    Other columns are not read.  ``capacity`` must be a multiple of ``grain``.
    """
    if capacity % grain:
        raise ValueError("capacity must be a multiple of grain")
    spark = docs.sparkSession
    units = capacity // grain
    size = F.ceil(F.col("length") / F.lit(grain)).cast("int")
    pieces = settle(pieces_of(docs, tokenizer_file, end_id, capacity, doc_id, text).withColumn("size", size))
    demand = np.zeros(units, np.int64)
    for r in pieces.groupBy("size").count().collect():  # `units` rows at most
        demand[r["size"] - 1] = r["count"]
    slots = slot_table(integer_plan(demand))
    schema = "size int, rank_from long, rank_to long, per_sequence long, first_sequence long, place long"
    table = spark.createDataFrame(slots, schema)

    mixed = F.xxhash64("doc_id", "start")
    ranked = rank_within(pieces, "size", F.shiftrightunsigned(mixed, 64 - RANK_BITS),
                         [mixed, F.col("doc_id"), F.col("start"), F.col("ids_crc32")], "rank")
    # the slots: as many as the patterns have sizes, which the histogram's size bounds
    q = F.col("rank") - F.col("rank_from")
    placed = (ranked.join(F.broadcast(table), (ranked["size"] == table["size"]) & F.col("rank").between(F.col("rank_from"), F.col("rank_to") - 1))
              .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                      (F.col("first_sequence") + F.floor(q / F.col("per_sequence"))).alias("sequence_id"),
                      (F.col("place") + q % F.col("per_sequence")).alias("slot")))
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
