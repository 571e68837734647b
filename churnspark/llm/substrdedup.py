"""Removal of passages that repeat, found by difference-cover anchors.

Positions are taken modulo PERIOD; COVER is a difference cover of it: for any two
positions p and q there is a shift below PERIOD that moves both onto the cover.  So
two equal windows of ``window`` words share an aligned anchor, window - PERIOD + 1
words long, that starts at a cover position in both.  Anchors are hashed at cover
positions only and matched across all documents.  Around every anchor that repeats
the match is extended: the full windows that contain it are hashed and matched, and
the words of those that occur more than once go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnspark.llm.bloom import split_by_keys
from churnspark.llm.common import WordHashes, own_name, row_key, settle, texts

#: A perfect difference set: every residue modulo 21 is a difference of two of its members.
PERIOD, COVER = 21, (0, 1, 6, 8, 18)
#: Odd multipliers, from a fixed seed: two for each word of a window, so that a window has two independent hashes.
MOST_WINDOW = 512
_FACTORS = np.random.default_rng(20240913).integers(0, 2**63, (2, MOST_WINDOW), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def slices(batches: Iterator, rows: int = 1000) -> Iterator:
    """Smaller batches: what a task holds follows these, not Arrow's."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def word_rows(column, words: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after the other, and each text's number of words."""
    parts = []
    for t in texts(column):
        tokens = (t or b"").split()
        parts.append(np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens)))
    return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def window_hash(x: np.ndarray, starts: np.ndarray, length: int, which: int) -> np.ndarray:
    h = np.zeros(len(starts), np.uint64)
    for j in range(length):
        h += x[starts + j] * _FACTORS[which, j]
    h = (h ^ (h >> np.uint64(32))) * _FACTORS[which, 0]
    return h ^ (h >> np.uint64(29))


def positions(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every word of the batch its text's number and its place in that text; and where texts start."""
    first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(int(lengths.sum())) - first[owner], first


# A match row (h, k, v): the hash h was seen in text k; v holds the hash's other 31 bits c and the place p, as c << 32 | p.
# Within its stretch of texts a task knows already which hashes repeat: of these it sends one notice (p = NOTICE) to
# the hash's owner, however often they occur, and the runs of places go along under a hash of their own, with
# v = -1 - (first place << 31 | length).
MATCH, NOTICE = "h long, k long, v long", (1 << 32) - 1


def match_batch(h: np.ndarray, c: np.ndarray, k: np.ndarray, p: np.ndarray):
    import pyarrow as pa
    order = np.lexsort((c, h))
    same = (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])
    known = np.zeros(len(h), bool)
    known[order[1:][same]] = True
    known[order[:-1][same]] = True
    opens = np.concatenate([[True], ~same]) if len(h) else np.zeros(0, bool)
    notice = order[opens]
    notice = notice[known[notice]]
    single = np.flatnonzero(~known)
    # runs of known places in one text; copies of a text have the same runs
    sure = np.flatnonzero(known)
    run = np.concatenate([[True], (k[sure][1:] != k[sure][:-1]) | (p[sure][1:] != p[sure][:-1] + 1)]) if len(sure) else np.zeros(0, bool)
    lo = sure[run]
    size = np.diff(np.concatenate([np.flatnonzero(run), [len(sure)]]))
    runs = np.unique(np.stack([k[lo], -1 - ((p[lo] << 31) | size)], 1), axis=0)
    own = (runs[:, 0].astype(np.uint64) * _FACTORS[0, 1]) ^ (runs[:, 1].astype(np.uint64) * _FACTORS[0, 2])
    columns = [
        np.concatenate([h[single].view(np.int64), h[notice].view(np.int64), own.view(np.int64)]),
        np.concatenate([k[single], np.zeros(len(notice), np.int64), runs[:, 0]]),
        np.concatenate([(c[single] << 32) | p[single], (c[notice] << 32) | NOTICE, runs[:, 1]]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h", "k", "v"])


def repeated(matches: DataFrame, reach: int) -> DataFrame:
    """(k, runs): the places whose hash occurs more than once, as merged runs p..q for each text.

    A run starts up to ``reach`` places before the place that was found.  After the
    tasks' own matching a hash has one row per task at most, so its group is small.
    """
    import pyarrow as pa
    c = F.when(F.col("v") < 0, F.lit(-1)).otherwise(F.shiftright("v", 32))
    n = F.count(F.lit(1)).over(Window.partitionBy("h", "c"))
    found = (matches.repartition("h").withColumn("c", c).withColumn("n", n)
             .filter((F.col("v") < 0) | ((F.col("n") > 1) & (F.col("v").bitwiseAND(NOTICE) != NOTICE)))
             .select("k", F.when(F.col("v") < 0, F.col("v")).otherwise(F.col("v").bitwiseAND(NOTICE)).alias("v")))

    def merge(batches: Iterator):
        """Rows come sorted by text: one text's places are held at a time."""
        held: list = []

        def row(k, parts):
            v = np.concatenate(parts)
            far = -1 - v
            p, q = np.where(v < 0, far >> 31, v), np.where(v < 0, (far >> 31) + (far & ((1 << 31) - 1)) - 1, v)
            order = np.argsort(p)
            p, q = np.maximum(p[order] - reach, 0), np.maximum.accumulate(q[order])
            new = np.concatenate([[True], p[1:] > q[:-1] + 1])
            last = np.concatenate([new[1:], [True]])
            return k, p[new].tolist(), q[last].tolist()

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                                               pa.array([r[2] for r in rows], pa.list_(pa.int32()))], ["k", "p", "q"])

        for batch in batches:
            k, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(k):
                continue
            cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
            done = []
            for part_k, part in zip(k[np.concatenate([[0], cuts])].tolist(), np.split(v, cuts), strict=True):
                if held and held[0] != part_k:
                    done.append(row(held[0], held[1]))
                    held = []
                held = held or [part_k, []]
                held[1].append(part)
            if done:
                yield out(done)
        if held:
            yield out([row(held[0], held[1])])

    merged = found.repartition("k").sortWithinPartitions("k").mapInArrow(merge, "k long, p array<int>, q array<int>")
    return merged.select("k", F.arrays_zip("p", "q").alias("runs"))


def marks(runs, size: int) -> np.ndarray:
    """Which of 0..size - 1 lie in a run."""
    step = np.zeros(size + 1, np.int64)
    for r in runs:
        step[r["p"]] += 1
        step[r["q"] + 1] -= 1
    return np.cumsum(step[:-1]) > 0


def drop_repeats(docs: DataFrame, *, text: str = "text", window: int = 35, keep_layout: bool = True) -> DataFrame:
    """Remove every word covered by a ``window``-word passage that also starts anywhere else.

    Returns every row and column of ``docs`` with the text's kept words joined by one
    space, n_words and n_removed (long; columns of these names are replaced).  With
    ``keep_layout`` a text that loses nothing stays as it is.  Passages are judged on
    the input, a second one in the same text included, so all copies go.  A null or
    empty text has no words (and becomes empty unless ``keep_layout``); texts of
    fewer than ``window`` words lose nothing.  Rows with the same text repeat each
    other, whatever their ids.  Windows are compared by a 95-bit hash.
    """
    import pyarrow as pa
    if not PERIOD <= window <= MOST_WINDOW:
        raise ValueError(f"window must lie between {PERIOD} and {MOST_WINDOW}")
    anchor = window - PERIOD + 1
    on_cover = np.isin(np.arange(PERIOD), COVER)

    def anchors(batches: Iterator):
        words = WordHashes(200_000)
        for batch in slices(batches):
            x, lengths = word_rows(batch.column(1), words)
            owner, place, _ = positions(lengths)
            starts = np.flatnonzero(on_cover[place % PERIOD] & (place + anchor <= lengths[owner]) & (lengths[owner] >= window))
            key = batch.column(0).to_numpy()
            h = window_hash(x, starts, anchor, 0)
            yield match_batch(h, np.zeros(len(h), np.int64), key[owner[starts]], place[starts])

    def windows(batches: Iterator):
        words = WordHashes(200_000)
        for batch in slices(batches):
            x, lengths = word_rows(batch.column(1), words)
            owner, place, first = positions(lengths)
            key, near = batch.column(0).to_numpy(), np.zeros(len(x) + 1, np.int64)
            for i, runs in enumerate(batch.column(2).to_pylist()):
                last = lengths[i] - window
                for r in runs:  # windows that hold a repeated anchor
                    lo, hi = r["p"], min(last, r["q"])
                    if lo <= hi:
                        near[first[i] + lo] += 1
                        near[first[i] + hi + 1] -= 1
            starts = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            c = (window_hash(x, starts, window, 1) >> np.uint64(33)).astype(np.int64)
            yield match_batch(window_hash(x, starts, window, 0), c, key[owner[starts]], place[starts])

    k, names = own_name(docs, "row_key"), ("n_words", "n_removed")
    keep = [c for c in docs.columns if c not in names]
    # equal texts have equal passages, so they share a key, and lie side by side after a join on it
    rows = docs.select(*keep).withColumn(k, row_key(F.col(text)))
    narrow = rows.select(F.col(k).alias("k"), F.col(text).alias("text"))
    seeds = settle(repeated(narrow.mapInArrow(anchors, MATCH), PERIOD - 1))
    may, _ = split_by_keys(narrow, "k", seeds)
    suspects = may.join(seeds, "k").select("k", "text", "runs")
    gone = settle(repeated(suspects.mapInArrow(windows, MATCH), 0))
    touched, untouched = split_by_keys(rows, k, gone.withColumnRenamed("k", k))

    at = keep.index(text)
    schema = T.StructType([*docs.select(*keep).schema.fields, *[T.StructField(n, T.LongType()) for n in names]])

    def apply(batches: Iterator):
        for batch in batches:
            new, total, removed = [], [], []
            lists = batch.column(len(keep)).to_pylist() if batch.num_columns > len(keep) else [None] * batch.num_rows
            for t, runs in zip(texts(batch.column(at)), lists, strict=True):
                tokens = (t or b"").split()
                total.append(len(tokens))
                if runs:
                    covered = marks([{"p": r["p"], "q": r["q"] + window - 1} for r in runs], len(tokens))
                    tokens = [w for w, c in zip(tokens, covered.tolist(), strict=True) if not c]
                removed.append(total[-1] - len(tokens))
                new.append(t if keep_layout and not removed[-1] else b" ".join(tokens))
            columns = [batch.column(c) for c in range(len(keep))]
            columns[at] = pa.array(new, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], [*keep, *names])

    joined = touched.join(gone.withColumnRenamed("k", k), k, "left").select(*keep, "runs")
    return joined.mapInArrow(apply, schema).unionByName(untouched.select(*keep).mapInArrow(apply, schema))
