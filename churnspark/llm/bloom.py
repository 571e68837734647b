"""Bloom filters of a fixed size, built by segments.

A 64-bit hash belongs to a segment and sets two bits in it.  Tasks send hashes to
the segment's owner, which holds one segment's bits at a time, so neither building
nor merging needs the whole filter in one place.  The finished filter is collected
and broadcast: its size is a parameter and does not grow with the input.  A filter
too full for its keys only answers "maybe" more often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a segment (a power of two), as a power of two: 32 KiB.
SEGMENT_POWER = 18
#: Bits of a filter, as a power of two: 16 MiB.
FILTER_POWER = 27


def segment_count(filter_power: int) -> int:
    return 1 << max(0, filter_power - SEGMENT_POWER)


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    return (hashes >> np.uint64(2 * SEGMENT_POWER)) % np.uint64(segments)


def bit_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash inside its segment."""
    mask = np.uint64((1 << SEGMENT_POWER) - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(SEGMENT_POWER)) & mask).astype(np.int64)


def blocks(events: np.ndarray, segments: int):
    """An Arrow batch with a row (segment, hashes) for each segment that ``events`` touch."""
    import pyarrow as pa
    where = segment_of(events, segments)
    order = np.argsort(where, kind="stable")
    events, where = events[order], where[order]
    ids, starts = np.unique(where, return_index=True)
    parts = np.split(events, starts[1:]) if len(ids) else []
    return pa.RecordBatch.from_arrays(
        [pa.array(ids.astype(np.int32)), pa.array([p.astype("<u8").tobytes() for p in parts], pa.binary())], ["segment", "hashes"])


def fold(twice: bool):
    """From blocks sorted by segment: each segment's once-seen or twice-seen bits."""
    def run(batches: Iterator):
        import pyarrow as pa
        segment, once, again = None, None, None

        def rows():
            bits = again if twice else once
            if segment is not None and bits.any():
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["segment", "bits"])

        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != segment:
                    yield from rows()
                    segment, once, again = s, np.zeros(1 << SEGMENT_POWER, bool), np.zeros(1 << SEGMENT_POWER, bool)
                for places in bit_places(np.frombuffer(blob, "<u8")):
                    if twice:  # set by two events of this block, or now and by an earlier block
                        places, n = np.unique(places, return_counts=True)
                        again[places[n > 1]] = True
                        again[places[once[places]]] = True
                    once[places] = True
        yield from rows()

    return run


def gather(rows: DataFrame, twice: bool) -> dict[int, bytes]:
    """The filter by segment, from blocks; at most the filter's size reaches the driver."""
    folded = rows.repartition("segment").sortWithinPartitions("segment").mapInArrow(fold(twice), "segment int, bits binary")
    return {r["segment"]: bytes(r["bits"]) for r in folded.collect()}


def prober(filter_bits: dict[int, bytes], segments: int):
    """Tells which hashes may be in the filter."""
    row = np.full(segments, -1)
    table = np.zeros((len(filter_bits) + 1, 1 << SEGMENT_POWER >> 3), np.uint8)
    for i, (s, bits) in enumerate(filter_bits.items()):
        row[s], table[i] = i, np.frombuffer(bits, np.uint8)

    def probe(hashes: np.ndarray) -> np.ndarray:
        at = row[segment_of(hashes, segments).astype(np.int64)]  # -1 is the empty last row
        found = np.ones(len(hashes), bool)
        for places in bit_places(hashes):
            found &= (table[at, places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 == 1
        return found

    return probe


def split_by_keys(df: DataFrame, key: str, keys: DataFrame, filter_power: int = FILTER_POWER) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` may be in ``keys``, rows whose key is not), by a filter of ``keys``.

    Both columns are 64-bit hashes.  Only the first part then needs a join with
    what belongs to the keys, so the wide rows of the second are not shuffled.
    """
    import pyarrow as pa
    segments = segment_count(filter_power)

    def send(batches: Iterator):
        for batch in batches:
            if batch.num_rows:
                yield blocks(np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)), segments)

    bits = df.sparkSession.sparkContext.broadcast(gather(keys.select(key).filter(F.col(key).isNotNull()).mapInArrow(send, "segment int, hashes binary"), False))
    at = df.columns.index(key)

    def part(wanted: bool):
        def run(batches: Iterator):
            probe = prober(bits.value, segments)
            for batch in batches:
                hit = probe(batch.column(at).to_numpy(zero_copy_only=False).view(np.uint64))
                yield batch.filter(pa.array(hit == wanted))
        return run

    return df.mapInArrow(part(True), df.schema), df.mapInArrow(part(False), df.schema)

