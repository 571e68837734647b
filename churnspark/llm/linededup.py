"""Line dedup with a once-seen and a twice-seen Bloom filter.

Every task sends the hashes of its documents' line keys to the filter segment that
owns them; a segment sets a key's bits in its once-seen filter, and in its
twice-seen filter when they were set before.  The twice-seen filter has a fixed
size and is sent to all tasks.  Only keys found in it are suspects: their digests
are shuffled and counted exactly.  A filter that is too full for the input makes
more suspects, never a wrong result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnspark.llm.bloom import FILTER_POWER, blocks, gather, prober, segment_count
from churnspark.llm.common import HEAVY_PARTS, SPACE, own_name, settle, texts

def line_keys(text: bytes | None) -> tuple[list[bytes], list[bytes]]:
    """Lines, and their keys: stripped of white space, A-Z in lower case."""
    lines = (text or b"").split(b"\n")
    return lines, [x.strip(SPACE).lower() for x in lines]


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _send(segments: int, least: int):
    """Map side: the hashes that a stretch of documents has seen; two events per key at most, however often it has it."""
    def out(parts: list[np.ndarray]):
        found, n = np.unique(np.concatenate(parts), return_counts=True)
        return blocks(np.concatenate([found, found[n > 1]]), segments)

    def run(batches: Iterator):
        parts, held = [], 0
        for batch in batches:
            for text in texts(batch.column(0)):
                keys = {k for k in line_keys(text)[1] if k and long_enough(k, least)}
                if keys:
                    parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)))
                    held += len(keys)
            if held >= 1_000_000:
                yield out(parts)
                parts, held = [], 0
        if parts:
            yield out(parts)

    return run


def _suspect_keys(keys: list[bytes], probe, least: int) -> dict[bytes, int]:
    """Suspected keys of a document, with the number of their first line."""
    first: dict[bytes, int] = {}
    for i, k in enumerate(keys):
        if k and k not in first and long_enough(k, least):
            first[k] = i
    if not first:
        return first
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, first), np.uint64, len(first))
    return {k: i for (k, i), hit in zip(first.items(), probe(hashes).tolist(), strict=True) if hit}


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_docs: int = 2,
                keep_first: bool = True, min_chars: int = 1, filter_power: int = FILTER_POWER) -> DataFrame:
    """Drop the lines whose key is found in ``min_docs`` documents or more.

    Returns every row of ``docs`` with all its columns, the text without the
    dropped lines, and n_lines, n_dropped (long; a column of that name is
    replaced).  ``keep_first`` leaves the key's first line in the document with the
    smallest id.  A null or empty text is one empty line, whose key is never
    dropped; a text that loses all its lines becomes empty.  A repeated row counts
    as a document of its own; rows with the same id lose the same keys.  With a
    null id a row counts, and its lines are dropped like any other's.
    ``filter_power``: each Bloom filter has 2 ** that many bits (27: 16 MiB).
    """
    import pyarrow as pa
    sc = docs.sparkSession.sparkContext
    segments = segment_count(filter_power)
    twice = sc.broadcast(gather(docs.select(text).mapInArrow(_send(segments, min_chars), "segment int, hashes binary"), True))

    def suspects(batches: Iterator):
        probe = prober(twice.value, segments)
        for batch in batches:
            ids, digests, firsts = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                for k, line in _suspect_keys(line_keys(t)[1], probe, min_chars).items():
                    ids.append(i)
                    digests.append(xxhash.xxh3_128_digest(k))
                    firsts.append(line)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array(digests, pa.binary()), pa.array(firsts, pa.int32())],
                ["id", "key", "line"])

    id_type = pa.int64()
    keyed = settle(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
                   .mapInArrow(suspects, "id long, key binary, line int"))
    counted = settle(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "line"))["id"].alias("first"))
                     .filter(F.col("n") >= min_docs))
    total = counted.agg(F.sum("n")).first()[0] or 0
    is_heavy = F.col("n") * HEAVY_PARTS >= F.lit(total)
    # at most HEAVY_PARTS digests: known to every task
    heavy = sc.broadcast({bytes(r["key"]): r["first"] for r in counted.filter(is_heavy).select("key", "first").collect()})
    drops = (keyed.join(counted.filter(~is_heavy).drop("n"), "key").groupBy("id")
             .agg(F.collect_list(F.struct("key", F.col("first").eqNullSafe(F.col("id")).alias("here"))).alias("drops")))

    gone = own_name(docs, "drops")
    has = own_name(docs, "has_suspect")
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*keep)
    text_at, id_at = keep.index(text), keep.index(doc_id)
    out_schema = T.StructType([*rows.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def clean(batch, extra: list | None):
        """Texts without the lines of heavy keys and of the keys in ``extra``."""
        new, n, dropped = [], [], []
        for j, (i, t) in enumerate(zip(batch.column(id_at).to_pylist(), texts(batch.column(text_at)), strict=True)):
            lines, keys = line_keys(t)
            light = {bytes(d["key"]): d["here"] for d in (extra[j] or ())} if extra is not None else {}
            seen, stay = set(), []
            for line, k in zip(lines, keys, strict=True):
                if k and (heavy.value or light) and long_enough(k, min_chars):
                    d = xxhash.xxh3_128_digest(k)
                    if d in heavy.value or d in light:
                        here = heavy.value[d] == i if d in heavy.value else light[d]
                        if not (keep_first and here and d not in seen):
                            continue
                        seen.add(d)
                stay.append(line)
            new.append(t if len(stay) == len(lines) else b"\n".join(stay))
            n.append(len(lines))
            dropped.append(len(lines) - len(stay))
        columns = [batch.column(c) for c in range(len(keep))]
        columns[text_at] = pa.array(new, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(dropped, pa.int64())],
                                          [*keep, "n_lines", "n_dropped"])

    def at_once(batches: Iterator):
        """Documents with no light suspect need nothing from the shuffle."""
        probe = prober(twice.value, segments)
        for batch in batches:
            mask = pa.array([not waits(t, probe) for t in texts(batch.column(text_at))], pa.bool_())
            yield clean(batch.filter(mask), None)

    def waiting(batches: Iterator):
        probe = prober(twice.value, segments)
        for batch in batches:
            yield batch.filter(pa.array([waits(t, probe) for t in texts(batch.column(text_at))], pa.bool_()))

    def waits(t: bytes | None, probe) -> bool:
        return any(xxhash.xxh3_128_digest(k) not in heavy.value for k in _suspect_keys(line_keys(t)[1], probe, min_chars))

    def after(batches: Iterator):
        for batch in batches:
            yield clean(batch, batch.column(len(keep)).to_pylist())

    first = rows.mapInArrow(at_once, out_schema)
    held = rows.mapInArrow(waiting, rows.schema).withColumn(has, F.col(doc_id).cast("long"))
    joined = held.join(drops.withColumnRenamed("drops", gone), F.col(has).eqNullSafe(F.col("id")), "left").select(*keep, gone)
    return first.unionByName(joined.mapInArrow(after, out_schema))
