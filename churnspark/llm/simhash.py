"""SimHash near-duplicates by pigeonhole blocks.

A document's fingerprint has the majority bits of its shingles' hashes.  Equal
fingerprints are one class from the start.  The 64 bits are cut into P blocks: two
fingerprints that differ in D bits or fewer agree on P - D blocks at least, so for
each choice of P - D blocks fingerprints are brought together by their bits there, and
those that share such a cell are compared by Hamming distance.

A cell gives a star for each group that it joins, not all pairs.  A cell too large for
one task first links its members to one of them; if it still holds several components,
the pigeonholes are applied again to the bits that its members may differ in, and cells
that are large even then are compared chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnspark.llm.common import heavy_light_join, settle, texts
from churnspark.llm.neardup import components

BITS = 64
#: Members that one task compares at once; a larger cell is divided.
LARGE = 4096
#: Fingerprints for each value of a cell's bits, on average, before blocks get more and narrower.
PER_CELL = 64
#: Shingles hashed at once, so that a very long text needs no more memory.
SLICE = 1 << 15
#: Bits of each byte value; place of each byte's counts.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_PLACE = 256 * np.arange(8)


def fingerprint(text: bytes | None, size: int = 4) -> int:
    """Bits set in over half of the XXH64 (seed 42) of the text's ``size``-word shingles, repeats included; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    span = min(size, len(words))
    first, last = starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(first), SLICE):
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(first[i : i + SLICE], last[i : i + SLICE], strict=True)], "<u8")
        by_byte = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE_PLACE).ravel(), minlength=2048).reshape(8, 256)
        counts += (by_byte @ _BYTE_BITS).ravel()
    return int(np.packbits(2 * counts > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """id and fp, the fingerprint as a signed 64-bit integer, of every row."""
    import pyarrow as pa

    def run(batches: Iterator):
        for batch in batches:
            fp = np.array([fingerprint(t, size) for t in texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, fp long")


def block_masks(free: int, parts: int, distance: int) -> list[int]:
    """Masks of every choice of ``parts`` - ``distance`` of the even blocks that the bits of ``free`` are cut into."""
    bits = [i for i in range(BITS) if free >> i & 1]
    cuts = [len(bits) * k // parts for k in range(parts + 1)]
    blocks = [sum(1 << b for b in bits[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return [sum(chosen) for chosen in combinations(blocks, parts - distance)]


def parts_for(count: int, distance: int) -> int:
    """Blocks to cut 64 bits into, so that cells hold about PER_CELL of ``count`` evenly spread fingerprints."""
    parts = distance + 2
    while parts < 2 * distance and count > PER_CELL << BITS * (parts - distance) // parts:
        parts += 1
    return parts


def _long(mask: int):
    return F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask).cast("long")


def joined(ids: np.ndarray, fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges (root, member) that join the members as links of ``distance`` bits do: nobody is compared again with those already joined."""
    out, left = [], np.arange(len(ids))
    while len(left) > 1:
        root, left, front = ids[left[0]], left[1:], left[:1]
        while len(front) and len(left):
            now, front = front[:64], front[64:]
            near = (np.bitwise_count(fps[now][:, None] ^ fps[left][None, :]) <= distance).any(axis=0)
            hit, left = left[near], left[~near]
            out += [(root, i) for i in ids[hit].tolist()]
            front = np.concatenate([front, hit])
    return out


def compare_cells(cells: DataFrame, distance: int, key: list[str]) -> DataFrame:
    """(a, b): edges that join the members (id, fp) of each cell that are linked; a cell fits a task."""
    import pyarrow as pa

    def edges(where, ids, fps) -> Iterator:
        """``where`` is the place where each row's cell begins; cells lie side by side."""
        sizes = np.bincount(where, minlength=len(where))[where]
        small = np.flatnonzero((sizes > 1) & (sizes <= 16))
        for step in range(1, 16):  # all cells at once: each row with the one `step` further on
            x, y = small[:-step], small[step:]
            ok = where[x] == where[y]
            x, y = x[ok], y[ok]
            ok = np.bitwise_count(fps[x] ^ fps[y]) <= distance
            yield np.stack([ids[x[ok]], ids[y[ok]]])
        for at in np.unique(where[sizes > 16]):
            found = joined(ids[at : at + sizes[at]], fps[at : at + sizes[at]], distance)
            yield np.array(found, np.int64).reshape(-1, 2).T

    def run(batches: Iterator):
        """Rows come sorted by cell; the last cell of a batch waits for the next batch."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy() for i in range(len(key) + 2)]
            held = now if held is None else [np.concatenate(z) for z in zip(held, now, strict=True)]
            new = np.concatenate([[True], np.any([z[1:] != z[:-1] for z in held[: len(key)]], axis=0)])
            last = np.flatnonzero(new)[-1]
            yield from out([z[:last] for z in held], new[:last])
            held = [z[last:] for z in held]
        if held is not None:
            yield from out(held, np.arange(len(held[0])) == 0)

    def out(rows, new):
        if len(rows[0]) < 2:
            return
        begins = np.flatnonzero(new)
        where = begins[np.cumsum(new) - 1]
        found = np.concatenate(list(edges(where, rows[-2], rows[-1].view(np.uint64))), axis=1)
        if found.shape[1]:
            a, b = np.unique(np.sort(found, axis=0), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows = cells.select(*key, "id", "fp").repartition(*key).sortWithinPartitions(*key)
    return rows.mapInArrow(run, "a long, b long").distinct()


def links(classes: DataFrame, distance: int, given: DataFrame | None = None) -> DataFrame:
    """(id, component) of the classes (id, fp) that links, or the ``given`` edges (a, b), join with others; component is the smallest id."""
    level = block_masks((1 << BITS) - 1, parts_for(classes.count(), distance), distance)
    masks = {t: m for t, m in enumerate(level)}
    cells = classes.select("id", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(_long(m)) for m in level])).alias("t", "v"))
    edges, comp = given, None
    for last in (False, True):
        big = settle(cells.groupBy("t", "v").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "fp")).alias("hub")).filter(F.col("n") > LARGE))
        if big.isEmpty():
            found = compare_cells(cells, distance, ["t", "v"])
            return components(settle(found if edges is None else found.union(edges)))
        small = compare_cells(cells.join(big.select("t", "v"), ["t", "v"], "left_anti"), distance, ["t", "v"])
        inside = settle(cells.join(big, ["t", "v"]))
        to_hub = inside.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub.fp"))) <= distance).select(F.col("hub.id").alias("a"), F.col("id").alias("b"))
        found = small.union(to_hub.filter("a <> b"))
        edges = settle((found if edges is None else found.union(edges)).distinct())
        comp = components(edges)
        marked = inside.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = marked.groupBy("t", "v").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("t", "v")
        open_ = settle(marked.join(mixed, ["t", "v"], "left_semi").select("t", "v", "n", "id", "fp"))
        if open_.isEmpty():
            return comp
        if not last:
            # the bits that the members of a cell may differ in, cut again; a table's masks go with its number
            below = {t: [m | s for s in block_masks(~m & ((1 << BITS) - 1), distance + 2, distance)] for t, m in masks.items()}
            each = len(next(iter(below.values())))
            deeper = F.create_map(*[x for t in below for x in (F.lit(t), F.array(*[_long(m) for m in below[t]]))])[F.col("t")]
            parts = open_.select("id", "fp", "t", F.posexplode(deeper).alias("s", "mask"))
            cells = parts.select("id", "fp", (F.col("t") * each + F.col("s")).alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("v"))
    chunks = F.ceil(2 * F.col("n") / LARGE)
    own = F.pmod(F.xxhash64("id"), chunks)
    pairs = open_.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    met = pairs.select("t", "v", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "fp")
    return components(settle(compare_cells(met, distance, ["t", "v", "x", "y"]).union(edges)))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), class_id and component_id for every row of ``docs``.

    Words are split at ASCII white space, A-Z in lower case; shingles are ``size`` words
    joined by a space (all words, if there are fewer).  Null, empty and wordless texts
    have the fingerprint zero and are linked like any other.  class_id is the smallest id
    with the same fingerprint, component_id the smallest that links of ``distance`` bits
    or fewer lead to.  Rows that repeat an id are one document with all their links.
    Rows with a null id are linked with nothing: class_id and component_id are null.
    Other columns are not read; no rows for an empty table.
    """
    base = settle(fingerprints(docs, doc_id, text, size))
    some = base.filter("id IS NOT NULL")
    classes = settle(some.groupBy("fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_docs")))
    comp = links(classes.select("id", "fp"), distance, _repeated(some, classes))
    named = settle(classes.select("fp", "n_docs", F.col("id").alias("class_id")).join(comp.withColumnRenamed("id", "class_id"), "class_id", "left")
                   .select("fp", "n_docs", "class_id", F.coalesce("component", "class_id").alias("component_id")))
    placed = heavy_light_join(some, named, "fp", "n_docs").select("id", "fp", "class_id", "component_id")
    nameless = base.filter("id IS NULL").withColumns({"class_id": F.lit(None).cast("long"), "component_id": F.lit(None).cast("long")})
    return placed.unionByName(nameless).select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "class_id", "component_id")


def _repeated(some: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(a, b): edges between the classes of an id that has several fingerprints; None if no id has."""
    several = settle(some.groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("id", "lo"))
    if several.isEmpty():
        return None
    of = classes.select("fp", F.col("id").alias("a")), classes.select(F.col("fp").alias("lo"), F.col("id").alias("b"))
    return settle(some.join(several, "id").select("fp", "lo").distinct().join(of[0], "fp").join(of[1], "lo").select("a", "b").distinct())
