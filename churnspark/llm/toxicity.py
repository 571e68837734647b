"""Toxic spans by a linear-chain conditional random field.

Documents are labelled, not tokens: a token of a toxic document counts as toxic when
its word, or a prefix of it, is far commoner in toxic documents.  The field sees each
token's two such log odds, in bins, and has two states; its weights are fitted by
gradient ascent on whole lines.  A line is a chain: forward and backward passes give
every token's probability of being toxic.  A document's score comes from the largest
of these and their sum, through a logistic curve fitted on the labelled sample.

Statistics of a labelled document leave that document out, so that fitting does not
see its own label in its features.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnspark.llm.common import settle, texts
from churnspark.llm.neardup import describe

#: Lengths of the prefixes that count besides the whole word.
PREFIXES = (4, 5, 6)
#: Upper edges of the bins of log odds; bin 0 is below the first.
EDGES = (1.0, 2.0, 3.0, 4.0, 5.0)
BINS = len(EDGES) + 1
#: Log odds from which a token of a toxic document is labelled toxic.
LABEL_AT = 3.0
#: Minwise values by which near copies are told.
COORDINATES = 48
#: Minwise values of COORDINATES that two near copies share at least: about the share of their shingles that is common.
NEAR = COORDINATES * 3 // 4
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def core(word: str) -> str:
    return word if word.isalnum() else _EDGE.sub("", word)


def units(word: str) -> list[str]:
    """The whole word, and its prefixes marked with their length."""
    return [word, *(f"{n}|{word[:n]}" for n in PREFIXES if len(word) > n)] if word else []


def lines_of(text: bytes | None) -> list[list[str]]:
    return [line.split() for line in (text or b"").decode("utf-8", "replace").lower().split("\n")]


@dataclass
class Lexicon:
    """counts[unit] = (toxic documents, clean documents) with it, of ``toxic`` and ``clean`` documents."""

    counts: dict[str, tuple[int, int]]
    toxic: int
    clean: int

    def odds(self, unit: str, label: int | None = None) -> float:
        """Log odds of the unit; ``label``: without one document of that label."""
        found = self.counts.get(unit)
        if found is None:
            return 0.0
        t, c, n_t, n_c = found[0], found[1], self.toxic, self.clean
        if label == 1:
            t, n_t = t - 1, n_t - 1
        elif label == 0:
            c, n_c = c - 1, n_c - 1
        return math.log((t + 0.25) / (n_t + 1)) - math.log((c + 0.25) / (n_c + 1)) if t > 0 else 0.0

    def token(self, word: str, label: int | None = None) -> tuple[int, float]:
        """The token's joint bin, and its largest log odds."""
        of = [self.odds(u, label) for u in units(core(word))]
        if not of:
            return 0, 0.0
        whole, prefix = of[0], max(of[1:], default=0.0)
        return bisect_right(EDGES, whole) * BINS + bisect_right(EDGES, prefix), max(whole, prefix)


class TokenBins(dict):
    """Joint bin of a word, remembered: that of ``Lexicon.token``, from tables of the few units that the lexicon has."""

    def __init__(self, lexicon: Lexicon, limit: int = 500_000):
        super().__init__()
        self.limit = limit
        bins = {u: bisect_right(EDGES, lexicon.odds(u)) for u in lexicon.counts}
        self.whole = {u: b * BINS for u, b in bins.items() if b}
        self.prefixes = [(n, {u[len(f"{n}|"):]: b for u, b in bins.items() if b and u.startswith(f"{n}|")}) for n in PREFIXES]

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        w, prefix = core(word), 0
        for n, known in self.prefixes:
            if len(w) <= n:
                break
            found = known.get(w[:n])
            if found is not None and found > prefix:
                prefix = found
        out = self[word] = self.whole.get(w, 0) + prefix
        return out


class Field:
    """Weights: ``theta[bin]`` of state 1 against state 0, and ``move[from, to]``."""

    def __init__(self, theta: np.ndarray, move: np.ndarray):
        self.theta, self.move = theta, move
        self.plain: dict[int, np.ndarray] = {}

    def passes(self, lines: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Each line's probabilities of state 1, and the expected number of moves over all lines.

        Lines are walked together, longest first: at step t only those that reach it.
        """
        order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
        lengths = np.array([len(lines[i]) for i in order])
        top = int(lengths[0]) if len(order) else 0
        active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(top)]  # lines longer than t
        emit = np.exp(np.clip(self.theta, -20, 20))
        at = np.concatenate([lines[i] for i in order]) if top else np.zeros(0, int)
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        turn = np.exp(np.clip(self.move, -20, 20))
        forward, expected = [], np.zeros((2, 2))
        a = None
        for t in range(top):
            n = active[t]
            e = emit[at[first[:n] + t]]
            a = np.stack([np.ones(n), e], 1) if t == 0 else (a[:n] @ turn) * np.stack([np.ones(n), e], 1)
            a /= a.sum(axis=1, keepdims=True)
            forward.append(a)
        out = np.zeros(len(at))
        b = np.zeros((0, 2))
        for t in range(top - 1, -1, -1):
            n = active[t]
            here = np.ones((n, 2))
            if t + 1 < top:
                m = active[t + 1]
                ahead = b * np.stack([np.ones(m), emit[at[first[:m] + t + 1]]], 1)
                pair = forward[t][:m, :, None] * turn[None] * ahead[:, None, :]
                expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                here[:m] = ahead @ turn.T
            here /= here.sum(axis=1, keepdims=True)
            p = forward[t] * here
            out[first[:n] + t] = p[:, 1] / p.sum(axis=1)
            b = here
        result: list[np.ndarray] = [np.zeros(0)] * len(lines)
        for i, s, n in zip(order, first, lengths, strict=True):
            result[i] = out[s : s + n]
        return result, expected

    def chances(self, lines: list[np.ndarray]) -> list[np.ndarray]:
        """The probabilities of ``passes``: with two states, a message is one number, the odds of state 1."""
        order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
        lengths = np.array([len(lines[i]) for i in order])
        top = int(lengths[0]) if len(order) else 0
        active = np.searchsorted(-lengths, -np.arange(top), "left").tolist()  # lines longer than t
        begins = np.concatenate([[0], np.cumsum(active)]).astype(np.int64)
        # step after step: the t-th tokens of all lines that have one lie together
        line = np.arange(begins[-1]) - np.repeat(begins[:-1], active)
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        place = first[line] + np.repeat(np.arange(top), active) if top else np.zeros(0, np.int64)
        emit = np.exp(np.clip(self.theta, -20, 20))[(np.concatenate([lines[i] for i in order]) if top else np.zeros(0, int))[place]]
        (t00, t01), (t10, t11) = np.exp(np.clip(self.move, -20, 20)).tolist()
        odds = emit.copy()
        for t in range(1, top):
            a = odds[begins[t - 1] : begins[t - 1] + active[t]]
            odds[begins[t] : begins[t + 1]] *= (t01 + a * t11) / (t00 + a * t10)
        after = np.ones(len(odds))
        for t in range(top - 2, -1, -1):
            u = after[begins[t + 1] : begins[t + 2]] * emit[begins[t + 1] : begins[t + 2]]
            after[begins[t] : begins[t] + active[t + 1]] = (t10 + t11 * u) / (t00 + t01 * u)
        odds *= after
        out = np.empty(len(odds))
        out[place] = odds / (1 + odds)
        result: list[np.ndarray] = [np.zeros(0)] * len(lines)
        for i, s, n in zip(order, first, lengths, strict=True):
            result[i] = out[s : s + n]
        return result

    def marginals(self, lines: list[np.ndarray]) -> list[np.ndarray]:
        """As ``chances``; lines with nothing remarkable depend on their length only."""
        out: list = [None] * len(lines)
        todo = []
        for i, line in enumerate(lines):
            if line.any():
                todo.append(i)
            else:
                if len(line) not in self.plain:
                    if len(self.plain) > 5000:
                        self.plain.clear()
                    self.plain[len(line)] = self.chances([line])[0]
                out[i] = self.plain[len(line)]
        for s in range(0, len(todo), 4096):
            part = todo[s : s + 4096]
            for i, p in zip(part, self.chances([lines[i] for i in part]), strict=True):
                out[i] = p
        return out


def fit_field(lines: list[np.ndarray], tags: list[np.ndarray], rounds: int = 100, ridge: float = 1.0) -> Field:
    """Gradient ascent (Adam) on the conditional log-likelihood with a quadratic penalty."""
    n = BINS * BINS
    seen, moved = np.zeros(n), np.zeros((2, 2))
    for x, y in zip(lines, tags, strict=True):
        seen += np.bincount(x[y == 1], minlength=n)
        np.add.at(moved, (y[:-1], y[1:]), 1)
    w = np.concatenate([np.full(n, -3.0), np.zeros(4)])
    m, v = np.zeros_like(w), np.zeros_like(w)
    scale = max(1.0, float(sum(y.sum() for y in tags)))
    flat = np.concatenate(lines) if lines else np.zeros(0, int)
    for i in range(rounds):
        p, pairs = Field(w[:n], w[n:].reshape(2, 2)).passes(lines)
        expected = np.bincount(flat, weights=np.concatenate(p) if p else None, minlength=n)
        grad = np.concatenate([seen - expected, (moved - pairs).ravel()]) / scale - ridge * w / scale
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w + 0.2 * (m / (1 - 0.9 ** (i + 1))) / (np.sqrt(v / (1 - 0.99 ** (i + 1))) + 1e-8)
    return Field(w[:n], w[n:].reshape(2, 2))


def summary(marginals: list[np.ndarray]) -> tuple[float, float]:
    """What a document's score is made of: the largest marginal as log odds, and the sum of those that stand out."""
    p = np.concatenate(marginals) if marginals else np.zeros(0)
    top = min(max(float(p.max(initial=0.0)), 1e-6), 1 - 1e-6)
    return math.log(top / (1 - top)), math.log1p(float(p[p >= 0.05].sum()))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of (1, x) by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    theta: np.ndarray
    move: np.ndarray
    curve: np.ndarray

    def score(self, s: tuple[float, float]) -> float:
        z = float(self.curve[0] + self.curve[1] * s[0] + self.curve[2] * s[1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def distinct_texts(described: Iterable[tuple[int, int, bytes | None]]) -> list[int]:
    """Ids of rows (id, label, minwise values), without near copies: those that share NEAR values or more with a smaller id that stays, of their label.

    Texts that share NEAR of the values share one of the 16 groups of three values, but for
    about one in 7000; only such texts are compared.  Of texts without words one stays.
    """
    rows = sorted(described, key=lambda r: (r[0], r[1], r[2] or b""))
    values = np.frombuffer(b"".join(r[2] or bytes(4 * COORDINATES) for r in rows), "<u4").reshape(-1, COORDINATES)
    stay: list[int] = []
    groups: dict[tuple, list[int]] = {}
    for at, (_, label, _) in enumerate(rows):
        keys = [(label, g, values[at, g : g + 3].tobytes()) for g in range(0, COORDINATES, 3)]
        near = list({x for k in keys for x in groups.get(k, ())})
        if (values[near] == values[at]).sum(axis=1).max(initial=0) < NEAR:
            stay.append(at)
            for k in keys:
                groups.setdefault(k, []).append(at)
    return [rows[at][0] for at in stay]


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample: int = 4000,
        field_documents: int = 1500, stretch: int = 64, min_documents: int = 3, most_units: int = 50_000) -> Model:
    """Fit on a bounded sample: the ``sample`` toxic and 2 * ``sample`` clean labelled documents with the smallest id hashes.

    The lexicon has the ``most_units`` units found in most toxic documents, if in
    ``min_documents`` of them; the field sees ``field_documents`` of each label, cut
    into stretches of ``stretch`` tokens.
    """
    import pyarrow as pa
    spark = docs.sparkSession
    marked = (labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("toxic")).filter("id IS NOT NULL AND toxic IS NOT NULL")
              .groupBy("id").agg(F.max("toxic").cast("int").alias("toxic")))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    h = F.xxhash64("id")
    ids = (marked.filter("toxic = 1").orderBy(h, "id").limit(sample)
           .union(marked.filter("toxic <> 1").orderBy(h, "id").limit(2 * sample)))
    # 3 * sample ids at most; of copies and near copies one counts, or their rare words would look toxic
    digest = F.xxhash64(F.lower(F.coalesce(F.col(text), F.lit(""))))
    picked = settle(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), digest.alias("digest")).join(F.broadcast(ids), "id")
                    .select("id", "text", "digest", (F.col("toxic") == 1).cast("int").alias("toxic")))
    unique = picked.join(F.broadcast(picked.groupBy("digest", "toxic").agg(F.min("id").alias("id"))), ["digest", "toxic", "id"]).select("id", "text", "toxic")
    mins = describe(unique, "id", "text", 5, COORDINATES).select("id", "mins").join(F.broadcast(ids), "id").select("id", "mins", (F.col("toxic") == 1).cast("int").alias("toxic"))
    kept = distinct_texts((r["id"], r["toxic"], r["mins"]) for r in mins.collect())  # 3 * sample rows, of 48 values each
    rows = settle(unique.join(F.broadcast(spark.createDataFrame([(i,) for i in sorted(set(kept))], "id long")), "id"))

    def count(wanted: int, only):
        def run(batches: Iterator):
            tally, n = Counter(), 0
            for batch in batches:
                for t, y in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                    if y == wanted:
                        found = {u for w in {w for line in lines_of(t) for w in line} for u in units(core(w))}
                        tally.update(found if only is None else found & only.value)
                        n += 1
            tally[""] = n  # the number of documents
            yield pa.RecordBatch.from_arrays([pa.array(list(tally)), pa.array(list(tally.values()), pa.int64())], ["unit", "n"])
        return rows.mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))

    toxic = {r["unit"]: r["n"] for r in count(1, None).filter((F.col("n") >= min_documents) | (F.col("unit") == "")).orderBy(F.col("unit") != "", F.col("n").desc(), "unit").limit(most_units + 1).collect()}
    n_toxic = toxic.pop("", 0)
    clean = {r["unit"]: r["n"] for r in count(0, spark.sparkContext.broadcast(set(toxic))).collect()}  # most_units + 1 at most
    lexicon = Lexicon({u: (n, clean.get(u, 0)) for u, n in toxic.items()}, n_toxic, clean.get("", 0))
    lexicon.counts = {u: c for u, c in lexicon.counts.items() if lexicon.odds(u) >= EDGES[0] / 2}
    held = spark.sparkContext.broadcast(lexicon)

    def tokens(batches: Iterator):
        """Bins and tags of every line that has a remarkable token, and the lengths of the others."""
        lex = held.value
        for batch in batches:
            out = []
            for t, y in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                memo: dict = {}
                xs, ys = [], []
                for line in lines_of(t):
                    for w in line:
                        if w not in memo:
                            memo[w] = lex.token(w, y)
                    xs.append(np.array([memo[w][0] for w in line], np.uint8))
                    ys.append(np.array([y == 1 and memo[w][1] >= LABEL_AT for w in line], np.uint8))
                out.append((y, [len(x) for x in xs], b"".join(x.tobytes() for x in xs), b"".join(x.tobytes() for x in ys)))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())],
                                             ["id", "toxic", "lengths", "bins", "tags"])

    tagged = settle(rows.mapInArrow(tokens, "id long, toxic int, lengths array<int>, bins binary, tags binary"))

    def split(r) -> tuple[list[np.ndarray], list[np.ndarray]]:
        cut = np.cumsum(r["lengths"])[:-1]
        return tuple([p for p in np.split(np.frombuffer(r[c], np.uint8), cut) if len(p)] for c in ("bins", "tags"))

    xs, ys = [], []
    for y in (1, 0):
        for r in tagged.filter(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(field_documents).collect():  # one byte a token
            parts = [(x[i : i + stretch].astype(np.int64), t[i : i + stretch].astype(np.int64))
                     for x, t in zip(*split(r), strict=True) for i in range(0, len(x), stretch)]
            # stretches without a remarkable token teach the same thing: two of a document do
            for x, t in [p for p in parts if p[0].any()] + [p for p in parts if not p[0].any()][:2]:
                xs.append(x)
                ys.append(t)
    field = fit_field(xs, ys)
    shared = spark.sparkContext.broadcast((field.theta, field.move))

    def summarize(batches: Iterator):
        f = Field(*shared.value)
        for batch in batches:
            out = []
            for lengths, bins in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = np.frombuffer(bins, np.uint8).astype(np.int64)
                out.append(summary(f.marginals([p for p in np.split(x, np.cumsum(lengths)[:-1]) if len(p)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.float64())], ["toxic", "top", "total"])

    found = tagged.select("toxic", "lengths", "bins").mapInArrow(summarize, "toxic int, top double, total double").collect()  # 3 * sample rows
    y = np.array([r["toxic"] for r in found], float)
    x = np.array([[r["top"], r["total"]] for r in found], float).reshape(-1, 2)
    # the sample has other shares of the labels than the labelled rows
    share = {1: sizes.get(True, 0) / max(1.0, y.sum()), 0: sizes.get(False, 0) / max(1.0, (1 - y).sum())}
    weight = np.where(y == 1, share[1], share[0])
    curve = fit_logistic(x, y, weight / max(weight.mean(), 1e-12)) if len(y) else np.zeros(3)
    return Model(lexicon, field.theta, field.move, curve)


def score(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.3, span_at: float = 0.5) -> DataFrame:
    """Every column of ``docs`` with score (0 to 1), predicted (1 if score >= ``threshold``) and spans; columns of these names are replaced.

    spans lists the code-point offsets [start, end) of runs of tokens in a line whose
    probability is ``span_at`` or more.  A null or empty text has no tokens: it gets
    the score of a text with nothing remarkable, and no spans.
    """
    import pyarrow as pa
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ("score", "predicted", "spans")
    rows = docs.select(*[c for c in docs.columns if c not in names])
    keep = rows.columns
    at = keep.index(text)

    def spans_of(t: bytes, marginals: list[np.ndarray]) -> list[dict]:
        whole, out, start = t.decode("utf-8", "replace"), [], 0
        for line, p in zip(whole.split("\n"), marginals, strict=True):
            if len(p) and p.max() >= span_at:
                run = None
                for m, q in zip(re.finditer(r"\S+", line), p.tolist(), strict=False):
                    if q < span_at:
                        run = None
                    elif run is None:
                        run = {"start": start + m.start(), "end": start + m.end()}
                        out.append(run)
                    else:
                        run["end"] = start + m.end()
            start += len(line) + 1
        return out

    def run(batches: Iterator):
        m = shared.value
        bins, field = TokenBins(m.lexicon), Field(m.theta, m.move)
        for batch in batches:
            scores, spans, todo = [], [], texts(batch.column(at))
            for s in range(0, len(todo), 256):
                part = todo[s : s + 256]
                per_doc = [[np.fromiter(map(bins.__getitem__, line), np.int64, len(line)) for line in lines_of(t)] for t in part]
                found = iter(field.marginals([x for lines in per_doc for x in lines]))
                for t, lines in zip(part, per_doc, strict=True):
                    p = [next(found) for _ in lines]
                    scores.append(m.score(summary(p)))
                    spans.append(spans_of(t or b"", p))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()),
                                              pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], [*keep, *names])

    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", SPANS)])
    return rows.mapInArrow(run, schema)
