"""Trees and boosted trees by histograms, many models at once.

Rows are binned once and stay in blocks (an RDD of numpy arrays: what a task does with
its block - look up a node, add to a histogram - has no form as a column expression).
A :class:`Grower` holds the models that are growing.  Each step is one Spark job for all
of them: a model says which nodes of its tree it wants split, the tasks sum their rows by
(model, node, feature, bin), the sums of a model meet in one task, which looks for the
nodes' best splits, and only those splits come to the driver.  Models do not
wait for each other, so trials of a search, folds and learners grow side by side
whatever their depth and number of rounds.

What a task holds is bounded by CELLS_PER_JOB; a step that wants more histograms
runs as several jobs.  Rows that fit one block (BLOCK_ROWS) are broadcast, and each task
grows one model to its end by the same steps, without a job for each; where several models
are boosted, tasks get the rows of up to HELD_BLOCKS blocks by an exchange and do the same.  Features with few
bins are counted together, by the joint code of several, and parted afterwards.
Gradients are rounded to multiples of 2^-24, so that their sums are
exact and do not depend on how rows are dealt to tasks.

Split gains: ``newton`` T(G)^2 / (H + lambda) with T cutting alpha off |G| (second-order
boosting), ``variance`` G^2 / n (least squares on the residuals), ``gini`` and
``entropy`` (weighted impurity).  With ``num_leaves`` a tree grows best node first: the
children of all nodes that may still be split are looked at ahead, and the splits are
then taken strictly in the order of their gains.  ``symmetric`` trees split a whole
level alike.
"""

from __future__ import annotations

import json
import math
import pickle
from dataclasses import dataclass, replace
from functools import cached_property, partial

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnspark import schema as S
from churnspark.session import ensure_checkpoint_dir

#: Bins of a feature at most.
MAX_BINS = 64
#: Histogram cells (three numbers each) that a task of one job sums at most, or one model's nodes.
CELLS_PER_JOB = 2_000_000
#: Values of the joint code of features that are counted together at most.
JOINT = 64
#: Jobs between two updates of the stored margins, and updates between two checkpoints.
REFRESH, CHECKPOINT = 8, 25
#: Row-models of a block at least, and rows of a block at most, where there are enough.
BLOCK_WORK, BLOCK_ROWS = 25_000, 131_072
#: Rows of a partition at most; one has several blocks, a record batch each.
PART_ROWS = 262_144
#: Rows of a model's task from which nodes keep lists of their rows, and of a node from which it is counted alone.
MANY_ROWS, OWN_ROWS = 8_192, 4_096
#: Rows that are dealt at once, so that they stay in a core's cache.
DEALT = 8_192
#: Rows that are counted at once, and what stands for one row beside its h: the sums stay within a double's 53 bits.
CHUNK, ONE_ROW = 32_767, 2.0**14
#: Blocks of rows that a task which grows whole models may hold.
HELD_BLOCKS = 8
#: The column of fold numbers.
FOLD = "fold"
#: Gradients are multiples of this.
GRAIN = 2.0**-24


@dataclass(frozen=True)
class TreeSpec:
    """One model: a tree, or ``rounds`` boosted trees on the logistic loss."""

    criterion: str = "newton"          # newton, variance: boosted; gini, entropy: a single tree
    rounds: int = 1
    learning_rate: float = 1.0
    max_depth: int = 6
    num_leaves: int = 0                # best node first up to so many leaves; 0: no bound
    min_leaf: int = 1                  # rows of a leaf
    min_split: int = 2                 # rows of a node that is split
    min_hessian: float = 0.0           # sum of second derivatives in a leaf
    reg_lambda: float = 0.0
    reg_alpha: float = 0.0
    min_gain: float = 0.0
    subsample: float = 1.0             # rows drawn for each tree
    colsample: float = 1.0             # features drawn for each tree
    node_features: float | str | None = None   # features drawn at each node: sqrt, log2, a share, a number
    symmetric: bool = False
    temperature: float = 0.0           # of the Bayesian bootstrap's row weights; 0: none
    balanced: bool = False
    val_share: float = 0.0             # rows that only early stopping looks at
    patience: int = 0                  # rounds without a gain of `tol` in their loss; 0: no early stop
    tol: float = 0.0
    seed: int = 42
    view: int = 0                      # which of the rows' feature sets it reads
    held_out: int | None = None        # the fold that it is not trained on

    @property
    def boosted(self) -> bool:
        return self.criterion in ("newton", "variance")


# ------------------------------------------------------------------ inside tasks

def _scramble(x: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in (0, 1) from row ids and a salt."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(salt % 2**64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _nodes(codes: np.ndarray, feature: np.ndarray, code: np.ndarray, left: np.ndarray, right: np.ndarray, node: np.ndarray | None = None) -> np.ndarray:
    """The deepest node of the (partial) tree for every row; ``node``: nodes that the rows are known to pass."""
    node = np.zeros(len(codes), np.int64) if node is None else node
    flat, start, n = codes.ravel(), np.arange(len(codes)) * codes.shape[1], len(feature)
    leaf, own = feature < 0, np.arange(n)
    look = np.where(leaf, 0, feature)
    child = np.concatenate([np.where(leaf, own, right), np.where(leaf, own, left)])
    while not leaf[node].all():
        node = child[(flat[start + look[node]] <= code[node]) * n + node]
    return node


def _margin(block: dict, model: int, base: float, view: int, pending: dict) -> np.ndarray:
    margin = block["margin"].get(model)
    margin = np.full(len(block["y"]), base) if margin is None else margin
    for tree in pending.get(model, ()):
        margin = margin + tree[4][_nodes(block["codes"][view], *tree[:4])]
    return margin


def _derivatives(block: dict, ask: dict, pending: dict):
    """Rows to use, and their g, h and count; and the loss over the rows of early stopping."""
    spec, y = ask["spec"], block["y"]
    use = block["fold"] != (-1 if spec.held_out is None else spec.held_out)
    w = 1.0 if ask["weights"][0] == ask["weights"][1] == 1 else np.where(y > 0, ask["weights"][1], ask["weights"][0])
    loss = np.zeros(2)
    if spec.boosted:
        m = _margin(block, ask["model"], ask["base"], spec.view, pending)
        p = 1.0 / (1.0 + np.exp(-m))
        if spec.val_share:
            val = use & (_scramble(block["id"], spec.seed) < spec.val_share)
            use &= ~val
            loss[:] = (np.logaddexp(0, m[val]) - y[val] * m[val]).sum(), val.sum()
        if spec.temperature:
            w = w * (-np.log(_scramble(block["id"], 977 * ask["round"] + spec.seed + 7))) ** spec.temperature
        g, h = w * (p - y), w * p * (1 - p)
    else:
        g, h = w * y, w * np.ones(len(y))
    if spec.subsample < 1:
        use = use & (_scramble(block["id"], 1009 * ask["round"] + spec.seed + 1) < spec.subsample)
    return np.flatnonzero(use), np.rint(g / GRAIN) * GRAIN, np.rint(h / GRAIN) * GRAIN, loss


def _score(spec: TreeSpec, g, h, c):
    """What a node adds to the gain of a split that makes it."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if spec.criterion == "newton":
            t = np.sign(g) * np.maximum(np.abs(g) - spec.reg_alpha, 0) if spec.reg_alpha else g
            s = t * t / (h + spec.reg_lambda)
        elif spec.criterion == "variance":
            s = g * g / c
        elif spec.criterion == "gini":
            s = -2 * g * (h - g) / h
        else:
            s = np.where(g > 0, g * np.log2(g / h), 0) + np.where(h - g > 0, (h - g) * np.log2((h - g) / h), 0)
    return np.where(np.isfinite(s), s, 0.0)


@dataclass(frozen=True)
class Layout:
    """Where a view's features lie in a histogram, and which of them are counted together."""

    offsets: np.ndarray                # the first cell of each feature, and the number of cells
    bundles: list                      # (features, their bins) whose joint codes are counted

    @property
    def feature_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    @cached_property
    def spread(self) -> list[tuple]:
        """For each bundle the cells of its features, and (joint code, cell): 1 where the code counts for the cell."""
        out = []
        for features, bins in self.bundles:
            codes = np.unravel_index(np.arange(math.prod(bins)), bins)
            cells = np.concatenate([np.arange(self.offsets[f], self.offsets[f + 1]) for f in features])
            out.append((cells, np.concatenate([c[:, None] == np.arange(b) for c, b in zip(codes, bins, strict=True)], axis=1).astype(float)))
        return out

    def wanted(self, chosen) -> list[bool]:
        """The bundles that hold one of the chosen features (None: of all)."""
        if chosen is None:
            return [True] * len(self.bundles)
        some = np.zeros(len(self.offsets) - 1, bool)
        some[chosen] = True
        return [bool(some[features].any()) for features, _ in self.bundles]


def _layout(cuts: list[np.ndarray]) -> Layout:
    bundles: list[tuple[list, list]] = []
    for f, c in enumerate(cuts):
        bins = len(c) + 1
        room = next((b for b in bundles if math.prod(b[1]) * bins <= JOINT), None)
        if room is None:
            room = ([], [])
            bundles.append(room)
        room[0].append(f)
        room[1].append(bins)
    return Layout(np.cumsum([0, *(len(c) + 1 for c in cuts)]), bundles)


def _joint(codes: np.ndarray, layout: Layout) -> np.ndarray:
    """(bundle, row): the joint codes."""
    out = np.zeros((len(layout.bundles), len(codes)), codes.dtype)
    for joint, (features, bins) in zip(out, layout.bundles, strict=True):
        for f, b in zip(features, bins, strict=True):
            joint *= codes.dtype.type(b) if len(features) > 1 else codes.dtype.type(1)
            joint += codes[:, f]
    return out


def _pairs(layout: Layout) -> list[tuple]:
    """The bundles two by two, the largest with the smallest; one alone where two have too many joint codes."""
    size = [math.prod(bins) for _, bins in layout.bundles]
    line, out = sorted(range(len(size)), key=lambda b: (size[b], b)), []
    while line:
        b = line.pop()
        out.append((line.pop(0), b) if line and size[line[0]] * size[b] <= JOINT * JOINT else (b,))
    return out


def _wide(joint: np.ndarray, layout: Layout) -> np.ndarray:
    """(pair, row): the joint codes of a pair of bundles."""
    pairs = _pairs(layout)
    out = np.empty((len(pairs), joint.shape[1]), np.uint16)
    for wide, (a, *b) in zip(out, pairs, strict=True):
        wide[:] = joint[a]
        for other in b:
            wide *= np.uint16(math.prod(layout.bundles[other][1]))
            wide += joint[other]
    return out


def _step(blocks, wanted: bytes, layouts: list[Layout]):
    asks, pending = pickle.loads(wanted)
    return enumerate(_histograms(blocks, asks, layouts, pending))


def _histograms(blocks, asks: list[dict], layouts: list[Layout], pending: dict) -> list[tuple]:
    """For each model the sums (node, kind, cell) of the nodes it asks for, and its loss.

    The kinds are g, h and the rows; for a single tree, the rows of either label."""
    held: list[dict] = [{} for _ in asks]
    losses = np.zeros((len(asks), 2))
    for block in blocks:
        for i, ask in enumerate(asks):
            n, spec, tree = len(ask["nodes"]), ask["spec"], ask["tree"]
            rows, g, h, loss = _derivatives(block, ask, pending)
            losses[i] += loss
            if len(tree[0]) > 1:
                place = np.full(len(tree[0]), -1)
                place[ask["nodes"]] = np.arange(n)
                pos = place[_nodes(block["codes"][spec.view][rows], *tree)]
                rows, pos = rows[pos >= 0], pos[pos >= 0]
            else:
                pos = np.zeros(len(rows), np.int64)
            if not spec.boosted:                  # by label, and once for both
                pos = pos * 2 + (block["y"][rows] > 0)
            weights = (g[rows], h[rows], None) if spec.boosted else (None,)
            for b, (features, bins) in enumerate(layouts[spec.view].bundles):
                if ask["features"] is not None and not np.isin(features, ask["features"]).any():
                    continue
                size = math.prod(bins)
                cell = pos * size + block["joint"][spec.view][b][rows]
                if spec.boosted:
                    sums = np.stack([np.bincount(cell, w, n * size).reshape(n, size) for w in weights], axis=1)
                else:
                    sums = np.bincount(cell, None, 2 * n * size).reshape(n, 2, size)
                held[i][b] = held[i][b] + sums if b in held[i] else sums
    return [(_parted(found, layouts[a["spec"].view], len(a["nodes"]), 3 if a["spec"].boosted else 2), loss) for a, found, loss in zip(asks, held, losses, strict=True)]


def _parted(found: dict, layout: Layout, n: int, kinds: int) -> np.ndarray:
    """Sums by joint codes as sums by feature and bin."""
    out = np.zeros((n, kinds, int(layout.offsets[-1])), float if kinds == 3 else np.int64)
    for b, sums in found.items():
        cells, counts = layout.spread[b]
        out[:, :, cells] = (sums.reshape(n * kinds, -1) @ counts).reshape(n, kinds, -1)      # exact: whole multiples of GRAIN
    return out


def _merged(x: tuple, y: tuple) -> tuple:
    return x[0] + y[0], x[1] + y[1]


def _search(found: tuple, wanted: bytes, layouts: list[Layout]) -> tuple:
    i, (sums, loss) = found
    return i, _splits(pickle.loads(wanted)[i], sums, loss, layouts)


def _splits(ask: dict, hists: np.ndarray, loss: np.ndarray, layouts: list[Layout]) -> dict:
    """The nodes' sums and best splits (gain, feature, code, sums of the left child), or None."""
    spec, layout = ask["spec"], layouts[ask["spec"].view]
    o, feature_of = layout.offsets, layout.feature_of
    if not spec.boosted:
        one = [float(np.rint(w / GRAIN) * GRAIN) for w in ask["weights"]]
        hists = np.stack([hists[:, 1] * one[1], hists[:, 0] * one[0] + hists[:, 1] * one[1], (hists[:, 0] + hists[:, 1]).astype(float)], axis=1)
    first = 0 if ask["features"] is None else int(ask["features"][0])
    sums = hists[:, :, o[first] : o[first + 1]].sum(axis=2)
    gain, left, right, ok = _gains(spec, hists, sums, o, feature_of, ask["features"])
    if spec.symmetric:
        total = np.where(ok, gain.sum(axis=0) - _score(spec, *sums.T).sum(), -np.inf)
        cell = int(total.argmax())
        if not (total[cell] > 1e-6 and total[cell] >= spec.min_gain):
            return dict(sums=sums, best=[None] * len(sums), loss=loss)
        f = int(feature_of[cell])
        return dict(sums=sums, best=[(float(total[cell]) / len(sums), f, cell - int(o[f]), left[i, :, cell].copy()) for i in range(len(sums))], loss=loss)
    ok = ok[None, :] & (left[:, 2] >= spec.min_leaf) & (right[:, 2] >= spec.min_leaf)
    if spec.min_hessian:
        ok &= (left[:, 1] >= spec.min_hessian) & (right[:, 1] >= spec.min_hessian)
    if ask["masks"] is not None:
        ok &= ask["masks"][:, feature_of]
    gain = np.where(ok, gain - _score(spec, *sums.T)[:, None], -np.inf)
    best = []
    for i, cell in enumerate(gain.argmax(axis=1).tolist()):
        f = int(feature_of[cell])
        some = gain[i, cell] > 1e-6 and gain[i, cell] >= spec.min_gain
        best.append((float(gain[i, cell]), f, cell - int(o[f]), left[i, :, cell].copy()) if some else None)
    return dict(sums=sums, best=best, loss=loss)


def _gains(spec: TreeSpec, hists: np.ndarray, sums: np.ndarray, o: np.ndarray, feature_of: np.ndarray, chosen):
    """Gain of every cut of every node (a cut after the cell), and the sums left and right of it."""
    running = np.cumsum(hists, axis=2)
    before = np.concatenate([np.zeros((*running.shape[:2], 1)), running], axis=2)[:, :, o[:-1]]
    left = running - before[:, :, feature_of]
    right = sums[:, :, None] - left
    gain = _score(spec, left[:, 0], left[:, 1], left[:, 2]) + _score(spec, right[:, 0], right[:, 1], right[:, 2])
    ok = np.ones(hists.shape[2], bool)
    ok[o[1:] - 1] = False                         # nothing lies behind a feature's last bin
    if chosen is not None:
        ok &= np.isin(feature_of, chosen)
    return gain, left, right, ok


# ------------------------------------------------------------------ on the driver

class _Tree:
    """A growing tree: node lists, the best split known of each node, and sums of nodes whose children are wanted."""

    def __init__(self):
        self.feature, self.code, self.left, self.right, self.parent, self.depth = [], [], [], [], [], []
        self.sums: list[np.ndarray] = []          # g, h, count
        self.best: dict[int, tuple] = {}          # node -> (gain, feature, code, sums of the left child)
        self.gain: list[float] = []
        self.taken: set[int] = set()              # nodes whose split is certain
        self.leaves = 1

    def add(self, parent: int, sums) -> int:
        depth = self.depth[parent] + 1 if parent >= 0 else 0
        for values, v in ((self.feature, -1), (self.code, 0), (self.left, -1), (self.right, -1), (self.parent, parent), (self.depth, depth), (self.sums, sums), (self.gain, 0.0)):
            values.append(v)
        return len(self.feature) - 1

    def arrays(self, of=None) -> tuple:
        """feature, code, left, right; nodes outside ``of`` count as leaves."""
        feature = np.array(self.feature)
        if of is not None:
            kept = np.zeros(len(feature), bool)
            kept[list(of)] = True
            feature = np.where(kept, feature, -1)
        return feature, np.array(self.code), np.array(self.left), np.array(self.right)


class _Model:
    def __init__(self, spec: TreeSpec, number: int, weights, base: float, features: int):
        self.spec, self.number, self.weights, self.base, self.features = spec, number, weights, base, features
        self.trees: list[dict] = []
        self.round, self.done = 0, False
        self.best_loss, self.waited = math.inf, 0
        self.start()

    def start(self) -> None:
        self.rng = np.random.default_rng((self.spec.seed, self.round))
        self.chosen = None
        if self.spec.colsample < 1:
            n = max(1, int(self.features * self.spec.colsample))
            self.chosen = np.sort(self.rng.permutation(self.features)[:n])
        self.tree, self.wanted = None, [0]        # nodes to split

    def node_mask(self) -> np.ndarray | None:
        """Features that a node may be split on."""
        k = self.spec.node_features
        if k is None:
            return None
        n = {"sqrt": int(math.sqrt(self.features)), "log2": int(math.log2(self.features))}.get(k) if isinstance(k, str) else \
            int(k) if k >= 1 and float(k).is_integer() and not isinstance(k, float) else int(k * self.features)
        mask = np.zeros(self.features, bool)
        mask[self.rng.permutation(self.features)[: max(1, n)]] = True
        return mask


class Grower:
    """Models that grow together on the same blocks of rows."""

    def __init__(self, blocks, layouts: list[Layout], thresholds: list[list[np.ndarray]], counts: dict, parts: int):
        self.state, self.layouts, self.thresholds, self.counts, self.parts = blocks, layouts, thresholds, counts, parts
        self.models: list[_Model] = []
        self.active: list[_Model] = []
        self.pending: dict[int, list] = {}        # trees since the margins were stored
        self.bases: dict[int, tuple] = {}
        self.jobs = self.refreshes = 0
        self.before: list = []

    # -- models

    def add(self, spec: TreeSpec) -> int:
        n = np.zeros(2)
        for (fold, label), c in self.counts.items():
            if spec.held_out is None or fold != spec.held_out:
                n[label] += c
        if not n.sum():
            raise ValueError("no training rows")
        weights = (n.sum() / (2 * np.maximum(n, 1))).tolist() if spec.balanced else [1.0, 1.0]
        prior = (n[1] * weights[1] + 1e-12) / (n @ weights + 2e-12)
        base = math.log(prior / (1 - prior)) if spec.boosted else 0.0
        m = _Model(spec, len(self.models), weights, base, len(self.thresholds[spec.view]))
        self.models.append(m)
        self.active.append(m)
        if spec.boosted:
            self.bases[m.number] = (base, spec.view)
        return m.number

    def run(self) -> None:
        while self.active:
            self.step()

    def forget(self, numbers) -> None:
        """Drop the margins of finished models."""
        for i in numbers:
            self.bases.pop(i, None)
            self.pending.pop(i, None)

    # -- one step

    def step(self) -> list[int]:
        """One round of histograms for every active model; returns the models that are finished."""
        if self.jobs and self.jobs % REFRESH == 0:
            self._refresh()
        self.jobs += 1
        asks = []
        for m in self.active:
            tree = m.tree.arrays() if m.tree else (np.array([-1]),) * 4
            masks = None if m.spec.symmetric or m.spec.node_features is None else np.array([m.node_mask() for _ in m.wanted])
            asks.append(dict(model=m.number, spec=m.spec, round=m.round, weights=m.weights, base=m.base, features=m.chosen, nodes=np.array(m.wanted), tree=tree, masks=masks))
        groups, size = [[]], 0
        for ask in asks:
            n = len(ask["nodes"]) * int(self.layouts[ask["spec"].view].offsets[-1])
            if groups[-1] and size + n > CELLS_PER_JOB:
                groups.append([])
                size = 0
            groups[-1].append(ask)
            size += n
        models = iter(self.active)
        for group in groups:
            for found in self._find(group):
                self._grow(next(models), found)
        finished = [m.number for m in self.active if m.done]
        self.active = [m for m in self.active if not m.done]
        return finished

    def _find(self, asks: list[dict]) -> list[dict]:
        """What :func:`_splits` finds for each of them."""
        pending = {a["model"]: self.pending[a["model"]] for a in asks if a["model"] in self.pending}
        sums = self.state.mapPartitions(partial(_step, wanted=pickle.dumps((asks, pending), -1), layouts=self.layouts)) \
            .reduceByKey(_merged, min(len(asks), self.parts))
        light = pickle.dumps([{k: a[k] for k in ("spec", "weights", "features", "masks")} for a in asks], -1)
        return [found for _, found in sorted(sums.map(partial(_search, wanted=light, layouts=self.layouts)).collect(), key=lambda r: r[0])]

    def _refresh(self) -> None:
        """Store the margins with all trees so far."""
        bases, pending = dict(self.bases), self.pending
        if not any(pending.values()):
            return

        def run(blocks):
            for b in blocks:
                yield dict(b, margin={m: _margin(b, m, base, view, pending) for m, (base, view) in bases.items()})

        for rdd in self.before:                   # the jobs since have stored the state that replaced it
            rdd.unpersist()
        self.before, self.pending = [self.state], {}
        self.state = self.state.mapPartitions(run).persist(StorageLevel.MEMORY_AND_DISK)
        self.refreshes += 1
        if self.refreshes % CHECKPOINT == 0:
            self.state.checkpoint()               # the next job writes it

    def release(self) -> None:
        for rdd in (*self.before, self.state):
            rdd.unpersist()

    # -- growing one model

    def _grow(self, m: _Model, found: dict) -> None:
        spec, loss = m.spec, found["loss"]
        if m.tree is None:
            if spec.patience and loss[1] and self._stale(m, loss[0] / loss[1]):
                m.done = True
                return
            m.tree = _Tree()
            m.tree.add(-1, found["sums"][0])
        nodes, m.wanted = m.wanted, []
        m.tree.best.update((node, best) for node, best in zip(nodes, found["best"], strict=True) if best is not None)
        if spec.symmetric:
            for node in nodes:
                if node in m.tree.best:
                    m.tree.taken.add(node)
                    self._ask(m, self._split(m, node))
        else:
            self._take_splits(m)
        if not m.wanted:
            self._finish_tree(m)

    def _stale(self, m: _Model, loss: float) -> bool:
        if loss < m.best_loss - m.spec.tol:
            m.best_loss, m.waited = loss, 0
        else:
            m.waited += 1
        return m.waited >= m.spec.patience

    def _may_split(self, m: _Model, node: int) -> bool:
        spec, (_, h, c) = m.spec, m.tree.sums[node]
        if spec.symmetric:
            return m.tree.depth[node] < spec.max_depth
        return m.tree.depth[node] < spec.max_depth and c >= max(spec.min_split, 2 * spec.min_leaf) and h >= 2 * spec.min_hessian

    def _split(self, m: _Model, node: int) -> tuple[int, int]:
        """Give the node its best split's children; which of its splits are certain is another matter."""
        tree = m.tree
        gain, f, code, left = tree.best[node]
        tree.feature[node], tree.code[node], tree.gain[node] = f, code, gain
        tree.left[node] = tree.add(node, left)
        tree.right[node] = tree.add(node, tree.sums[node] - left)
        return tree.left[node], tree.right[node]

    def _take_splits(self, m: _Model) -> None:
        """Take the splits that are certain, best node first, and ask for the children that the next ones need.

        Without a bound on the leaves every split is certain.  With one, a node that was
        looked at ahead has children whose gains are known; the first node in line whose
        children are not known stops the taking, unless it is the last split anyway.
        """
        tree, bound = m.tree, m.spec.num_leaves or math.inf
        line = [n for n in tree.best if n not in tree.taken and (n == 0 or tree.parent[n] in tree.taken)]
        while line and tree.leaves < bound:
            node = max(line, key=lambda n: (tree.best[n][0], -n))
            fresh = tree.feature[node] < 0
            if fresh and bound < math.inf and self._children_matter(m, node):
                break
            line.remove(node)
            tree.taken.add(node)
            tree.leaves += 1
            if fresh:
                kids = self._split(m, node)
                if bound == math.inf:
                    self._ask(m, kids)
            line += [k for k in (tree.left[node], tree.right[node]) if k in tree.best]
        if bound < math.inf and tree.leaves < bound:
            ahead = sorted((n for n in line if tree.feature[n] < 0), key=lambda n: (-tree.best[n][0], n))
            for node in ahead[: int(bound - tree.leaves)]:
                self._ask(m, self._split(m, node))

    def _children_matter(self, m: _Model, node: int) -> bool:
        """Would splitting the node leave room for another split that its children may win?"""
        return m.tree.leaves + 1 < m.spec.num_leaves and m.tree.depth[node] + 1 < m.spec.max_depth

    def _ask(self, m: _Model, kids: tuple[int, int]) -> None:
        m.wanted += [k for k in sorted(kids, key=lambda k: (m.tree.sums[k][2], k)) if self._may_split(m, k)]

    def _finish_tree(self, m: _Model) -> None:
        spec, tree = m.spec, m.tree
        g, h, c = np.array(tree.sums).T
        with np.errstate(divide="ignore", invalid="ignore"):
            if not spec.boosted:
                value = np.where(h > 0, g / h, 0.0)
            else:
                t = np.sign(g) * np.maximum(np.abs(g) - spec.reg_alpha, 0)
                value = np.where(h + spec.reg_lambda > 0, -t / (h + spec.reg_lambda), 0.0) * spec.learning_rate
        # nodes that were looked at ahead and not taken go
        kept = [n for n in range(len(tree.feature)) if n == 0 or tree.parent[n] in tree.taken]
        place = np.full(len(tree.feature) + 1, -1)
        place[kept] = np.arange(len(kept))
        feature, code, left, right = tree.arrays(tree.taken)
        inner = feature >= 0
        left, right = (np.where(inner, place[side], -1)[kept] for side in (left, right))
        feature, code, value, gain, cover = feature[kept], code[kept], value[kept], np.where(inner, tree.gain, 0.0)[kept], (c if spec.boosted else h)[kept]
        if spec.boosted:
            self.pending.setdefault(m.number, []).append((feature, code, left, right, value))
        cuts = self.thresholds[spec.view]
        threshold = [float(cuts[f][c]) if f >= 0 else 0.0 for f, c in zip(feature.tolist(), code.tolist(), strict=True)]
        m.trees.append(dict(feature=feature.tolist(), threshold=threshold, left=left.tolist(), right=right.tolist(), value=value.tolist(), cover=cover.tolist(), gain=gain.tolist(), code=code.tolist()))
        m.round += 1
        if m.round >= spec.rounds:
            m.done = True
        else:
            m.start()

    # -- results

    def forest(self, number: int) -> dict:
        """The finished model as plain data."""
        m = self.models[number]
        return dict(space="margin" if m.spec.boosted else "probability", base=m.base, n_features=m.features, trees=[{k: v for k, v in t.items() if k != "code"} for t in m.trees])

    def held_out_scores(self, spark, numbers: list[int]) -> DataFrame:
        """model, key, label, fold and score: each model's scores of the fold that it was not trained on."""
        asks = [(m.number, m.base, m.spec.view, m.spec.held_out, [] if m.spec.boosted else [_arrays(t) for t in m.trees]) for m in map(self.models.__getitem__, numbers)]
        pending = {i: self.pending[i] for i in numbers if i in self.pending}

        def run(batches):
            for batch in batches:
                for b in map(pickle.loads, batch.column(0).to_pylist()):
                    for i, base, view, fold, trees in asks:
                        held = b["fold"] == fold
                        part = dict(b, y=b["y"][held], margin={k: v[held] for k, v in b["margin"].items() if k == i}, codes=[c[held] if v == view else None for v, c in enumerate(b["codes"])])
                        yield _score_rows(b, i, fold, _output(part, i, base, view, pending, trees))

        blocks = spark.createDataFrame(self.state.map(lambda b: (bytearray(pickle.dumps(b)),)), "block binary")
        return blocks.mapInArrow(run, _SCORES)


_SCORES = f"model int, `{S.KEY}` string, label int, {FOLD} int, score double"


def _arrays(tree: dict) -> tuple:
    return (*(np.array(tree[k]) for k in ("feature", "code", "left", "right")), np.array(tree["value"]))


def _output(block: dict, model: int, base: float, view: int, pending: dict, trees: list) -> np.ndarray:
    """Probabilities: of the boosted model, or the mean of single trees."""
    if trees:
        return sum(t[4][_nodes(block["codes"][view], *t[:4])] for t in trees) / len(trees)
    return 1.0 / (1.0 + np.exp(-_margin(block, model, base, view, pending)))


def _score_rows(block: dict, model: int, fold: int, score: np.ndarray):
    import pyarrow as pa
    held = np.flatnonzero(block["fold"] == fold)
    key = block["key"].take(pa.array(held)) if isinstance(block["key"], pa.Array) else pa.array([block["key"][r] for r in held.tolist()], pa.string())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(held), model, np.int32)), key, pa.array(block["y"][held].astype(np.int32)),
                                       pa.array(np.full(len(held), fold, np.int32)), pa.array(score)], ["model", S.KEY, "label", FOLD, "score"])


class _TaskGrower(Grower):
    """Inside a task that has all rows: a step needs no job.

    What does not change while a tree grows is kept: the rows drawn and their
    derivatives, the nodes that they have reached, and the histograms of nodes whose
    children are wanted.  Of two children the smaller is counted, and the other is what
    is left of their parent; sums are exact, so that the trees are the same."""

    def __init__(self, block: dict, layouts, thresholds, counts):
        super().__init__(None, layouts, thresholds, counts, 1)
        self.block = dict(block, margin={})
        self.kept: dict[int, dict] = {}           # of each model's tree

    def _find(self, asks):
        self._refresh()
        return [_splits(a, *self._sums(a), self.layouts) for a in asks]

    def _begin(self, ask: dict) -> dict:
        """What a tree's nodes are counted from."""
        rows, g, h, loss = _derivatives(self.block, ask, {})
        return dict(rows=rows, g=g[rows], h=h[rows], loss=loss, at=np.zeros(len(rows), np.int64),
                    codes=self.block["codes"][ask["spec"].view][rows], joint=self.block["joint"][ask["spec"].view][:, rows])

    def _reach(self, ask: dict, kept: dict, family: dict) -> None:
        """Move the rows to the nodes that are asked for."""
        if len(ask["tree"][0]) > 1:
            kept["at"] = _nodes(kept["codes"], *ask["tree"], node=kept["at"])

    def _sums(self, ask: dict) -> tuple:
        kept = self.kept.get(ask["model"])
        if kept is None or kept["round"] != ask["round"]:
            kept = self.kept[ask["model"]] = dict(self._begin(ask), round=ask["round"], sums={})
        tree, nodes = ask["tree"], ask["nodes"].tolist()
        inner = np.flatnonzero(tree[0] >= 0)
        family = {kid: (parent, other) for parent, x, y in zip(inner.tolist(), tree[2][inner].tolist(), tree[3][inner].tolist(), strict=True) for kid, other in ((x, y), (y, x))}
        self._reach(ask, kept, family)
        counted, rest = [], []
        for node in nodes:
            parent, other = family.get(node, (None, None))
            (rest if other in counted and parent in kept["sums"] else counted).append(node)
        found = dict(zip(counted, self._count(ask, kept, counted), strict=True))
        for node in rest:
            parent, other = family[node]
            found[node] = kept["sums"][parent] - found[other]
        used = {family[node][0] for node in nodes if node in family}
        kept["sums"] = {**{node: sums for node, sums in kept["sums"].items() if ask["spec"].num_leaves and node not in used}, **found}
        return np.stack([found[node] for node in nodes]), kept["loss"]

    def _count(self, ask: dict, kept: dict, nodes: list[int]) -> np.ndarray:
        """As :func:`_histograms`, of one model."""
        spec, layout, n = ask["spec"], self.layouts[ask["spec"].view], len(nodes)
        place = np.full(len(ask["tree"][0]), -1)
        place[nodes] = np.arange(n)
        pos = place[kept["at"]]
        some = np.flatnonzero(pos >= 0)
        pos, g, h = pos[some], kept["g"][some], kept["h"][some]
        if not spec.boosted:
            pos = pos * 2 + (self.block["y"][kept["rows"][some]] > 0)
        found = {}
        for b, wanted in enumerate(layout.wanted(ask["features"])):
            if not wanted:
                continue
            size = math.prod(layout.bundles[b][1])
            cell = pos * size + kept["joint"][b][some]
            if spec.boosted:
                found[b] = np.stack([np.bincount(cell, w, n * size).reshape(n, size) for w in (g, h, None)], axis=1)
            else:
                found[b] = np.bincount(cell, None, 2 * n * size).reshape(n, 2, size)
        return _parted(found, layout, n, 3 if spec.boosted else 2)

    def _refresh(self) -> None:
        for i, (base, view) in self.bases.items():
            if i not in self.block["margin"] or self.pending.get(i):
                self.block["margin"][i] = _margin(self.block, i, base, view, self.pending)
        self.pending = {}


class _RowGrower(_TaskGrower):
    """One model, inside a task that has many rows.

    Rows are dealt to the nodes as the tree grows: a node has its rows' codes and
    derivatives in arrays of its own.  Bundles are counted two by two, eight codes of a
    row lie in one value of 16 bytes, and one complex sum has g, and h with the rows beside
    it, to be parted afterwards.  A finished tree moves the margins of all rows by bit masks
    of its leaves.  Sums are exact here too, so that the trees are the same."""

    def __init__(self, rows: dict, wide: np.ndarray, view: int, layouts, thresholds, counts):
        Grower.__init__(self, None, layouts, thresholds, counts, 1)
        self.block, self.wide, self.kept, self.margin = rows, wide, {}, None
        self.layout = layout = layouts[view]
        self.size = [math.prod(bins) for _, bins in layout.bundles]
        self.pairs = _pairs(layout)
        self.shape = [tuple(self.size[b] for b in pair) for pair in self.pairs]
        lanes = np.zeros((len(rows["y"]), -(-len(wide) // 8) * 8), np.uint16)
        lanes[:, : len(wide)] = wide.T
        self.lanes = [np.ascontiguousarray(lanes[:, i : i + 8]).view(np.complex128)[:, 0] for i in range(0, lanes.shape[1], 8)]
        self.home = {}                            # feature -> its pair, and its code by the pair's code
        for p, pair in enumerate(self.pairs):
            for b, joint in zip(pair, np.unravel_index(np.arange(math.prod(self.shape[p])), self.shape[p]), strict=True):
                features, bins = layout.bundles[b]
                self.home.update((f, (p, code.astype(np.uint16))) for f, code in zip(features, np.unravel_index(joint, bins), strict=True))
        # rows of nodes of even and of odd depth: a level is dealt from one to the other
        self.space = [[np.empty(rows["training"], complex) for _ in (0, *self.lanes)] for _ in range(2)]

    def _find(self, asks):
        return [_splits(a, *self._sums(a), self.layouts) for a in asks]

    def _refresh(self) -> None:
        pass

    def _begin(self, ask: dict) -> dict:
        spec, block, n = ask["spec"], self.block, self.block["training"]
        if self.margin is None:
            self.margin = np.full(len(block["y"]), ask["base"])
        # h is a quarter of a row's weight at most
        counted, loss, k = spec.boosted and not spec.temperature and max(ask["weights"]) <= 2, np.zeros(2), 0
        for a in range(0, n, DEALT):
            s = slice(a, min(n, a + DEALT))
            rows, g, h, part = _derivatives(dict(y=block["y"][s], fold=block["fold"][s], id=block["id"][s], margin={ask["model"]: self.margin[s]}), ask, {})
            loss += part
            mine = slice(k, k + len(rows))
            both = self.space[0][0][mine]
            both.real, both.imag = (g.take(rows), h.take(rows)) if spec.boosted else (block["y"][s].take(rows) > 0, 1)
            if counted:
                both.imag += ONE_ROW
            for lanes, space in zip(self.lanes, self.space[0][1:], strict=True):
                lanes[s].take(rows, out=space[mine], mode="clip")
            k += len(rows)
        return dict(counted=counted, loss=loss, depth={0: 0}, full={}, bound=spec.num_leaves, rows={0: ([x[:k] for x in self.space[0]], None, True)})

    def _rows(self, kept: dict, node: int) -> list[np.ndarray]:
        """The node's derivatives and codes; taken out of its parent's when they are needed first."""
        rows, side, way = kept["rows"][node]
        if side is not None:
            depth, n = kept["depth"][node], int(np.count_nonzero(side == way))
            k = kept["full"].get(depth, 0)
            kept["full"][depth] = k + n
            # best node first is not level by level
            out = [np.empty(n, complex) for _ in rows] if kept["bound"] else [x[k : k + n] for x in self.space[depth % 2]]
            at = 0
            for a in range(0, len(side), DEALT):
                some = np.flatnonzero(side[a : a + DEALT] == way)
                for x, to in zip(rows, out, strict=True):
                    x[a : a + DEALT].take(some, out=to[at : at + len(some)], mode="clip")
                at += len(some)
            rows = out
            kept["rows"][node] = rows, None, True
        return rows

    @staticmethod
    def _codes(rows: list[np.ndarray], p: int) -> np.ndarray:
        return rows[1 + p // 8].view(np.uint16).reshape(-1, 8)[:, p % 8]

    def _reach(self, ask: dict, kept: dict, family: dict) -> None:
        feature, code, left, right = ask["tree"]
        for node in ask["nodes"].tolist():
            if node not in kept["rows"]:
                parent, _ = family[node]
                rows = self._rows(kept, parent)
                p, codes = self.home[int(feature[parent])]
                goes, joint, side = codes <= code[parent], self._codes(rows, p), np.empty(len(rows[0]), bool)
                for a in range(0, len(side), DEALT):
                    goes.take(joint[a : a + DEALT], out=side[a : a + DEALT], mode="clip")
                for kid, way in ((int(left[parent]), True), (int(right[parent]), False)):
                    kept["rows"][kid], kept["depth"][kid] = (rows, side, way), kept["depth"][parent] + 1
                del kept["rows"][parent]

    def _count(self, ask: dict, kept: dict, nodes: list[int]) -> np.ndarray:
        spec, layout, n = ask["spec"], self.layout, len(nodes)
        kinds = 3 if spec.boosted else 2
        some, apart = layout.wanted(ask["features"]), spec.boosted and not kept["counted"]
        found = {b: np.zeros((n, kinds, self.size[b]), float if spec.boosted else np.int64) for b in range(len(some)) if some[b]}
        pairs = [(p, pair) for p, pair in enumerate(self.pairs) if any(some[b] for b in pair)]
        own: dict[int, list] = {b: [] for b in found}
        places, few = [], []
        for i, rows in enumerate(self._rows(kept, node) for node in nodes):
            if len(rows[0]) < OWN_ROWS:
                few.append((i, rows))
                continue
            for a in range(0, len(rows[0]), CHUNK):
                places.append(i)
                for p, pair in pairs:
                    sums = self._added(self._codes(rows, p)[a : a + CHUNK].astype(np.intp), rows[0][a : a + CHUNK], math.prod(self.shape[p]), apart)
                    for axis, b in enumerate(pair):
                        if some[b]:
                            own[b].append(_margin_sums(sums, self.shape[p], axis))
        if places:
            for b, sums in own.items():
                np.add.at(found[b], places, self._kinds(np.stack(sums), spec.boosted))
        while few:                                # so many at once as stay in a core's cache
            ends = np.cumsum([len(rows[0]) for _, rows in few])
            now = max(1, int(np.searchsorted(ends, 2 * DEALT, side="right")))
            at, parts = zip(*few[:now], strict=True)
            few = few[now:]
            rows = [np.concatenate(x) for x in zip(*parts, strict=True)]
            place = np.repeat(np.arange(now), [len(x[0]) for x in parts])
            for p, pair in pairs:
                joint = self._codes(rows, p)
                for b, code in zip(pair, np.divmod(joint, np.uint16(self.shape[p][1])) if len(pair) > 1 else (joint,), strict=True):
                    if some[b]:
                        sums = self._added(place * self.size[b] + code, rows[0], now * self.size[b], apart)
                        found[b][list(at)] = self._kinds(sums.reshape(now, self.size[b], -1), spec.boosted)
        return _parted(found, layout, n, kinds)

    @staticmethod
    def _added(cell: np.ndarray, both: np.ndarray, cells: int, count: bool) -> np.ndarray:
        """(cell, part): the sums by cell, and the rows apart where they do not go with h."""
        sums = np.zeros(cells, complex)
        np.add.at(sums, cell, both)
        sums = sums.view(float).reshape(-1, 2)
        return np.concatenate([sums, np.bincount(cell, None, cells)[:, None]], axis=1) if count else sums

    @staticmethod
    def _kinds(sums: np.ndarray, boosted: bool) -> np.ndarray:
        """(node, kind, cell) of (node, cell, part): the sums of CHUNK rows at most each."""
        if not boosted:
            return np.stack([sums[:, :, 1] - sums[:, :, 0], sums[:, :, 0]], axis=1).astype(np.int64)
        if sums.shape[2] == 3:
            return sums.swapaxes(1, 2)
        count = np.floor(sums[:, :, 1] / ONE_ROW)
        return np.stack([sums[:, :, 0], sums[:, :, 1] - count * ONE_ROW, count], axis=1)

    def _finish_tree(self, m: _Model) -> None:
        super()._finish_tree(m)
        self.pending.pop(m.number, None)
        del self.kept[m.number]
        tree = m.trees[-1]
        value, feature, code, left, right = (np.array(tree[k]) for k in ("value", "feature", "code", "left", "right"))
        leaves = int((feature < 0).sum())
        if leaves > 256:
            used = np.unique(feature[feature >= 0])
            place = np.where(feature >= 0, np.searchsorted(used, feature), -1)
            for a in range(0, len(self.margin), DEALT):
                codes = np.stack([self.home[f][1].take(self.wide[self.home[f][0]][a : a + DEALT]) for f in used.tolist()], axis=1)
                self.margin[a : a + DEALT] += value[_nodes(codes, place, code, left, right)]
            return
        masks, values = self._masks(tree, leaves)
        for a in range(0, len(self.margin), DEALT):
            self.margin[a : a + DEALT] += _first_leaf([(words, self.wide[p][a : a + DEALT]) for p, words in masks.items()], values)

    def _masks(self, tree: dict, leaves: int) -> tuple:
        """For each pair that the tree asks (word, code): the leaves that rows with the code may come to, as bits; and the leaves' values.

        A row that goes right at a node does not come to the leaves on its left; the
        first leaf that is left over is the row's."""
        feature, left, right, n = tree["feature"], tree["left"], tree["right"], len(tree["feature"])
        below, first = [1] * n, [0] * n
        for i in range(n - 1, -1, -1):            # children come after their parents
            if feature[i] >= 0:
                below[i] = below[left[i]] + below[right[i]]
        words = -(-leaves // 64)
        values = np.zeros(words * 64)
        by_feature: dict[int, np.ndarray] = {}
        for i in range(n):
            if feature[i] < 0:
                values[first[i]] = tree["value"][i]
                continue
            first[left[i]], first[right[i]] = first[i], first[i] + below[left[i]]
            gone = ((1 << below[left[i]]) - 1) << first[i]
            codes = by_feature.setdefault(feature[i], np.full((words, self._bins(feature[i])), 2**64 - 1, np.uint64))
            codes[:, tree["code"][i] + 1 :] &= np.array([~(gone >> 64 * w) & (2**64 - 1) for w in range(words)], np.uint64)[:, None]
        out: dict[int, np.ndarray] = {}
        for f, codes in by_feature.items():
            p, code = self.home[f]
            mine = codes.take(code, axis=1)
            out[p] = out[p] & mine if p in out else mine
        return out, values

    def _bins(self, feature: int) -> int:
        return int(self.layout.offsets[feature + 1] - self.layout.offsets[feature])

    def output(self, m: _Model) -> np.ndarray:
        """As :func:`_output`, of all rows."""
        return 1.0 / (1.0 + np.exp(-self.margin)) if m.spec.boosted else self.margin / len(m.trees)


def _first_leaf(masks: list[tuple], values: np.ndarray):
    """The value of the first leaf that no pair's mask rules out, for each row."""
    out = None if masks else values[0]
    for w in range(len(values) // 64 - 1, -1, -1) if masks else ():
        bits = None
        for words, codes in masks:
            mine = words[w].take(codes)
            bits = mine if bits is None else np.bitwise_and(bits, mine, out=bits)
        lowest = bits & (~bits + np.uint64(1))
        at = (lowest.astype(float).view(np.int64) >> 52) - 1023          # the exponent of a power of two
        if out is None:
            out = values.take(at + 64 * w, mode="clip")
        else:
            some = bits != 0
            out[some] = values.take(at.compress(some) + 64 * w)
    return out


def _margin_sums(sums: np.ndarray, shape: tuple, axis: int) -> np.ndarray:
    """(cell, part) sums over the other axis; exact in any order."""
    if len(shape) == 1:
        return sums
    parts = sums.shape[1]
    if axis == 0:
        return sums.reshape(shape[0], -1) @ np.tile(np.eye(parts), (shape[1], 1))
    return (np.ones(shape[0]) @ sums.reshape(shape[0], -1)).reshape(-1, parts)


def _grow_whole(rows: dict, spec: TreeSpec, layouts, thresholds, counts) -> tuple:
    """The trees of one model, and its scores of the rows held out (one array, in their order)."""
    many = len(rows["y"]) >= MANY_ROWS or "wide" in rows
    if many:
        wide = rows["wide"][spec.view] if "wide" in rows else _wide(rows["joint"][spec.view], layouts[spec.view])
        held = rows["fold"] == (-1 if spec.held_out is None else spec.held_out)
        order = np.argsort(held, kind="stable")               # the rows held out come last
        grow = _RowGrower({"training": int((~held).sum()), **{k: rows[k].take(order) for k in ("y", "fold", "id")}},
                          np.stack([w.take(order) for w in wide]), spec.view, layouts, thresholds, counts)
    else:
        grow = _TaskGrower(rows, layouts, thresholds, counts)
    m = grow.models[grow.add(spec)]
    grow.run()
    if spec.held_out is None:
        return m.trees, np.zeros(0)
    grow._refresh()
    if many:
        return m.trees, grow.output(m)[grow.block["training"]:]
    score = _output(grow.block, m.number, m.base, spec.view, {}, [] if spec.boosted else [_arrays(t) for t in m.trees])
    return m.trees, score[rows["fold"] == spec.held_out]


class _ModelGrower(Grower):
    """Each task grows whole models: nothing is exchanged between tasks while they grow.

    Trees and scores stay with the tasks; the driver fetches the trees that it is asked
    for.  Models are the same as by steps."""

    def __init__(self, blocks, layouts, thresholds, counts):
        super().__init__(blocks, layouts, thresholds, counts, 1)
        self.grown: dict = {}                     # model -> the RDD with its trees and scores

    def _grown(self, todo: list[_Model]):
        """An RDD of (model, its trees, its scores of the rows held out as Arrow bytes)."""
        raise NotImplementedError

    def step(self) -> list[int]:
        """Grow all active models to their end, the longest first."""
        todo = sorted(self.active, key=lambda m: -_length(m.spec))
        grown = self._grown(todo).persist(StorageLevel.MEMORY_AND_DISK)
        self.grown.update((m.number, grown) for m in todo)
        rounds = dict(grown.map(lambda r: (r[0], r[1])).collect())       # two numbers for each model
        for m in todo:
            m.done, m.round = True, rounds[m.number]
        self.active = []
        return [m.number for m in todo]

    def _of(self, numbers) -> list:
        """The RDDs that hold these models."""
        return list({self.grown[i].id(): self.grown[i] for i in numbers}.values())

    def forest(self, number: int) -> dict:
        if not self.models[number].trees:
            for i, _, trees, _ in self.grown[number].map(lambda r: (*r[:3], None)).collect():
                self.models[i].trees = pickle.loads(trees)
        return super().forest(number)

    def forget(self, numbers) -> None:
        mine = {i: self.grown.pop(i) for i in numbers if i in self.grown}
        kept = {rdd.id() for rdd in self.grown.values()}
        for rdd in mine.values():
            if rdd.id() not in kept:
                rdd.unpersist()

    def release(self) -> None:
        self.forget(list(self.grown))

    def held_out_scores(self, spark, numbers: list[int]) -> DataFrame:
        import pyarrow as pa

        def run(batches):
            for batch in batches:
                for scores in batch.column(0).to_pylist():
                    yield from pa.ipc.open_stream(scores)

        found = None
        for rdd in self._of(numbers):
            rows = spark.createDataFrame(rdd.filter(lambda r: r[0] in numbers).map(lambda r: (bytearray(r[3]),)), "scores binary")
            found = rows if found is None else found.unionAll(rows)
        return found.mapInArrow(run, _SCORES)


def _length(spec: TreeSpec) -> int:
    return spec.rounds * min(spec.max_depth, 10)


def _grown_parts(rows: dict, models: list[tuple], layouts, thresholds, counts):
    """(model, rounds, trees, scores) of models (number, spec) grown on the rows."""
    for i, spec in models:
        trees, scores = _grow_whole(rows, spec, layouts, thresholds, counts)
        yield i, len(trees), pickle.dumps(trees, -1), _ipc(_score_rows(rows, i, spec.held_out, scores)) if spec.held_out is not None else b""


def _ipc(batch) -> bytes:
    import pyarrow as pa
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


class _WholeGrower(_ModelGrower):
    """Rows that fit one block: it is broadcast, and a task grows one model.  BLOCK_ROWS rows at most."""

    def __init__(self, spark, block: dict, layouts, thresholds, counts):
        super().__init__(None, layouts, thresholds, counts)
        self.sc = spark.sparkContext
        self.shared = self.sc.broadcast((block, layouts, thresholds, counts))

    def _grown(self, todo):
        shared = self.shared
        return self.sc.parallelize([(m.number, m.spec) for m in todo], len(todo)).flatMap(lambda m: _grown_parts(shared.value[0], [m], *shared.value[1:]))

    def release(self) -> None:
        super().release()
        self.shared.unpersist()


class _HeldGrower(_ModelGrower):
    """Rows that a task can hold, and models for many tasks: each gets the rows of a view by an exchange.

    HELD_BLOCKS * BLOCK_ROWS rows at most, about 100 bytes each while a model grows."""

    def _grown(self, todo):
        views: dict[int, list] = {}
        for m in todo:
            views.setdefault(m.spec.view, []).append(m)
        most = max(1, 4 * self.state.context.defaultParallelism // len(views))
        tasks = []
        for view, mine in views.items():
            dealt: list[list] = [[] for _ in range(min(len(mine), most))]
            for m in mine:                        # the longest first, each to the task with the least to do
                min(dealt, key=lambda models: sum(_length(x.spec) for x in models)).append(m)
            tasks += [(view, [(m.number, m.spec) for m in models]) for models in dealt]
        tasks.sort(key=lambda t: -sum(_length(spec) for _, spec in t[1]))
        layouts, thresholds, counts = self.layouts, self.thresholds, self.counts

        def copies(blocks):
            for b in blocks:
                for t, (view, _) in enumerate(tasks):
                    yield t, dict(b, wide=b["wide"][view])

        def run(t: int, mine):
            import pyarrow as pa
            blocks = [b for _, b in mine]
            view, models = tasks[t]
            rows = {k: np.concatenate([b[k] for b in blocks]) for k in ("y", "fold", "id")}
            rows["key"] = pa.concat_arrays([b["key"] for b in blocks])
            rows["wide"] = {view: np.concatenate([b["wide"] for b in blocks], axis=1)}
            del blocks
            return _grown_parts(rows, models, layouts, thresholds, counts)

        return self.state.mapPartitions(copies).partitionBy(len(tasks), int).mapPartitionsWithIndex(run)

    def release(self) -> None:
        super().release()
        self.state.unpersist()


# ------------------------------------------------------------------ binned rows

def cut_points(rows: DataFrame, views: int, max_bins: int) -> list[list[np.ndarray]]:
    """For each view and feature the thresholds between bins: quantiles of the view's training rows, in one pass over (view, feature, value)."""
    def numbered(v: int):
        mine = F.when(F.col(FOLD) != v, F.col(f"x{v}")) if views > 1 else F.col(f"x{v}")     # null for the rows held out
        return F.coalesce(F.transform(mine, lambda x, i: F.struct(F.lit(v).alias("v"), i.alias("i"), x.alias("x"))), F.array())

    cells = F.concat(*[numbered(v) for v in range(views)])
    probs = [i / max_bins for i in range(1, max_bins)]
    found = (rows.select(F.explode(cells).alias("c")).groupBy("c.v", "c.i")
             .agg(F.percentile_approx("c.x", probs, 20 * max_bins).alias("q"), F.max("c.x").alias("top")).collect())   # a row for each feature of each view
    out: list[dict] = [{} for _ in range(views)]
    for r in found:
        q = np.unique(np.array(r["q"] if r["q"] is not None else [], float))
        out[r["v"]][r["i"]] = q[q < r["top"]] if len(q) else q
    return [[d[i] for i in range(len(d))] for d in out]


def grower(rows: DataFrame, views: int = 1, models: int = 1, max_bins: int = MAX_BINS, rounds: int = 1) -> Grower:
    """A grower for ``rows``: the key, label, ``fold`` (any integer column, -2 where rows have no folds) and x0, x1, ... (the views' arrays).

    With several views, view v belongs to fold v: its bins come from the other folds.
    Several models of several ``rounds`` are grown task by task where a task can hold the
    rows; a single one, or trees of one round, take few steps or have no other task to fill.
    """
    import pyarrow as pa
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    rows = rows.select(F.col(S.KEY).cast("string").alias("key"), F.col("label").cast("int").alias("label"), F.col(FOLD).cast("int").alias(FOLD),
                       F.xxhash64(S.KEY).alias("id"), *[f"x{v}" for v in range(views)]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = {(r[FOLD], r["label"]): r["count"] for r in rows.groupBy(FOLD, "label").count().collect()}
        n = sum(counts.values())
        if any(label not in (0, 1) for _, label in counts):
            raise ValueError("labels must be 0 or 1")
        cuts = cut_points(rows, views, max_bins)
        layouts = [_layout(view) for view in cuts]
        held = BLOCK_ROWS < n <= HELD_BLOCKS * BLOCK_ROWS and models > 1 and rounds > 1
        # as many blocks as there are cores, where that leaves each enough to do
        parts = 1 if n <= BLOCK_ROWS else max(2, -(-n // PART_ROWS), min(-(-n * models // BLOCK_WORK), spark.sparkContext.defaultParallelism))

        def pack(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes = []
                for v, view in enumerate(cuts):
                    x = batch.column(4 + v).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    codes.append(np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(view)], axis=1).astype(np.uint8 if max_bins <= 256 else np.uint16))
                joint = [_joint(c, view) for c, view in zip(codes, layouts, strict=True)]
                block = dict(y=batch.column(1).to_numpy(zero_copy_only=False).astype(float), fold=batch.column(2).to_numpy(zero_copy_only=False), id=batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64))
                if held:
                    block |= dict(key=batch.column(0), wide=[_wide(j, view) for j, view in zip(joint, layouts, strict=True)])
                else:
                    block |= dict(key=batch.column(0).to_pylist(), codes=codes, joint=joint, margin={})
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

        dealt = rows.repartition(parts, "id") if parts > 1 else rows.coalesce(1)
        blocks = dealt.mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(bytes(r["block"])))
        if parts == 1:
            return _WholeGrower(spark, _joined(blocks.collect()), layouts, cuts, counts)     # BLOCK_ROWS rows at most
        blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        blocks.count()
    finally:
        rows.unpersist()
    return _HeldGrower(blocks, layouts, cuts, counts) if held else Grower(blocks, layouts, cuts, counts, parts)


def _joined(blocks: list[dict]) -> dict:
    """One block out of several."""
    return dict(key=[k for b in blocks for k in b["key"]], margin={}, codes=[np.concatenate(z) for z in zip(*(b["codes"] for b in blocks), strict=True)],
                joint=[np.concatenate(z, axis=1) for z in zip(*(b["joint"] for b in blocks), strict=True)], **{k: np.concatenate([b[k] for b in blocks]) for k in ("y", "fold", "id")})


# ------------------------------------------------------------------ Spark ML stages

def forest_output(forest: dict, x: np.ndarray) -> np.ndarray:
    """Margin, or mean probability, of the rows of ``x``."""
    trees = forest["trees"]
    out = np.zeros(len(x))
    rows = np.arange(len(x))[None, :]
    for i in range(0, len(trees), 64):
        part = trees[i : i + 64]
        begins = np.cumsum([0, *(len(t["feature"]) for t in part)])
        feature, threshold, value = (np.concatenate([np.asarray(t[k], float) for t in part]) for k in ("feature", "threshold", "value"))
        feature = feature.astype(np.int64)
        left, right = (np.concatenate([np.asarray(t[k], np.int64) + b for t, b in zip(part, begins, strict=False)]) for k in ("left", "right"))
        node = np.repeat(begins[:-1][:, None], len(x), axis=1)
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                break
            node = np.where(inner, np.where(x[rows, f] <= threshold[node], left[node], right[node]), node)
        out += value[node].sum(axis=0)
    return out + forest["base"] if forest["space"] == "margin" else out / max(1, len(trees))


class HistTreesModel(Model, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """A tree or boosted trees; adds rawPrediction, probability and prediction."""

    forestJson = Param(Params._dummy(), "forestJson", "the trees as JSON", typeConverter=TypeConverters.toString)

    def __init__(self, forest: dict | None = None):
        super().__init__()
        if forest is not None:
            self._set(forestJson=json.dumps(forest))

    @property
    def forest(self) -> dict:
        return json.loads(self.getOrDefault("forestJson"))

    @property
    def featureImportances(self) -> DenseVector:
        """Split gains by feature, as shares."""
        forest = self.forest
        out = np.zeros(forest["n_features"])
        for t in forest["trees"]:
            inner = np.asarray(t["feature"]) >= 0
            np.add.at(out, np.asarray(t["feature"])[inner], np.asarray(t["gain"])[inner])
        return DenseVector(out / out.sum() if out.sum() > 0 else out)

    def _transform(self, df: DataFrame) -> DataFrame:
        forest = self.forest

        @F.pandas_udf(T.DoubleType())
        def output(x: pd.Series) -> pd.Series:
            return pd.Series(forest_output(forest, np.stack(x.to_numpy())) if len(x) else np.zeros(0))

        raw = output(vector_to_array(F.col(self.getFeaturesCol())))
        scored = df.withColumn("_raw", raw)
        if forest["space"] == "margin":
            p, raws = 1 / (1 + F.exp(-F.col("_raw"))), F.array(-F.col("_raw"), F.col("_raw"))
        else:
            p, raws = F.col("_raw"), F.array(1 - F.col("_raw"), F.col("_raw"))
        return scored.withColumns({"rawPrediction": array_to_vector(raws), "probability": array_to_vector(F.array(1 - p, p)),
                                   "prediction": (p > 0.5).cast("double")}).drop("_raw")


class HistTreesClassifier(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Grows one model of a :class:`TreeSpec`."""

    specJson = Param(Params._dummy(), "specJson", "the TreeSpec as JSON", typeConverter=TypeConverters.toString)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature at most", typeConverter=TypeConverters.toInt)

    def __init__(self, spec: TreeSpec | None = None, featuresCol: str = "features", labelCol: str = "label", maxBins: int = MAX_BINS):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, maxBins=maxBins)
        if spec is not None:
            self._set(specJson=json.dumps(spec.__dict__))

    @property
    def spec(self) -> TreeSpec:
        return TreeSpec(**json.loads(self.getOrDefault("specJson")))

    def _fit(self, df: DataFrame) -> HistTreesModel:
        rows = df.select(S.KEY, F.col(self.getLabelCol()).alias("label"), F.lit(-2).alias(FOLD), vector_to_array(F.col(self.getFeaturesCol())).alias("x0"))
        return fit_specs(rows, [replace(self.spec, view=0, held_out=None)], self.getOrDefault("maxBins"), self.getFeaturesCol())[0]


def fit_specs(rows: DataFrame, specs: list[TreeSpec], max_bins: int = MAX_BINS, features_col: str = "features") -> list[HistTreesModel]:
    """A model for each spec, grown together; ``rows`` as in :func:`grower`, with one view."""
    grow = grower(rows, 1, len(specs), max_bins, max(s.rounds for s in specs))
    try:
        numbers = [grow.add(s) for s in specs]
        grow.run()
        out = []
        for i in numbers:
            model = HistTreesModel(grow.forest(i))
            model._set(featuresCol=features_col)
            out.append(model)
        return out
    finally:
        grow.release()
