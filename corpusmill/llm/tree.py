"""Trees of unit centres over vectors, searched best bin first, and the calibration of how many bins to visit."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.vectors import lloyd, matrix

#: Children of a node, and sampled vectors below which a node stays a leaf.
BRANCH, LEAF_SAMPLE = 32, 128
#: Part of its radius by which an inner node may be nearer than its centre: 0 goes by centres only, 1 opens every
#: node that might hold the best leaf.
SLACK = 0.1
#: Nodes a row opens at once.
OPENED = 8
#: Neighbours of probes the calibration should rest on; visits where there are none at all.
LEAST_PAIRS, UNKNOWN_VISITS = 500, 8


@dataclass
class Tree:
    """Unit centre of each node; its first child and number of children (0 for a leaf); its leaf number, or -1; and
    the angle within which the centres of all leaves below lie. Node 0 is the root, children lie together."""

    centre: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray
    radius: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1


def finished(centre: list, child: list) -> Tree:
    """Tree of centres and (first child, number of children) or None of each node; children follow their parents."""
    c = np.array(centre)
    first = np.array([k[0] if k else 0 for k in child], np.int32)
    count = np.array([k[1] if k else 0 for k in child], np.int32)
    leaf = np.full(len(c), -1)
    leaf[count == 0] = np.arange((count == 0).sum())
    radius, below = np.zeros(len(c)), [[] for _ in child]
    for n in range(len(c) - 1, -1, -1):
        below[n] = [n] if not count[n] else [m for k in range(first[n], first[n] + count[n]) for m in below[k]]
        radius[n] = np.arccos(np.clip(c[below[n]] @ c[n], -1, 1).min())
    return Tree(c.astype(np.float32), first, count, leaf, radius.astype(np.float32))


def flat_tree(centres: np.ndarray, parts: list[np.ndarray | None] | None = None) -> Tree:
    """A tree with `centres` below the root, and below each of them its `parts`, where it has some."""
    centre, child = [np.zeros(centres.shape[1]), *centres], [(1, len(centres)), *[None] * len(centres)]
    for i, p in enumerate(parts or ()):
        if p is not None and len(p) > 1:
            child[1 + i] = (len(centre), len(p))
            centre += list(p)
            child += [None] * len(p)
    return finished(centre, child)


def fit_tree(x: np.ndarray, branch: int = BRANCH, least: int | None = None) -> Tree:
    """Hierarchical k-means over `x`; a node splits while it has at least twice `least` rows and its
    rows aren't all alike."""
    least = LEAF_SAMPLE if least is None else least
    centre, child, todo = [np.zeros(x.shape[1])], [None], [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop(0)
        if len(rows) < 2 * least:
            continue
        c = lloyd(x[rows], min(branch, len(rows) // least), seed=node + 1)
        at = (x[rows] @ c.T).argmax(1)
        used = np.unique(at)
        if len(used) < 2:
            continue
        child[node] = (len(centre), len(used))
        for u in used:
            todo.append((len(centre), rows[at == u]))
            centre.append(c[u])
            child.append(None)
    return finished(centre, child)


def _opened(tree: Tree, x: np.ndarray, node: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(children, similarity) of the node of each row of x, -1 and minus infinity beyond its children. Only these
    centres are compared."""
    step = np.arange(width, dtype=np.int32)
    child = np.where(step < tree.count[node][:, None], tree.first[node][:, None] + step, -1)
    used, back = np.unique(node, return_inverse=True)
    s = np.full(child.shape, -np.inf, np.float32)
    if len(used) * 4 < len(node):
        order = np.argsort(back, kind="stable")
        cut = np.r_[0, np.cumsum(np.bincount(back))]
        for k, u in enumerate(used):
            rows = order[cut[k] : cut[k + 1]]
            f, n = tree.first[u], tree.count[u]
            s[rows, :n] = x[rows] @ tree.centre[f : f + n].T
    else:
        for p in range(0, len(node), 512):
            c = child[p : p + 512]
            near = np.matmul(tree.centre[np.maximum(c, 0)], x[p : p + 512, :, None])[:, :, 0]
            s[p : p + 512] = np.where(c >= 0, near, -np.inf)
    return child, s


def best_bins(tree: Tree, x: np.ndarray, visits: int, slack: float | None = None, work: list | None = None) -> np.ndarray:
    """The first `visits` leaves of each row of `x`, best bin first; -1 where the tree has no more.

    Each row has a priority queue of open nodes: leaves by the similarity of their centre, inner nodes by that of
    the nearest place within `slack` of their radius. The best inner node is opened, which puts its children
    into the queue and compares their centres only then, until no inner node comes before the last of the
    `visits` best leaves in it. The queues of all rows lie side by side in one array; a row that knows enough
    leaves opens up to OPENED of the nodes that come before at once. `work` gets the centres compared."""
    slack = SLACK if slack is None else slack
    x = np.ascontiguousarray(x, np.float32)
    n, out = len(x), np.full((len(x), visits), -1, np.int32)
    if tree.count[0] == 0 or not n:
        out[:, :1] = 0
        return out
    value, held = np.zeros((n, 1), np.float32), np.zeros((n, 1), np.int32)
    live = np.arange(n)
    while len(live):
        inner = tree.count[held] > 0
        leaf = np.where(inner, -np.inf, value)
        last = np.partition(leaf, leaf.shape[1] - visits, axis=1)[:, -visits] if leaf.shape[1] > visits else np.full(len(live), -np.inf)
        ahead = np.where(inner & (value > np.maximum(last, -4)[:, None]), value, -np.inf)
        most = min(OPENED, ahead.shape[1])
        at = np.argpartition(-ahead, most - 1, axis=1)[:, :most]
        first = ahead.argmax(1)
        at[np.isneginf(last)] = first[np.isneginf(last), None]
        go = np.take_along_axis(ahead, at, 1) > -np.inf
        go[np.isneginf(last), 1:] = False
        done = ~go.any(1)
        if done.any():
            d, m = np.flatnonzero(done), min(visits, leaf.shape[1])
            ready = leaf[d]
            top = np.argpartition(-ready, m - 1, axis=1)[:, :m]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(ready, top, 1), axis=1, kind="stable"), 1)
            found = np.take_along_axis(ready, top, 1) > -np.inf
            out[live[d], :m] = np.where(found, tree.leaf[np.take_along_axis(held[d], top, 1)], -1)
            keep = ~done
            live, value, held, at, go = live[keep], value[keep], held[keep], at[keep], go[keep]
            if not len(live):
                break
        r, k = np.nonzero(go)
        node = held[r, at[r, k]]
        value[r, at[r, k]] = -np.inf
        width = int(tree.count[node].max())
        child, s = _opened(tree, x[live[r]], node, width)
        if work is not None:
            work.append(int((child >= 0).sum()))
        wide = (child >= 0) & (tree.count[child] > 0)
        if wide.any():
            reach = np.arccos(np.clip(s[wide], -1, 1)) - slack * tree.radius[child[wide]]
            s[wide] = np.cos(np.maximum(reach, 0))
        place = np.arange(len(r)) - np.r_[0, np.cumsum(np.bincount(r, minlength=len(live)))][r]
        more_s = np.full((len(live), int(place.max()) + 1, width), -np.inf, np.float32)
        more_n = np.zeros(more_s.shape, np.int32)
        more_s[r, place], more_n[r, place] = s, np.maximum(child, 0)
        value = np.concatenate([value, more_s.reshape(len(live), -1)], 1)
        held = np.concatenate([held, more_n.reshape(len(live), -1)], 1)
    return out


def nearest(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, similarity) of the k best rows of v (with ids ascending) for each row of q: the highest
    similarity, rounded to 6 decimals, first; at equal similarity the smaller id."""
    s = q.astype(np.float32) @ v.astype(np.float32).T
    floor = -2.0 if least is None else least - 2e-6
    i, j = np.nonzero(s >= floor)
    if s.shape[1] > k and len(i) > 4 * k * len(q):
        best = np.partition(s, s.shape[1] - k, axis=1)[:, -k] - 4e-6
        keep = s[i, j] >= best[i]
        i, j = i[keep], j[keep]
    sim = np.round(np.einsum("ij,ij->i", q[i], v[j]), 6)
    if least is not None:
        ok = sim >= least
        i, j, sim = i[ok], j[ok], sim[ok]
    order = np.lexsort((ids[j], -sim, i))
    i, j, sim = i[order], j[order], sim[order]
    start = np.r_[0, np.flatnonzero(np.diff(i)) + 1] if len(i) else np.zeros(0, int)
    rank = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
    return i[rank < k], ids[j[rank < k]], sim[rank < k]


def met_after(order: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """For each row the visits after which a leaf of `bins` (in its own order) is in `order` too; a large number if none."""
    out = np.full(len(order), 1 << 30)
    for s in range(0, len(order), 4096):
        o, b = order[s : s + 4096], bins[s : s + 4096]
        same = (o[:, :, None] == b[:, None, :]) & (b[:, None, :] >= 0)
        turn = np.maximum(np.arange(o.shape[1])[:, None], np.arange(b.shape[1])[None] if b.shape[1] > 1 else 0)
        out[s : s + 4096] = np.where(same, turn + 1, 1 << 30).min((1, 2))
    return out


def calibrate(reps: DataFrame, pool: np.ndarray, tree: Tree, k: int, least: float | None, recall: float, mutual: bool, probes: int = 1024, width: int = 24, dim: int = 64, features=None) -> int:
    """The least number of visits at which `recall` of the probes' k nearest others (of at least `least`
    similarity) are met: in the neighbour's first leaf, or, if `mutual`, in any leaf that both visit.

    The probes are the first of `pool`. Each task keeps the best k + 1 of its rows for each probe, and the first
    `width` leaves of those, so the driver gets k rows a probe. If more visits are called for than `width`, it
    is done again with more; if the neighbours are too few to go by, with more probes."""
    features = features or (lambda column: matrix(column, dim))
    width, asked = min(width, tree.leaves), pool[:probes]

    def best(batches):
        for b in batches:
            v, ids = features(b.column("vec")).astype(np.float64), np.asarray(b.column("rep"))
            o = np.argsort(ids)
            v, ids = v[o], ids[o]
            for s in range(0, len(asked), 1024):
                i, n, sim = nearest(asked[s : s + 1024], v, ids, k + 1, least)
                at, back = np.unique(np.searchsorted(ids, n), return_inverse=True)
                bins = best_bins(tree, v[at], width if mutual else 1)
                yield pa.RecordBatch.from_pydict({"q": pa.array(i + s, pa.int32()), "id": pa.array(n, pa.int64()), "sim": pa.array(sim, pa.float64()), "bins": pa.array(list(bins[back]), pa.list_(pa.int32()))})

    found = reps.select("rep", "vec").mapInArrow(best, "q int, id long, sim double, bins array<int>")
    top = found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "id"))).where((F.col("r") > 1) & (F.col("r") <= k + 1))
    top = top.select("q", "bins").toPandas()  # at most probes * k rows
    if len(top) < LEAST_PAIRS and probes < min(8192, len(pool)):
        return calibrate(reps, pool, tree, k, least, recall, mutual, probes * 8, width, dim, features)
    if not len(top):
        return min(UNKNOWN_VISITS, tree.leaves)
    q, bins = top["q"].to_numpy(), np.stack(top["bins"].to_numpy())
    used, back = np.unique(q, return_inverse=True)
    reach = width
    while True:
        need = np.sort(met_after(best_bins(tree, asked[used], reach)[back], bins))
        visits = int(need[min(len(need) - 1, math.ceil(recall * len(need)))])
        if visits <= reach:
            return visits
        if reach >= tree.leaves:
            return tree.leaves
        if mutual:
            return calibrate(reps, pool, tree, k, least, recall, mutual, probes, width * 4, dim, features)
        reach = min(reach * 4, tree.leaves)
