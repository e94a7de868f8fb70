"""Density clustering of one channel's vectors: numpy over a group of bounded size.

The hierarchy needs all mutual reachabilities of a channel, so a channel is one group; MAX_POINTS bounds its memory, and
a larger group is an error instead of a silent sample.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MAX_POINTS = 20_000
LEAST_QUALITY = 0.05
SILHOUETTE_SAMPLE = 2000


@dataclass(frozen=True)
class Parameters:
    min_cluster_size: int = 3
    min_samples: int = 3
    method: str = "eom"
    epsilon: float = 0.5


@dataclass(frozen=True)
class MergeGates:
    centroid: float = 0.92
    cross_mean: float = 0.84
    member_min: float = 0.92


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; zero and non-finite rows are an error."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    if not np.isfinite(x).all() or (n == 0).any():
        raise ValueError("vectors must be finite and not zero")
    return x / n


def project(x: np.ndarray, dimension: int | None) -> np.ndarray:
    """Centred principal components, at most n - 1 and d, with rows scaled to length one; tiny rows stay."""
    target = min(dimension or x.shape[1], len(x) - 1, x.shape[1])
    if target < x.shape[1]:
        centred = x - x.mean(axis=0)
        u, s, vt = np.linalg.svd(centred, full_matrices=False)
        # The largest loading of each component is made positive, so that signs do not depend on the solver.
        sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])
        x = (u * s * sign)[:, :target]
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > np.finfo(np.float32).eps, n, 1.0)


def _distances(x: np.ndarray) -> np.ndarray:
    sq = (x**2).sum(axis=1)
    d = np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    return d


def spanning_tree(reach: np.ndarray) -> np.ndarray:
    """Edges (a, b, weight) of the minimum spanning tree, by weight. Equal weights go by the smaller, then the larger end.

    Mutual reachabilities are often equal, and trees of another order would give other clusters: this order makes it one.
    """
    n = len(reach)
    best, low, high = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, int)
    free, every = np.ones(n, bool), np.arange(n)
    at, out = 0, []
    for _ in range(n - 1):
        free[at] = False
        a, b, w = np.minimum(every, at), np.maximum(every, at), reach[at]
        closer = free & ((w < best) | ((w == best) & ((a < low) | ((a == low) & (b < high)))))
        best[closer], low[closer], high[closer] = w[closer], a[closer], b[closer]
        least = np.flatnonzero(free & (best == best[free].min()))
        at = int(least[np.lexsort((high[least], low[least]))[0]])
        out.append((low[at], high[at], best[at]))
    tree = np.array(out).reshape(-1, 3)
    return tree[np.lexsort((tree[:, 1], tree[:, 0], tree[:, 2]))]


def _dendrogram(tree: np.ndarray, n: int) -> tuple[list[tuple[int, int]], list[float], list[int]]:
    top = list(range(n))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    children, height, size = [], [], [1] * n
    for a, b, w in tree:
        x, y = find(int(a)), find(int(b))
        new = n + len(children)
        top.append(new)
        top[x] = top[y] = new
        children.append((x, y))
        height.append(float(w))
        size.append(size[x] + size[y])
    return children, height, size


def condensed(tree: np.ndarray, n: int, least: int) -> list[tuple[int, int, float, int]]:
    """(parent, child, lambda, size): the hierarchy in which groups under `least` fall out as points; clusters from n up."""
    children, height, size = _dendrogram(tree, n)

    def points(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            x = todo.pop()
            if x < n:
                out.append(x)
            else:
                todo.extend(children[x - n])
        return out

    rows, next_id = [], n + 1
    todo = deque([(2 * n - 2, n)])
    while todo:
        node, own = todo.popleft()
        lam = 1 / height[node - n] if height[node - n] > 0 else np.inf
        sides = children[node - n]
        large = [s for s in sides if size[s] >= least]
        for s in sides:
            if len(large) == 2:
                rows.append((own, next_id, lam, size[s]))
                todo.append((s, next_id)) if s >= n else rows.append((next_id, s, lam, 1))
                next_id += 1
            elif s in large:
                todo.append((s, own)) if s >= n else rows.append((own, s, lam, 1))
            else:
                rows.extend((own, p, lam, 1) for p in points(s))
    return rows


def select(rows: list[tuple[int, int, float, int]], n: int, method: str, epsilon: float) -> list[int]:
    """The chosen clusters; the root is never one. Parents have smaller numbers than their children, so that each step is one
    pass over the clusters, however deep they are."""
    parent = {c: p for p, c, _, _ in rows if c >= n}
    birth = {c: lam for _, c, lam, _ in rows if c >= n} | {n: 0.0}
    below: dict[int, list[int]] = {}
    for c, p in parent.items():
        below.setdefault(p, []).append(c)
    downward = sorted(parent)

    def topmost(some: set[int]) -> set[int]:
        """Those without one of `some` above them."""
        out, covered = set(), set()
        for c in downward:
            if parent[c] in covered:
                covered.add(c)
            elif c in some:
                out.add(c)
                covered.add(c)
        return out

    if method == "leaf":
        chosen = {c for c in parent if c not in below}
    else:
        stability = dict.fromkeys(birth, 0.0)
        for p, _, lam, size in rows:
            gain = lam - birth[p] if np.isfinite(lam) or np.isfinite(birth[p]) else 0.0
            stability[p] += gain * size
        kept = set(parent)
        for c in reversed(downward):
            inner = sum(stability[x] for x in below.get(c, ()))
            if c in below and inner > stability[c]:
                kept.discard(c)
                stability[c] = inner
        chosen = topmost(kept)
    if epsilon > 0:
        # Clusters split off below epsilon give way to the first ancestor that did not.
        up: dict[int, int] = {}
        for c in downward:
            up[c] = up[parent[c]] if birth[c] > 0 and 1 / birth[c] < epsilon and parent[c] != n else c
        chosen = topmost({up[c] for c in chosen})
    return sorted(chosen)


def cluster(x: np.ndarray, p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, probabilities, spanning tree) of rows of x; -1 is noise."""
    n = len(x)
    if n > MAX_POINTS:
        raise ValueError(f"a group of {n} points exceeds {MAX_POINTS}")
    labels, probability = np.full(n, -1), np.zeros(n)
    if n < 2:
        return labels, probability, np.zeros((0, 3))
    d = _distances(x)
    core = np.partition(d, min(p.min_samples, n - 1), axis=1)[:, min(p.min_samples, n - 1)]
    tree = spanning_tree(np.maximum(d, np.maximum(core[:, None], core[None, :])))
    return *labels_of(tree, n, p), tree


def labels_of(tree: np.ndarray, n: int, p: Parameters) -> tuple[np.ndarray, np.ndarray]:
    """(labels, probabilities) of n points by their minimum spanning tree, whose edges are in the order of their weights."""
    labels, probability = np.full(n, -1), np.zeros(n)
    if n < 2:
        return labels, probability
    rows = condensed(tree, n, p.min_cluster_size)
    chosen = select(rows, n, p.method, p.epsilon)
    number = {c: i for i, c in enumerate(chosen)}
    parent = {c: q for q, c, _, _ in rows if c >= n}
    top: dict[int, float] = {}
    for q, _, lam, _ in rows:
        top[q] = max(top.get(q, 0.0), lam)
    # The chosen cluster that each is or lies in, by parents first.
    inside: dict[int, int] = {}
    for c in sorted(parent):
        if c in number or parent[c] in inside:
            inside[c] = c if c in number else inside[parent[c]]
    for q, c, lam, _ in rows:
        if c >= n:
            continue
        if q in inside:
            q = inside[q]
            labels[c] = number[q]
            most = top[q]
            probability[c] = 1.0 if most == 0 or not np.isfinite(lam) or not np.isfinite(most) else min(lam, most) / most
    return labels, probability


def relative_validity(labels: np.ndarray, tree: np.ndarray) -> float:
    """Density separation against sparseness along the spanning tree, weighted by cluster size over all points."""
    k = labels.max() + 1
    sparse, apart = np.zeros(k), np.full(k, np.inf)
    for a, b, w in tree:
        x, y = labels[int(a)], labels[int(b)]
        if x < 0 or y < 0:
            continue
        if x == y:
            sparse[x] = max(sparse[x], w)
        else:
            apart[x], apart[y] = min(apart[x], w), min(apart[y], w)
    apart[np.isinf(apart)] = 2 * (tree[:, 2].max() if k > 1 else 1)
    most = np.maximum(apart, sparse)
    v = np.where(most > 0, (apart - sparse) / np.where(most > 0, most, 1), 0)
    return float((np.bincount(labels[labels >= 0], minlength=k) * v).sum() / len(labels))


def silhouette(x: np.ndarray, labels: np.ndarray, sample: int = SILHOUETTE_SAMPLE) -> float:
    if len(x) > sample:
        pick = np.random.RandomState(0).permutation(len(x))[:sample]
        x, labels = x[pick], labels[pick]
    kinds, code = np.unique(labels, return_inverse=True)
    if len(kinds) < 2:
        return -1.0
    d = _distances(x)
    sums = np.stack([d[:, code == k].sum(axis=1) for k in range(len(kinds))], axis=1)
    sizes = np.bincount(code)
    own = sums[np.arange(len(x)), code] / np.maximum(sizes[code] - 1, 1)
    mean = sums / sizes
    mean[np.arange(len(x)), code] = np.inf
    other = mean.min(axis=1)
    s = np.where(sizes[code] > 1, (other - own) / np.maximum(np.maximum(other, own), 1e-300), 0)
    return float(s.mean())


def quality(x: np.ndarray, labels: np.ndarray, tree: np.ndarray, p: Parameters) -> float:
    """Separation, less penalties for low coverage and for fragments; -1 where it cannot be told."""
    inside = labels >= 0
    k, n = len(set(labels[inside].tolist())), int(inside.sum())
    if k < 2 or n <= k:
        return -1.0
    value = 0.65 * relative_validity(labels, tree) + 0.35 * silhouette(x[inside], labels[inside])
    value -= 0.15 * max(0.0, 0.5 - n / len(labels)) + 0.10 * min(1.0, k * p.min_cluster_size / n)
    return value if np.isfinite(value) else -1.0


def run(x: np.ndarray, dimension: int | None = 8, parameters: Parameters | None = None, optimise: bool = False):
    """(labels, probabilities, projected vectors, quality): optimising compares eom with leaf and rejects weak results."""
    base = parameters or Parameters()
    x = unit_rows(np.asarray(x, np.float64))
    if len(x) == 1:
        return np.array([-1]), np.zeros(1), x, -1.0
    y = project(x, dimension)
    tried = [base]
    if optimise:
        tried.append(Parameters(base.min_cluster_size, base.min_samples, "leaf" if base.method == "eom" else "eom", base.epsilon))
    best = None
    for p in tried:
        labels, probability, tree = cluster(y, p)
        q = quality(y, labels, tree, p)
        if best is None or q > best[3]:
            best = (labels, probability, y, q)
    if optimise and best[3] < LEAST_QUALITY:
        return np.full(len(x), -1), np.zeros(len(x)), y, best[3]
    return best


def merge_similar(x: np.ndarray, labels: np.ndarray, gates: MergeGates = MergeGates()) -> np.ndarray:
    """labels after joining, one pair a round, mutually nearest clusters that pass all gates; noise stays.

    Cosines are of the original unit vectors. Centroids are computed anew after a merge, so that chains do not collapse.
    """
    x, labels = unit_rows(np.asarray(x, np.float64)), np.asarray(labels).copy()
    while len(names := sorted(set(labels.tolist()) - {-1})) > 1:
        mean = np.stack([x[labels == c].mean(axis=0) for c in names])
        center = unit_rows(mean)
        cos = center @ center.T
        np.fill_diagonal(cos, -np.inf)
        nearest = cos.argmax(axis=1)
        passed = []
        for i, j in enumerate(nearest.tolist()):
            if i >= j or nearest[j] != i or cos[i, j] < gates.centroid or (cross := mean[i] @ mean[j]) < gates.cross_mean:
                continue
            both = x[(labels == names[i]) | (labels == names[j])]
            middle = both.mean(axis=0)
            least = (both @ (middle / np.linalg.norm(middle))).min()
            if least >= gates.member_min:
                passed.append((-cos[i, j], -cross, -least, i, j))
        if not passed:
            break
        *_, i, j = min(passed)
        labels[labels == names[j]] = names[i]
    return labels


def medoid(x: np.ndarray) -> int:
    return int(_distances(x).sum(axis=1).argmin())


def choose(center, near, size, away, assets, sources, probability, limit: int = 10, edges: int = 2, per_source: int = 2) -> list[tuple[int, str]]:
    """(position, role) of a cluster's representatives, by rank. near: the other members by distance, then asset."""
    count = min(limit, size)
    n_edge = min(edges, max(0, count - 5))
    used = {sources[center]: 1}

    def take(order, most):
        got = []
        for i in order:
            if len(got) >= most:
                break
            if used.get(sources[i], 0) < per_source:
                used[sources[i]] = used.get(sources[i], 0) + 1
                got.append(i)
        return got

    core = [int(center), *take(near, count - n_edge - 1)]
    edge = take(sorted((i for i in near if i not in core), key=lambda i: (probability[i], away[i], assets[i])), n_edge)
    core += take((i for i in near if i not in core and i not in edge), count - len(core) - len(edge))
    return [(i, "medoid" if rank == 0 else "edge" if i in edge else "core") for rank, i in enumerate([*core, *edge])]


def representatives(x, labels, assets, sources, probability, limit: int = 10, edges: int = 2, per_source: int = 2):
    """(label, rank, position, role, distance): medoid, nearest members, then the least certain ones, few of a source."""
    out = []
    for label in sorted(set(labels.tolist()) - {-1}):
        own = np.flatnonzero(labels == label)
        center = own[medoid(x[own])]
        away = np.linalg.norm(x - x[center], axis=1)
        near = sorted((i for i in own.tolist() if i != center), key=lambda i: (away[i], assets[i]))
        chosen = choose(center, near, len(own), away, assets, sources, probability, limit, edges, per_source)
        out += [(label, rank, i, role, float(away[i])) for rank, (i, role) in enumerate(chosen)]
    return out


SCHEMA = (
    "workspace_id string, embedding_type string, asset_id string, label int, merged_label int, probability double, "
    "distance double, role string, rank int"
)


def cluster_runs(vectors: DataFrame, dimension: int | None = 8, parameters: Parameters | None = None, gates: MergeGates = MergeGates(), optimise: bool = False) -> DataFrame:
    """One run for each (workspace_id, embedding_type) of vectors(.., asset_id, source_file_id, embedding).

    Membership rows: the raw label, the label after merging (null for noise), probability, distance to the medoid, and
    role and rank of representatives.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("asset_id", kind="stable").reset_index(drop=True)
        x = np.stack([np.asarray(v, np.float64) for v in pdf["embedding"]])
        labels, probability, y, _ = run(x, dimension, parameters, optimise)
        merged = merge_similar(x, labels, gates)
        reps = representatives(y, merged, pdf["asset_id"].tolist(), pdf["source_file_id"].tolist(), probability)
        center = {label: i for label, rank, i, _, _ in reps if rank == 0}
        role = {i: (r, k) for _, k, i, r, _ in reps}
        away = [float(np.linalg.norm(y[i] - y[center[c]])) if c >= 0 else None for i, c in enumerate(merged.tolist())]
        return pd.DataFrame(
            {
                "workspace_id": pdf["workspace_id"],
                "embedding_type": pdf["embedding_type"],
                "asset_id": pdf["asset_id"],
                "label": labels.astype("int32"),
                "merged_label": pd.array([None if c < 0 else c for c in merged.tolist()], "Int32"),
                "probability": probability,
                "distance": away,
                "role": [role.get(i, (None, None))[0] for i in range(len(pdf))],
                "rank": pd.array([role.get(i, (None, None))[1] for i in range(len(pdf))], "Int32"),
            }
        )

    columns = ["workspace_id", "embedding_type", "asset_id", "source_file_id", "embedding"]
    return vectors.select(*columns).groupBy("workspace_id", "embedding_type").applyInPandas(one, SCHEMA)
