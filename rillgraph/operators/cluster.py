"""Clustering of one subject's weighted graph in one window. The graph that is left after forgetting is bounded by the
activity of a window; each group is one task."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _neighbours(n: int, edges: list[tuple[int, int, float]]) -> list[dict[int, float]]:
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if w > 0 and a != b:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    return near


def connected(n: int, edges: list[tuple[int, int, float]]) -> list[int]:
    """Label of each node's component: its smallest node."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b, w in edges:
        if w > 0:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return [root(i) for i in range(n)]


def modularity(n: int, edges: list[tuple[int, int, float]], labels: list[int]) -> float:
    near = _neighbours(n, edges)
    total = sum(sum(d.values()) for d in near)
    if not total:
        return 0.0
    inside: dict[int, float] = {}
    degree: dict[int, float] = {}
    for i, d in enumerate(near):
        degree[labels[i]] = degree.get(labels[i], 0.0) + sum(d.values())
        inside[labels[i]] = inside.get(labels[i], 0.0) + sum(w for j, w in d.items() if labels[j] == labels[i])
    return sum(inside[c] / total - (degree[c] / total) ** 2 for c in degree)


def louvain(n: int, edges: list[tuple[int, int, float]], vectors: np.ndarray | None = None, seed: int = 1234, **_: float) -> list[int]:
    """Communities by greedy modularity: nodes move to the best neighbouring community, communities become nodes, again."""
    rng = np.random.default_rng(seed)
    near = _neighbours(n, edges)
    loops = [0.0] * n
    member = list(range(n))
    while True:
        size = len(near)
        degree = [sum(d.values()) + 2 * loops[i] for i, d in enumerate(near)]
        total = sum(degree)
        if not total:
            break
        home, weight = list(range(size)), degree.copy()
        moved_any, moved = False, True
        while moved:
            moved = False
            for i in rng.permutation(size).tolist():
                own = home[i]
                to: dict[int, float] = {}
                for j, w in near[i].items():
                    to[home[j]] = to.get(home[j], 0.0) + w
                weight[own] -= degree[i]
                best, gain = own, to.get(own, 0.0) - weight[own] * degree[i] / total
                for c in sorted(to):
                    if (g := to[c] - weight[c] * degree[i] / total) > gain + 1e-12:
                        best, gain = c, g
                weight[best] += degree[i]
                if best != own:
                    home[i], moved, moved_any = best, True, True
        if not moved_any:
            break
        names = {c: k for k, c in enumerate(dict.fromkeys(home))}
        home = [names[c] for c in home]
        member = [home[m] for m in member]
        merged: list[dict[int, float]] = [{} for _ in names]
        inner = [0.0] * len(names)
        for i, d in enumerate(near):
            inner[home[i]] += loops[i]
            for j, w in d.items():
                if home[i] == home[j]:
                    inner[home[i]] += w / 2
                else:
                    merged[home[i]][home[j]] = merged[home[i]].get(home[j], 0.0) + w
        near, loops = merged, inner
    return member


#: Least affinity of two nodes; and nodes up to which the affinity is one matrix.
_FLOOR, _DENSE = 1e-9, 2000


def _leading_dense(n: int, edges: list[tuple[int, int, float]], k: int) -> np.ndarray:
    """The ``k`` leading eigenvectors of the normalized affinity, times the root of the inverse degree."""
    a = np.full((n, n), _FLOOR)
    for i, j, w in edges:
        a[i, j] = a[j, i] = max(w, 0.0) + _FLOOR
    np.fill_diagonal(a, 1.0)
    root = 1 / np.sqrt(a.sum(1))
    _, vec = np.linalg.eigh(a * root[:, None] * root)
    return vec[:, -k:] * root[:, None]


def _krylov(times: Callable[[np.ndarray], np.ndarray], start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values and vectors (as columns) of a symmetric operator, from a Lanczos basis of ``start``, orthogonal throughout;
    it grows until the ``k`` leading ones have converged."""
    n = len(start)
    basis, alpha, beta = np.zeros((min(n, 100), n)), [], []
    basis[0] = start / np.linalg.norm(start)
    while True:
        m = len(alpha)
        w = times(basis[m])
        alpha.append(float(w @ basis[m]))
        for _again in range(2):
            w -= (basis[: m + 1] @ w) @ basis[: m + 1]
        length = float(np.linalg.norm(w))
        m += 1
        if done := m == n or length < 1e-12:
            length = 0.0
        if done or m % 50 == 0:
            value, vec = np.linalg.eigh(np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1))
            if done or (length * np.abs(vec[-1, -k:])).max() < 1e-11:
                return value, (vec.T @ basis[:m]).T
        if m == len(basis):
            basis = np.concatenate([basis, np.zeros((min(m, n - m), n))])
        beta.append(length)
        basis[m] = w / length


def _leading(n: int, edges: list[tuple[int, int, float]], k: int) -> np.ndarray:
    """As :func:`_leading_dense`, in memory that grows with nodes and edges.

    But for the floor of the affinity the matrix falls into the components of the graph; the floor adds a product of one vector
    with itself. So the components' own eigenvectors (of large ones those that the vector reaches, by Lanczos) are found first;
    then the eigenvalues of all, which lie between the components', are the roots of one equation, and the eigenvectors follow.
    """
    member = np.array(connected(n, edges))
    weight = {(min(i, j), max(i, j)): max(w, 0.0) for i, j, w in edges if i != j}
    ends, w = np.array([*weight], int).reshape(-1, 2), np.array([*weight.values()])
    degree = 1 + _FLOOR * (n - 1) + np.bincount(ends[:, 0], w, n) + np.bincount(ends[:, 1], w, n)
    root = 1 / np.sqrt(degree)
    w = w * root[ends[:, 0]] * root[ends[:, 1]]
    own = (1 - _FLOOR) * root**2
    push = np.sqrt(_FLOOR) * root
    order, of_edge = np.argsort(member, kind="stable"), np.argsort(member[ends[:, 0]], kind="stable")
    starts = np.flatnonzero(np.r_[True, member[order][1:] != member[order][:-1], True])
    cuts = np.searchsorted(member[ends[of_edge, 0]], member[order[starts[:-1]]]).tolist() + [len(of_edge)]
    values, reach, where = [], [], []  # of every eigenvector of a component: its value, its product with ``push``, and itself
    for c, (lo, hi) in enumerate(zip(starts[:-1], starts[1:])):
        nodes, mine = order[lo:hi], of_edge[cuts[c] : cuts[c + 1]]
        i, j, e = np.searchsorted(nodes, ends[mine, 0]), np.searchsorted(nodes, ends[mine, 1]), w[mine]
        if len(nodes) <= _DENSE // 2:
            a = np.diag(own[nodes])
            a[i, j] = a[j, i] = e
            value, vec = np.linalg.eigh(a)
        else:
            times = lambda x: own[nodes] * x + np.bincount(i, e * x[j], len(x)) + np.bincount(j, e * x[i], len(x))  # noqa: B023, E731
            value, vec = _krylov(times, push[nodes], k)
        y = push[nodes] @ vec
        values += value.tolist()
        reach += y.tolist()
        where += [(nodes, vec, q) for q in range(len(value))]
    values, reach = np.array(values), np.array(reach)
    down = np.argsort(-values, kind="stable")
    group = np.cumsum(np.r_[0, (values[down][:-1] - values[down][1:]) > 1e-13])  # equal ones act as one
    pole = np.array([values[down[group == g][0]] for g in range(min(k, group[-1] + 1))])
    every = values[down[np.flatnonzero(np.r_[True, group[1:] != group[:-1]])]]
    square = np.bincount(group, reach[down] ** 2)
    found: list[tuple[float, dict[int, float]]] = []
    for g in range(len(pole)):
        mine = down[group == g]
        if square[g] > 1e-28:
            low, high = 0.0, (every[g - 1] - every[g] if g else float(square.sum()) + 1e-15)
            for _half in range(200):  # of the distance from the pole
                mid = (low + high) / 2
                low, high = (mid, high) if (square / (every[g] - every + mid)).sum() > 1 else (low, mid)
            found.append((every[g] + high, dict(zip(down.tolist(), (reach[down] / (every[g] - every[group] + high)).tolist()))))
        for x in np.linalg.qr(np.c_[reach[mine] if square[g] > 1e-28 else np.ones(len(mine)), np.eye(len(mine), k + 1)])[0].T[int(square[g] > 1e-28) :][:k]:
            found.append((every[g], dict(zip(mine.tolist(), x.tolist()))))
    found = sorted(found, key=lambda f: -f[0])[:k]
    out = np.zeros((n, len(found)))
    for col, (_value, parts) in enumerate(found):
        for at, x in parts.items():
            nodes, vec, q = where[at]
            out[nodes, col] += x * vec[:, q]
    return out / np.linalg.norm(out, axis=0) * root[:, None]


def spectral(n: int, edges: list[tuple[int, int, float]], vectors: np.ndarray | None = None, clusters: int = 8, seed: int = 1234, **_: float) -> list[int]:
    """k-means on the leading eigenvectors of the normalized affinity; fewer than three nodes are one cluster."""
    if n < 3:
        return [0] * n
    k = min(max(2, int(clusters)), n)
    x = _leading(n, edges, k) if n > _DENSE else _leading_dense(n, edges, k)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    centre = x[[int(rng.integers(n))]]
    while len(centre) < k:  # far points first
        far = ((x[:, None] - centre) ** 2).sum(2).min(1)
        centre = np.vstack([centre, x[int(far.argmax())]])
    label = np.zeros(n, int)
    for _round in range(50):
        new = ((x[:, None] - centre) ** 2).sum(2).argmin(1)
        if (new == label).all() and _round:
            break
        label = new
        centre = np.array([x[label == c].mean(0) if (label == c).any() else centre[c] for c in range(k)])
    return label.tolist()


#: Rows whose similarities are looked at together, and pairs that are measured together.
_ROWS, _PAIRS = 256, 10_000


def hierarchical(n: int, edges: list[tuple[int, int, float]], vectors: np.ndarray | None = None, distance: float = 0.5, **_: float) -> list[int]:
    """Average linkage on cosine distances of the node vectors, cut at ``distance``; edge weights do not matter.

    The mean distance of two clusters follows from the sums of their unit vectors, and it is within ``distance`` only if some
    pair of their nodes is. So only such pairs are kept, not all: memory grows with them and with the vectors. Of equal
    distances (to nine places) the pair with the smallest first nodes comes first.
    """
    if n < 2 or vectors is None:
        return [0] * n
    sums = np.asarray(vectors, float)
    sums = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    quick, size, version = sums.astype("float32"), np.ones(n, int), [0] * n
    near: list[set[int]] = [set() for _ in range(n)]
    waiting: list[tuple[float, int, int, int, int]] = []
    for lo in range(0, n, _ROWS):
        a, b = np.nonzero(quick[lo : lo + _ROWS] @ quick[lo:].T >= 1 - distance - 1e-4)
        a, b = a[a < b] + lo, b[a < b] + lo
        for k in range(0, len(a), _PAIRS):
            i, j = a[k : k + _PAIRS], b[k : k + _PAIRS]
            for x, y, d in zip(i.tolist(), j.tolist(), np.round(1 - np.einsum("ij,ij->i", sums[i], sums[j]), 9).tolist()):
                near[x].add(y)
                near[y].add(x)
                if d <= distance:
                    waiting.append((d, x, y, 0, 0))
    heapq.heapify(waiting)
    label = list(range(n))  # of a node: the node that its cluster was merged into
    while waiting:
        _d, i, j, *seen = heapq.heappop(waiting)
        if seen != [version[i], version[j]]:
            continue
        label[j], version[i], version[j] = i, version[i] + 1, -1
        sums[i] += sums[j]
        size[i] += size[j]
        for x in near[j]:
            near[x].discard(j)
            near[x].add(i)
        near[i] = (near[i] | near[j]) - {i, j}
        near[j] = set()
        others = np.fromiter(near[i], int, len(near[i]))
        for k in range(0, len(others), _PAIRS):
            some = others[k : k + _PAIRS]
            far = np.round(1 - sums[some] @ sums[i] / (size[some] * size[i]), 9)
            for x, d in zip(some[far <= distance].tolist(), far[far <= distance].tolist()):
                lo, hi = min(i, x), max(i, x)
                heapq.heappush(waiting, (d, lo, hi, version[lo], version[hi]))
    for x in range(n):
        label[x] = label[label[x]]  # a cluster is merged into one with a smaller first node
    names = {c: k for k, c in enumerate(dict.fromkeys(label))}
    return [names[c] for c in label]


METHODS: dict[str, Callable[..., list[int]]] = {"louvain": louvain, "spectral": spectral, "hcluster": hierarchical, "components": lambda n, e, v=None, **_: connected(n, e)}


def clusters_of(method: str, n: int, edges: list[tuple[int, int, float]], vectors: np.ndarray | None = None, **options: float) -> list[list[int]]:
    """Sorted clusters, by their first node. Without any positive edge each node is alone."""
    if method not in METHODS:
        raise ValueError(f"unknown clustering: {method!r}")
    labels = METHODS[method](n, edges, vectors, **options) if method == "hcluster" or any(w > 0 for *_, w in edges) else list(range(n))
    found: dict[int, list[int]] = {}
    for i, c in enumerate(labels):
        found.setdefault(c, []).append(i)
    return sorted(found.values())


def cluster_graphs(nodes: DataFrame, pairs: DataFrame, method: str = "louvain", by: str = "subject_idx", **options: float) -> DataFrame:
    """``(by, node, cluster)``: clusters of each group's graph, numbered by their smallest node. ``nodes`` has ``(by, node)``
    and, for ``hcluster``, ``vector``; ``pairs`` has ``(by, a, b, weight)``."""
    kind, node_kind = dict(nodes.dtypes)[by], dict(nodes.dtypes)["node"]
    if method not in METHODS:
        raise ValueError(f"unknown clustering: {method!r}")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.drop_duplicates("node").sort_values("node").reset_index(drop=True)
        place = {x: i for i, x in enumerate(left["node"])}
        right = right.sort_values(["a", "b"])
        edges = [(place[a], place[b], float(w)) for a, b, w in zip(right["a"], right["b"], right["weight"]) if a in place and b in place]
        vectors = np.stack(left["vector"].to_list()) if "vector" in left and len(left) else None
        rows = [(key[0], left["node"][i], c) for c, group in enumerate(clusters_of(method, len(left), edges, vectors, **options)) for i in group]
        return pd.DataFrame(rows, columns=[by, "node", "cluster"])

    return nodes.groupBy(by).cogroup(pairs.withColumnRenamed(by, "__by").groupBy("__by")).applyInPandas(run, f"{by} {kind}, node {node_kind}, cluster long")
