"""The stream graph with merging: a phrase stands for the entity that has it already, else for the nearest one, else for a new
one, in the order of the stream. The result depends on that order, so each subject is one ordered fold; everything before it
(windows, subjects, triples) and after it (sinks) is not.

The fold works on columns, a stretch of triples at a time. Phrases that are known are looked up together. Only phrases that no
living entity has yet, once each, are settled one after another, on similarities that one matrix product gives; a product is
made again only for an entity that moved. Mentions, relations, scores, weights and descriptions are array operations.

The fold holds one subject's living entities; forgetting keeps them to what is bursty now.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from rillgraph.config import Options
from rillgraph.operators.cluster import clusters_of

Embed = Callable[[str], np.ndarray]
_TOGETHER = 512  # unknown phrases that are settled on one product
_BLOCK = 256  # vectors whose distances to all centres are estimated by one product


def unit(v: np.ndarray) -> np.ndarray:
    length = float(np.linalg.norm(v))
    return v / length if length > 0 else v


def _units(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def burst_scores(entity: np.ndarray, times: np.ndarray, n: int, now: float, seconds: float, wmin: float, wmax: float) -> np.ndarray:
    """The closed form of :mod:`rillgraph.operators.burst` for ``n`` entities, from the entity and time of every mention."""
    count = np.bincount(entity, minlength=n)
    first = np.full(n, np.inf)
    np.minimum.at(first, entity, times)
    m = np.maximum(1, np.ceil((now - np.where(count > 0, first, now)) / seconds))
    place = np.clip(np.floor((times - first[entity]) / seconds), 0, m[entity] - 1)
    x = (wmax - wmin) * np.bincount(entity, place, n) / np.maximum(m - 1, 1)
    score = np.where(m <= 1, 1.0, (count * wmin + x) / np.where(m > 1, np.maximum(count * wmax - x, 1e-300), 1))
    return np.where(count > 0, score, 0.0)


class Phrases:
    """Living entities of one kind, as columns: a sum of the vectors of their forms and that at unit length; and their mentions."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold
        self.form_of: dict[str, int] = {}  # of the forms of living entities
        self.forms: list[str] = []
        self.owner = np.empty(0, "int64")  # the entity of each form, -1 once forgotten
        self.sums = self.place = np.zeros((0, 0), "float32")
        self.m_entity, self.m_form, self.m_pid = (np.empty(0, "int64") for _ in range(3))
        self.m_time = np.empty(0)

    def __len__(self) -> int:
        return len(self.sums)

    def mention(self, phrases: Sequence[str], times: np.ndarray, pids: np.ndarray, vector: Embed) -> np.ndarray:
        """The entity of each phrase, in order; -1 for empty ones. New forms move their entity; a first form counts twice."""
        names = list(dict.fromkeys(phrases))
        unknown = [p for p in names if p and p not in self.form_of]
        for lo in range(0, len(unknown), _TOGETHER):
            self._settle(unknown[lo : lo + _TOGETHER], vector)
        at = dict(zip(names, range(len(names))))
        known = np.array([self.form_of.get(p, -1) for p in names], "int64")
        form = known[[at[p] for p in phrases]] if len(phrases) else np.empty(0, "int64")
        real = form >= 0
        entity = np.where(real, self.owner[form], -1) if len(self.owner) else form
        for name, more in (("m_entity", entity), ("m_form", form), ("m_time", times), ("m_pid", pids)):
            setattr(self, name, np.concatenate([getattr(self, name), np.asarray(more)[real]]))
        return entity

    def _settle(self, unknown: list[str], vector: Embed) -> None:
        v = np.stack([vector(p) for p in unknown]).astype("float32")
        n, m = len(self), len(unknown)
        grow = lambda x: np.concatenate([x if len(x) else np.zeros((0, v.shape[1]), "float32"), np.zeros((m, v.shape[1]), "float32")])
        sums, place = grow(self.sums), grow(self.place)
        alike = np.empty((m, n + m), "float32")  # a row for each phrase: its nearest entity is looked for in one stretch of memory
        alike[:, :n] = (place[:n] @ v.T).T
        owner = np.empty(m, "int64")
        for i in range(m):
            best = int(alike[i, :n].argmax()) if n else -1
            if best < 0 or 1.0 - float(alike[i, best]) >= self.threshold:
                best, n = n, n + 1
                sums[best] = place[best] = v[i]
            sums[best] += v[i]
            if np.linalg.norm(sums[best]) > 0:
                place[best] = unit(sums[best])
            alike[i + 1 :, best] = v[i + 1 :] @ place[best]
            owner[i] = best
        self.sums, self.place = sums[:n], place[:n]
        self.form_of |= zip(unknown, range(len(self.forms), len(self.forms) + m))
        self.forms += unknown
        self.owner = np.concatenate([self.owner, owner])

    def scores(self, now: float, o: Options) -> np.ndarray:
        return burst_scores(self.m_entity, self.m_time, len(self), now, o.ts_seconds, o.weight_min, o.weight_max)

    def forget(self, alive: np.ndarray) -> np.ndarray:
        """Keep what is ``alive``; the new number of every old entity, -1 for those that are gone."""
        new = np.where(alive, np.cumsum(alive) - 1, -1)
        kept = self.owner >= 0
        kept[kept] = alive[self.owner[kept]]
        renamed = np.where(kept, np.cumsum(kept) - 1, -1)
        self.forms = [p for p, k in zip(self.forms, kept) if k]
        self.form_of = dict(zip(self.forms, range(len(self.forms))))
        self.owner = new[self.owner[kept]]
        self.sums, self.place = self.sums[alive], self.place[alive]
        stay = alive[self.m_entity]
        self.m_entity, self.m_form, self.m_time, self.m_pid = new[self.m_entity[stay]], renamed[self.m_form[stay]], self.m_time[stay], self.m_pid[stay]
        return new

    def titles(self) -> list[str]:
        """The commonest form of every entity, the one mentioned first among equals."""
        count = np.bincount(self.m_form, minlength=len(self.forms))
        first = np.full(len(self.forms), len(self.m_form))
        np.minimum.at(first, self.m_form, np.arange(len(self.m_form)))
        order = np.lexsort((first, -count, self.owner))
        head = np.flatnonzero(np.r_[True, self.owner[order][1:] != self.owner[order][:-1]]) if len(order) else []
        return [self.forms[f] for f in order[head]]


class SubjectFold:
    """What one subject's graph is after the stream so far."""

    def __init__(self, options: Options) -> None:
        self.options = options
        self.nodes, self.edges = Phrases(options.t_n), Phrases(options.t_e)
        self.relations = np.empty((0, 3), "int64")  # head, relation phrase, tail

    def take(self, heads: Sequence[str], relations: Sequence[str], tails: Sequence[str], times: np.ndarray, pids: np.ndarray, vector: Embed) -> int:
        """Merge the triples of a stretch of the stream, head before tail; the number of relations added."""
        both = [p for pair in zip(heads, tails) for p in pair]
        ends = self.nodes.mention(both, np.repeat(times, 2), np.repeat(pids, 2), vector).reshape(-1, 2)
        by = self.edges.mention(relations, times, pids, vector)
        real = (ends >= 0).all(1) & (by >= 0) & (ends[:, 0] != ends[:, 1])
        self.relations = np.concatenate([self.relations, np.stack([ends[:, 0], by, ends[:, 1]], 1)[real]])
        return int(real.sum())

    def end_window(self, ordinal: int, now: float, raw: Embed) -> list[dict]:
        """Score, forget, detect: the events of a window, the highest score first."""
        o = self.options
        if not len(self.nodes):
            return []
        node_scores, edge_scores = self.nodes.scores(now, o), self.edges.scores(now, o)
        if ordinal % max(1, o.forget_every) == 0:
            alive = node_scores >= o.t_d, edge_scores >= o.t_d
            self.keep(*alive)
            node_scores, edge_scores = node_scores[alive[0]], edge_scores[alive[1]]
        return self.events(node_scores, edge_scores, raw) if len(self.nodes) else []

    def keep(self, nodes: np.ndarray, edges: np.ndarray) -> None:
        """Forget all other entities, and relations that lose one."""
        new = self.nodes.forget(nodes), self.edges.forget(edges)
        r = np.stack([new[k][self.relations[:, c]] for c, k in enumerate((0, 1, 0))], 1)
        self.relations = r[(r >= 0).all(1)]

    def weights(self, edge_scores: np.ndarray) -> list[tuple[int, int, float]]:
        """Of each pair of nodes the best score of its relation phrases, 0 at least, in the order of first relations."""
        low, high = self.relations[:, [0, 2]].min(1), self.relations[:, [0, 2]].max(1)
        pair, first, of = np.unique(low * (len(self.nodes) + 1) + high, return_index=True, return_inverse=True)
        best = np.zeros(len(pair))
        np.maximum.at(best, of, edge_scores[self.relations[:, 1]])
        return [(int(low[first[k]]), int(high[first[k]]), float(best[k])) for k in np.argsort(first)]

    def events(self, node_scores: np.ndarray, edge_scores: np.ndarray, raw: Embed) -> list[dict]:
        """Clusters of enough nodes, described."""
        o = self.options
        extra = {"seed": o.seed} if o.clustering != "hcluster" else {"distance": o.hcluster_distance}
        if o.clustering == "spectral":
            extra["clusters"] = o.spectral_clusters
        groups = clusters_of(o.clustering, len(self.nodes), self.weights(edge_scores), self.nodes.place, **extra)
        groups = [np.array(g) for g in groups if len(g) >= o.min_event_size]
        cluster = np.full(len(self.nodes), -1)
        for k, g in enumerate(groups):
            cluster[g] = k
        titles, count = (self.nodes.titles(), self.edges.titles()), np.bincount(self.nodes.m_entity, minlength=len(self.nodes))
        inner = np.where(cluster[self.relations[:, 0]] == cluster[self.relations[:, 2]], cluster[self.relations[:, 0]], -1)
        found = [self._described(g, self.relations[inner == k], self.nodes.m_pid[cluster[self.nodes.m_entity] == k], titles, count, node_scores, raw) for k, g in enumerate(groups)]
        return sorted(found, key=lambda e: -e["score"])

    def _described(self, group: np.ndarray, rows: np.ndarray, pids: np.ndarray, titles: tuple[list[str], list[str]], count: np.ndarray, scores: np.ndarray, raw: Embed) -> dict:
        k, (names, links) = self.options.titles_per_event, titles
        near = _units(self.nodes.place[rows[:, 0]] + self.edges.place[rows[:, 1]] + self.nodes.place[rows[:, 2]]) @ unit(self.nodes.place[group].mean(0)) if len(rows) else np.empty(0)
        picked = rows[np.argsort(-near, kind="stable")[:k]].tolist()
        forms = [[x for x in (names[a], links[e], names[b]) if x] for a, e, b in picked]
        members = forms[0] if forms else [names[i] for i in group[:k].tolist() if names[i]]
        finite = scores[group][np.isfinite(scores[group])]
        top = group[np.lexsort((-group, -count[group]))][: max(1, k)].tolist()
        return {
            "nodes": group.tolist(), "titles": list(dict.fromkeys(" ".join(f) for f in forms)) or members, "post_ids": np.unique(pids).tolist(),
            "score": float(finite.mean()) if len(finite) else 0.0, "keywords": list(dict.fromkeys(names[i] for i in top)),
            "vector": np.mean([raw(x) for x in members], 0).astype("float32") if members else np.zeros(self.nodes.place.shape[1], "float32"),
        }


class GlobalEvents:
    """Centres of the global events: each vector joins the nearest centre within the threshold, else opens one.

    Vectors are taken ``_BLOCK`` at a time: one matrix product estimates their distances to all centres, and only what moves or
    opens meanwhile is estimated again. The centres that the rounding of an estimate leaves open are measured exactly, so the
    result is that of measuring them all.
    """

    def __init__(self, threshold: float, centres: np.ndarray | None = None, sizes: np.ndarray | None = None) -> None:
        self.threshold = threshold
        self._n = 0 if centres is None else len(centres)
        c = np.zeros((0, 0), "float32") if not self._n else np.asarray(centres, "float32")
        self._room = np.concatenate([c, (c * c).sum(1, keepdims=True)], 1)  # the centres, and the square of each one's length
        self._count = np.empty(0, "int64") if sizes is None else np.asarray(sizes, "int64")

    @property
    def centres(self) -> np.ndarray:
        return self._room[: self._n, :-1]

    @property
    def sizes(self) -> np.ndarray:
        return self._count[: self._n]

    def join(self, vectors: np.ndarray) -> np.ndarray:
        """The number, from 1, of the global event of each vector, in order. A centre is the mean of what joined it."""
        v = np.asarray(vectors, "float32")
        return np.concatenate([np.empty(0, "int64"), *(self._block(v[lo : lo + _BLOCK]) for lo in range(0, len(v), _BLOCK))])

    def _block(self, v: np.ndarray) -> np.ndarray:
        m, width = v.shape
        if self._n + m > len(self._room):
            more = max(self._n, 4 * _BLOCK)
            self._room = np.concatenate([self._room[: self._n] if self._n else np.zeros((0, width + 1), "float32"), np.zeros((more, width + 1), "float32")])
            self._count = np.r_[self.sizes, np.zeros(more, "int64")]
        own = np.einsum("ij,ij->i", v, v)
        far = np.empty((m, self._n + m), "float32")  # estimates of the squared distances, less the square of the vector
        asked = np.concatenate([-2 * v, np.ones((m, 1), "float32")], 1)
        np.matmul(asked, self._room[: self._n].T, out=far[:, : self._n])
        # More than an estimate and a measured distance are off by; no number where a vector or a centre has none: all are measured.
        slack = np.float32(16 * width * np.finfo("float32").eps) * np.maximum(self._room[: self._n, -1].max(initial=0), own.max(initial=0))
        numbers = np.empty(m, "int64")
        for i in range(m):
            n, row = self._n, far[i, : self._n]
            close = np.flatnonzero(row <= row.min() + slack) if n and np.isfinite(slack) else np.arange(n)
            exact = np.linalg.norm(self._room[close, :-1] - v[i], axis=1)
            at = int(close[exact.argmin()]) if n and exact.min() < self.threshold else n
            self._n += at == n
            self._count[at] += 1
            size = self._count[at]
            self._room[at, :-1] = c = self._room[at, :-1] * np.float32((size - 1) / size) + v[i] * np.float32(1 / size)
            self._room[at, -1] = c @ c
            far[i + 1 :, at] = asked[i + 1 :] @ self._room[at]
            numbers[i] = at + 1
        return numbers
