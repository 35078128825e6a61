"""Hierarchical navigable small-world graphs over unit vectors, for many queries in unison."""

from __future__ import annotations

import io

import numpy as np

M, WIDE_BUILD, _EXPAND, _CELLS = 16, 48, 4, 1 << 25


def _rows(x: np.ndarray) -> int:
    """Queries at once, bounded by marks of what they have seen and by vectors that they compare."""
    n, dim = x.shape
    return int(min(1024, max(16, _CELLS // max(n, 1)), max(16, _CELLS // max(2 * _EXPAND * M * dim, 1))))


def search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search: for each query the ``width`` best nodes found and their similarities, best first (-1 where there are fewer).

    ``graph``: neighbours of each node, -1 for none. ``entry``: start nodes of each query.
    """
    ids, sims = [], []
    for at in range(0, len(q), step := _rows(x)):
        i, s = _search(x, graph, q[at : at + step], entry[at : at + step], width)
        ids.append(i)
        sims.append(s)
    return np.concatenate(ids), np.concatenate(sims)


def _search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    n, rows = len(q), np.arange(len(q))
    beam = np.full((n, width), -1)
    sim = np.full((n, width), -2.0, np.float32)
    todo = np.zeros((n, width), bool)
    seen = np.zeros((n, len(x)), bool)
    new, live = entry, rows
    while True:
        fresh = (new >= 0) & ~seen[live[:, None], new]
        first = np.sort(np.where(fresh, new, -1), 1)  # a node that comes twice counts once
        fresh = first >= 0
        fresh[:, 1:] &= first[:, 1:] != first[:, :-1]
        a, b = np.nonzero(fresh)
        seen[live[a], first[a, b]] = True
        got = np.full(first.shape, -2.0, np.float32)
        got[a, b] = np.einsum("ij,ij->i", x[first[a, b]], q[live[a]])
        s = np.concatenate([sim[live], got], 1)
        top = np.argsort(-s, 1, kind="stable")[:, :width]
        sim[live] = np.take_along_axis(s, top, 1)
        beam[live] = np.take_along_axis(np.concatenate([beam[live], np.where(fresh, first, -1)], 1), top, 1)
        todo[live] = np.take_along_axis(np.concatenate([todo[live], fresh], 1), top, 1) & (beam[live] >= 0)
        live = live[todo[live].any(1)]
        if not len(live):
            return beam, sim
        nxt = np.argsort(~todo[live], 1, kind="stable")[:, :_EXPAND]  # the best that are not expanded
        use = np.take_along_axis(todo[live], nxt, 1)
        node = np.where(use, np.take_along_axis(beam[live], nxt, 1), -1)
        np.put_along_axis(w := todo[live], nxt, False, 1)
        todo[live] = w
        new = np.where(node[..., None] >= 0, graph[node], -1).reshape(len(live), -1)


def select(x: np.ndarray, own: np.ndarray, cand: np.ndarray, m: int) -> np.ndarray:
    """At most ``m`` neighbours for each vector of ``own`` out of ``cand``: first those nearer to it than to any chosen one, then the nearest of the rest."""
    step = min(512, max(8, _CELLS // (cand.shape[1] * x.shape[1])))
    return np.concatenate([_select(x, own[k : k + step], cand[k : k + step], m) for k in range(0, len(own), step)])


def _select(x: np.ndarray, own: np.ndarray, cand: np.ndarray, m: int) -> np.ndarray:
    sim = np.where(cand >= 0, np.einsum("ijk,ik->ij", x[cand], own), -2)
    order = np.argsort(-sim, 1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    same = np.zeros(cand.shape, bool)
    for k in range(1, cand.shape[1]):
        same[:, k] = (cand[:, :k] == cand[:, k : k + 1]).any(1)
    usable = (cand >= 0) & ~same
    between = np.einsum("ijk,ilk->ijl", x[cand], x[cand])
    chosen = np.zeros(cand.shape, bool)
    for k in range(cand.shape[1]):
        worse = (chosen & (between[:, :, k] > sim[:, k : k + 1])).any(1)
        chosen[:, k] = usable[:, k] & ~worse & (chosen.sum(1) < m)
    rank = np.where(chosen, 0, np.where(usable, 1, 2)) * cand.shape[1] + np.arange(cand.shape[1])
    order = np.argsort(rank, 1)[:, :m]
    out = np.full((len(own), m), -1)
    out[:, : order.shape[1]] = np.where(np.take_along_axis(usable, order, 1), np.take_along_axis(cand, order, 1), -1)
    return out


def _layer(x: np.ndarray, members: np.ndarray, m: int, entry_of) -> np.ndarray:
    """The graph of one layer, in rows of all nodes; members go in by batches no larger than what is in."""
    graph = np.full((len(x), m), -1)
    done = 0
    while done < len(members):
        now = members[done : done + min(512, max(64, done))]
        parts = []
        if done:
            found, _ = search(x, graph, x[now], np.stack([entry_of(now, members[:done]), np.full(len(now), members[0])], 1), WIDE_BUILD)
            parts.append(found)
        near = x[now] @ x[now].T
        np.fill_diagonal(near, -3)
        k = min(len(now) - 1, m)
        if k:
            parts.append(now[np.argsort(-near, 1, kind="stable")[:, :k]])
        if parts:
            cand = np.concatenate(parts, 1)
            graph[now] = select(x, x[now], np.where(cand == now[:, None], -1, cand), m)
            _back(x, graph, now)
        done += len(now)
    return _reachable(x, graph, members)


def _back(x: np.ndarray, graph: np.ndarray, now: np.ndarray) -> None:
    """Links back from the chosen neighbours, which then choose anew."""
    m = graph.shape[1]
    src, dst = np.repeat(now, m), graph[now].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    node, first, count = np.unique(dst, return_index=True, return_counts=True)
    rank = np.arange(len(dst)) - np.repeat(first, count)
    wide = m
    for low in range(0, int(count.max(initial=0)), wide):  # a hub takes its new links in rounds
        part = (rank >= low) & (rank < low + wide)
        which = np.searchsorted(node, dst[part])
        pool = np.full((len(node), wide), -1)
        pool[which, rank[part] - low] = src[part]
        use = (pool >= 0).any(1)
        graph[node[use]] = select(x, x[node[use]], np.concatenate([graph[node[use]], pool[use]], 1), m)


def _reachable(x: np.ndarray, graph: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Adds links, in columns of their own, until every member is reached from the first one."""
    inside = np.zeros(len(x), bool)
    edge = members[:1]
    while True:
        while len(edge):
            inside[edge] = True
            to = graph[edge].ravel()
            edge = np.unique(to[(to >= 0) & ~inside[to]])
        lost = members[~inside[members]]
        if not len(lost):
            return graph
        near = graph[lost]
        ok = (near >= 0) & inside[near]
        some = ok.any(1)
        # from the first neighbour that is reached, or from the first member
        lost, via = (lost[some], near[some][np.arange(int(some.sum())), ok[some].argmax(1)]) if some.any() else (lost[:1], members[:1])
        via, first = np.unique(via, return_index=True)
        extra = np.full((len(x), 1), -1)
        extra[via, 0] = lost[first]
        graph, edge = np.concatenate([graph, extra], 1), lost[first]


class Index:
    def __init__(self, x: np.ndarray, layers: list[np.ndarray], tops: list[np.ndarray]) -> None:
        self.x, self.layers, self.tops = x, layers, tops

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 3) -> Index:
        """``x``: unit vectors (float32). A node's level is drawn: one in M reaches the next."""
        n = len(x)
        level = np.floor(-np.log(1 - np.random.Generator(np.random.PCG64(seed)).random(n)) / np.log(M)).astype(int)
        layers, tops = [], []
        index = cls(x, layers, tops)
        for k in range(int(level.max(initial=0)), -1, -1):
            members = np.flatnonzero(level >= k)
            layers.append(_layer(x, members, M if k else 2 * M, lambda now, inside: index._entry(x[now], inside)))
            tops.append(members)
        return index

    def _entry(self, q: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """A start in the layer below those that are built; where that is not inside yet, the first that is."""
        if not self.layers:
            return np.full(len(q), inside[0])
        at = self.descend(q, len(self.layers))
        have = np.zeros(len(self.x), bool)
        have[inside] = True
        return np.where(have[at], at, inside[0])

    def descend(self, q: np.ndarray, layers: int) -> np.ndarray:
        at = np.full((len(q), 1), self.tops[0][0])
        for graph in self.layers[:layers]:
            at = search(self.x, graph, q, at, 4)[0][:, :1]
        return at[:, 0]

    def query(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return search(self.x, self.layers[-1], q, self.descend(q, len(self.layers) - 1)[:, None], min(width, len(self.x)))

    def dump(self) -> bytes:
        """The graph without the vectors."""
        out = io.BytesIO()
        np.savez(out, **{f"layer{k}": g.astype(np.int32) for k, g in enumerate(self.layers)}, **{f"top{k}": t.astype(np.int32) for k, t in enumerate(self.tops)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes, x: np.ndarray) -> Index:
        z = np.load(io.BytesIO(raw))
        n = sum(name.startswith("top") for name in z.files)
        return cls(x, [z[f"layer{k}"] for k in range(n)], [z[f"top{k}"] for k in range(n)])
