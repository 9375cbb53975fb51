"""A hierarchical navigable small-world graph over unit vectors, as flat neighbour arrays.

Neighbour lists are rows of one int32 array per layer, -1 where empty. Searches advance in groups
of queries that lie near each other: a group shares one set of visited vectors, each step expands
the best few unexpanded entries of every query's beam, and what is new among their neighbours is
compared with the whole group by one matrix product. So a query also profits from what its group
mates come across, and the vectors visited are fetched once a group rather than once a query.
Vectors are inserted in batches that grow with the graph.
"""

from __future__ import annotations

import numpy as np

FAR = np.float32(-3.0)


def levels_of(ids: np.ndarray, m: int) -> np.ndarray:
    """Top layer of each vector, drawn from a hash of its id, so that a rebuild gives the same graph."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    u = ((h >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    return np.minimum(np.floor(-np.log(u) / np.log(m)), 8).astype(np.int64)


def _best_of(place: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best columns of each row, best first."""
    if cos.shape[1] > 2 * k:
        part = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        place, cos = np.take_along_axis(place, part, 1), np.take_along_axis(cos, part, 1)
    order = np.argsort(-cos, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(place, order, 1), np.take_along_axis(cos, order, 1)


def _merged(place: np.ndarray, cos: np.ndarray, fresh: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beams with what is better among ``fresh`` vectors, of which ``s`` has the cosines for each beam."""
    width = cos.shape[1]
    if len(fresh) <= 4 * width:
        return _best_of(np.concatenate([place, np.broadcast_to(fresh, s.shape)], 1), np.concatenate([cos, s], 1), width)
    at = np.flatnonzero(s > cos[:, -1:])  # few pass once the beams are filled
    if not len(at):
        return place, cos
    line, column = np.divmod(at, len(fresh))
    counts = np.bincount(line, minlength=len(s))
    most = int(counts.max())
    slot = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    add, add_cos = np.full((len(s), most), -1, dtype=np.int32), np.full((len(s), most), FAR, dtype=np.float32)
    add[line, slot], add_cos[line, slot] = fresh[column], s.ravel()[at]
    return _best_of(np.concatenate([place, add], 1), np.concatenate([cos, add_cos], 1), width)


def merge_best(best: np.ndarray, best_cos: np.ndarray, to: np.ndarray, what: np.ndarray, cos: np.ndarray) -> None:
    """Merge triples into lists of the best, in place; a pair must not come twice."""
    if not len(to):
        return
    k = best.shape[1]
    order = np.lexsort((-cos, to))
    to, what, cos = to[order], what[order], cos[order]
    heads, starts, counts = np.unique(to, return_index=True, return_counts=True)
    slot = np.arange(len(to)) - np.repeat(starts, counts)
    fits = slot < k
    line = np.repeat(np.arange(len(heads)), counts)[fits]
    add, add_cos = np.full((len(heads), k), -1, dtype=best.dtype), np.full((len(heads), k), -3.0, dtype=best_cos.dtype)
    add[line, slot[fits]], add_cos[line, slot[fits]] = what[fits], cos[fits]
    both, both_cos = np.concatenate([best[heads], add], 1), np.concatenate([best_cos[heads], add_cos], 1)
    top = np.argsort(-both_cos, axis=1, kind="stable")[:, :k]
    best[heads], best_cos[heads] = np.take_along_axis(both, top, 1), np.take_along_axis(both_cos, top, 1)


class Graph:
    """``x`` are unit float32 rows; ``layers[l]`` is (n, width) int32, ``level`` the top layer of each vector."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, m: int = 16, build_beam: int = 20, group: int = 512):
        self.x, self.ids, self.m, self.beam, self.group = np.ascontiguousarray(vectors, dtype=np.float32), ids, m, build_beam, group
        n = len(ids)
        self.level = levels_of(ids, m)
        self.top = int(self.level.max()) if n else 0
        self.layers = [np.full((n, 2 * m if l == 0 else m), -1, dtype=np.int32) for l in range(self.top + 1)]
        if n:
            self._build()

    # --- searching -----------------------------------------------------------------------------

    def _beam(self, q: np.ndarray, start: np.ndarray, layer: int, width: int, take: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Best ``width`` vectors of a layer for each query of one group, from common start vectors: (places, cosines), best first, -1 where fewer."""
        x, links, b = self.x, self.layers[layer], len(q)
        seen, expanded = np.zeros(len(x), dtype=bool), np.zeros(len(x) + 1, dtype=bool)
        expanded[-1] = True  # where a beam is empty
        seen[start] = True
        place = np.full((b, width), -1, dtype=np.int32)
        cos = np.full((b, width), FAR, dtype=np.float32)
        fresh = start
        while True:
            place, cos = _merged(place, cos, fresh, q @ x[fresh].T)
            open_ = ~expanded[place]
            if take < width:
                open_ &= np.cumsum(open_, axis=1) <= take
            nodes = place[open_]
            if not len(nodes):
                return place, cos
            expanded[nodes] = True
            near = links[np.unique(nodes)].ravel()
            near = near[near >= 0]
            near = np.unique(near[~seen[near]])
            if not len(near):
                # all their neighbours are known; the rest of the beams may still lead on
                fresh = near
                continue
            seen[near] = True
            fresh = near

    def _grouped(self, q: np.ndarray) -> list[np.ndarray]:
        """Rows of ``q`` in groups of neighbours: by the nearest of the vectors of an upper layer."""
        pivots = next((p for l in range(self.top, 0, -1) if len(p := np.flatnonzero(self.level >= l)) >= 32), None)
        order = np.arange(len(q))
        if pivots is not None and len(q) > self.group:
            pivots = self.x[pivots[:512]]
            # pivots themselves in the order of one of them, so that neighbouring groups are near too
            pivots = pivots[np.argsort(-(pivots @ pivots[0]), kind="stable")]
            nearest = np.concatenate([np.argmax(q[a : a + 4096] @ pivots.T, axis=1) for a in range(0, len(q), 4096)])
            order = np.argsort(nearest, kind="stable")
        return [order[a : a + self.group] for a in range(0, len(q), self.group)]

    def _start(self, q: np.ndarray, to: int) -> np.ndarray:
        """Greedy descent of a group from the entry to the layer above ``to``: start vectors for ``to``."""
        at = np.array([self.entry], dtype=np.int32)
        for layer in range(self.top, to, -1):
            at = np.unique(self._beam(q, at, layer, 1, 1)[0])
        return at

    def _search(self, q: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        place, cos = np.empty((len(q), width), dtype=np.int32), np.empty((len(q), width), dtype=np.float32)
        for rows in self._grouped(q):
            part = q[rows]
            place[rows], cos[rows] = self._beam(part, self._start(part, layer), layer, width)
        return place, cos

    def search(self, q: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the ``k`` best vectors found for each query; -1 and -3 where there are fewer."""
        if not len(self.x) or not len(q):
            return np.full((len(q), k), -1, dtype=np.int32), np.full((len(q), k), FAR, dtype=np.float32)
        place, cos = self._search(np.ascontiguousarray(q, dtype=np.float32), 0, max(beam, k))
        return place[:, :k], cos[:, :k]

    # --- building ------------------------------------------------------------------------------

    def _diverse(self, cand: np.ndarray, cos: np.ndarray, width: int) -> np.ndarray:
        """Per row, up to ``width`` of the candidates (best first): each nearer to the vector than to any chosen before, then the best of the rest."""
        b, c = cand.shape
        if c <= width:
            return cand
        v = self.x[cand]
        between = np.matmul(v, v.transpose(0, 2, 1))
        worst = np.full((b, c), FAR, dtype=np.float32)
        chosen = np.zeros((b, c), dtype=bool)
        count = np.zeros(b, dtype=np.int64)
        valid = cand >= 0
        for j in range(c):
            ok = valid[:, j] & (count < width) & (worst[:, j] < cos[:, j])
            chosen[:, j] = ok
            count += ok
            worst = np.where(ok[:, None], np.maximum(worst, between[:, j, :]), worst)
        # chosen first, then the others, both by cosine
        rank = np.where(chosen, 0, np.where(valid, 1, 2)) * c + np.arange(c)
        return np.take_along_axis(cand, np.argsort(rank, axis=1)[:, :width], 1)

    def _link_back(self, layer: int, new: np.ndarray, near: np.ndarray) -> None:
        """Add the new vectors to their neighbours' lists; lists that overflow are thinned."""
        links = self.layers[layer]
        width = links.shape[1]
        to, frm = near.ravel(), np.repeat(new, near.shape[1]).astype(np.int32)
        frm, to = frm[to >= 0], to[to >= 0]
        if not len(to):
            return
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        heads, starts, counts = np.unique(to, return_index=True, return_counts=True)
        most = min(int(counts.max()), 3 * width)
        slot = np.arange(len(to)) - np.repeat(starts, counts)
        fits = slot < most
        add = np.full((len(heads), most), -1, dtype=np.int32)
        add[np.repeat(np.arange(len(heads)), counts)[fits], slot[fits]] = frm[fits]
        both = np.concatenate([links[heads], add], 1)
        size = (both >= 0).sum(1)
        light = size <= width
        if light.any():
            rows = both[light]
            order = np.argsort(rows < 0, axis=1, kind="stable")[:, :width]
            links[heads[light]] = np.take_along_axis(rows, order, 1)
        heavy = np.flatnonzero(~light)
        for a in range(0, len(heavy), 1024):
            h = heavy[a : a + 1024]
            rows = both[h]
            cos = np.matmul(self.x[rows], self.x[heads[h]][:, :, None])[:, :, 0]
            cos[rows < 0] = FAR
            rows, cos = _best_of(rows, cos, min(rows.shape[1], width + width // 2))
            # thinned below the width, so that the next few links find room
            links[heads[h]] = -1
            links[heads[h], : width - width // 4] = self._diverse(rows, cos, width - width // 4)

    def _build(self) -> None:
        """Insert level by level, upper ones first, so that descents work from the start; a batch is of one level."""
        n = len(self.x)
        order = np.lexsort((np.arange(n), -self.level))
        self.entry = int(order[0])
        done = 1
        while done < n:
            same = int(np.searchsorted(-self.level[order], -self.level[order[done]], "right")) - done
            size = min(max(64, done), 4096, same)
            new = order[done : done + size]
            q = self.x[new]
            for layer in range(int(self.level[new[0]]), -1, -1):
                found, cos = self._search(q, layer, self.beam)
                near = np.concatenate([self._diverse(*self._with_mates(new, q, found, cos, a), self.m) for a in range(0, size, 512)])
                self.layers[layer][new, : near.shape[1]] = near
                self._link_back(layer, new, near)
            done += size

    @staticmethod
    def _with_mates(new: np.ndarray, q: np.ndarray, found: np.ndarray, cos: np.ndarray, a: int) -> tuple[np.ndarray, np.ndarray]:
        """The beams of 512 vectors of a batch from ``a`` on, with the other vectors of the batch, which the graph does not have yet."""
        part = slice(a, a + 512)
        s = q[part] @ q.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -4.0
        return _merged(found[part], cos[part], new.astype(np.int32), s)
