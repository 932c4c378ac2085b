"""A hierarchical navigable small-world graph over unit vectors, built and searched with numpy inside one task.

Every node has a random highest layer. A search walks down the upper layers to the nearest node it finds and
keeps a beam of the best nodes in the lowest one. Many searches advance side by side, one step of all of them at a
time. New nodes come in batches: the graph so far and the batch itself propose neighbours, of which those are linked
that are nearer to the new node than to any neighbour taken already.

A vector within `reach` of a node that its own insertion meets becomes a member of it and no node, so that crowds
of near copies do not crowd the graph.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

LINKS, BUILD_BEAM, BATCH, EXPAND = 10, 32, 256, 2
# Bytes of marks that one round of searches may hold.
_MARKS = 64 << 20


@dataclass
class SmallWorld:
    """`points` by node, `layers` of links from the lowest up (-1 for none), `entry` node, and `owner` by vector."""

    points: np.ndarray
    layers: list[np.ndarray]
    entry: int
    owner: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def compact(self) -> SmallWorld:
        """The same graph without the rows of vectors that are no nodes; `owner` counts nodes from 0."""
        kept, owner = np.unique(self.owner, return_inverse=True)
        place = np.full(len(self.points) + 1, -1)
        place[kept] = np.arange(len(kept))
        layers = [place[links[kept]].astype(np.int32) for links in self.layers]
        return SmallWorld(self.points[kept], layers, int(place[self.entry]), owner)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes (-1 for none) and similarities of the `beam` best found for each query, best first."""
        n = len(self.points)
        if not len(queries) or not n:
            return np.full((len(queries), beam), -1), np.full((len(queries), beam), -np.inf, np.float32)
        size = max(1, min(512, _MARKS // n))
        parts = [self._search(queries[i : i + size], beam, 0) for i in range(0, len(queries), size)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, queries: np.ndarray, beam: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        starts = np.full((len(queries), 1), self.entry)
        for upper in range(len(self.layers) - 1, layer, -1):
            starts = self._walk(queries, starts, 1, upper)[0][:, :1]
        return self._walk(queries, starts, beam, layer)

    def _walk(self, queries: np.ndarray, starts: np.ndarray, beam: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        points, links = self.points, self.layers[layer]
        count, width = len(queries), links.shape[1]
        seen = np.zeros((count, len(points)), dtype=bool)
        nodes = np.full((count, beam), -1, dtype=np.int64)
        near = np.full((count, beam), -np.inf, dtype=np.float32)
        done = np.ones((count, beam), dtype=bool)
        first = starts[:, 0]
        nodes[:, 0], done[:, 0] = first, False
        near[:, 0] = np.einsum("qd,qd->q", queries, points[first])
        seen[np.arange(count), first] = True
        active = np.arange(count)
        expand = min(EXPAND, beam)
        while True:
            active = active[~done[active].all(axis=1)]
            if not len(active):
                return nodes, near
            # the best nodes that are not expanded yet; beams are in order
            picked = np.argsort(done[active], axis=1, kind="stable")[:, :expand]
            row = active[:, None]
            fresh = ~done[row, picked]
            done[row, picked] = True
            found = links[nodes[row, picked]]
            found[~fresh] = -1
            found = np.sort(found.reshape(len(active), expand * width), axis=1)
            known = found < 0
            known[:, 1:] |= found[:, 1:] == found[:, :-1]
            known |= seen[row, found]
            seen[np.broadcast_to(row, found.shape)[~known], found[~known]] = True
            score = np.full(found.shape, -np.inf, dtype=np.float32)
            which, place = np.nonzero(~known)
            target = found[which, place]
            score[which, place] = np.einsum("kd,kd->k", queries[active[which]], points[target])
            found[known] = -1
            whole = np.concatenate([near[active], score], axis=1)
            order = np.argsort(-whole, axis=1, kind="stable")[:, :beam]
            near[active] = np.take_along_axis(whole, order, axis=1)
            nodes[active] = np.take_along_axis(np.concatenate([nodes[active], found], axis=1), order, axis=1)
            done[active] = np.take_along_axis(np.concatenate([done[active], known], axis=1), order, axis=1)


def _choose(points: np.ndarray, centre: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` neighbours of each centre among its candidates (-1 for none), [centres, most].

    First those that are nearer to the centre than to one chosen before, then the nearest of the rest.
    """
    near = np.einsum("qd,qcd->qc", centre, points[nodes])
    near[nodes < 0] = -np.inf
    order = np.argsort(-near, axis=1, kind="stable")
    nodes, near = np.take_along_axis(nodes, order, axis=1), np.take_along_axis(near, order, axis=1)
    # a node may have been proposed from both sides
    nodes[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = -1
    count, width = nodes.shape
    vectors = points[nodes]
    among = np.einsum("qad,qbd->qab", vectors, vectors)
    taken = np.zeros((count, width), dtype=bool)
    # the largest similarity of each candidate to one that is taken
    hidden = np.full((count, width), -np.inf, dtype=np.float32)
    for c in range(width):
        good = (nodes[:, c] >= 0) & (near[:, c] > hidden[:, c]) & (taken.sum(axis=1) < most)
        taken[good, c] = True
        hidden[good] = np.maximum(hidden[good], among[good, c])
    rank = np.where(taken, 0, np.where(nodes >= 0, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    chosen = np.take_along_axis(nodes, order, axis=1)
    if chosen.shape[1] < most:
        chosen = np.pad(chosen, ((0, 0), (0, most - chosen.shape[1])), constant_values=-1)
    return chosen


def _link(world: SmallWorld, layer: int, new: np.ndarray, candidates: np.ndarray, most: int) -> None:
    """Link new nodes to the best of their candidates, and these back to them."""
    links, points = world.layers[layer], world.points
    chosen = _choose(points, points[new], candidates, min(LINKS, links.shape[1]))
    links[new, : chosen.shape[1]] = chosen
    source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    touched, begin, count = np.unique(target, return_index=True, return_counts=True)
    # by the number of links that arrive, so that no array is much wider than it has to be
    for size in 2 ** np.arange(int(count.max()).bit_length() if len(count) else 0):
        some = (count >= size) & (count < 2 * size)
        if not some.any():
            continue
        arriving = np.full((int(some.sum()), 2 * size - 1), -1)
        for k in range(arriving.shape[1]):
            has = count[some] > k
            arriving[has, k] = source[begin[some][has] + k]
        nodes = touched[some]
        # pieces of bounded size: the candidates of a node are compared with one another
        piece = max(1, (8 << 20) // ((links.shape[1] + 2 * size) ** 2 * 4))
        for low in range(0, len(nodes), piece):
            part = nodes[low : low + piece]
            links[part] = _choose(points, points[part], np.concatenate([links[part], arriving[low : low + piece]], axis=1), most)


def build(vectors: np.ndarray, reach: float, seed: int = 0) -> SmallWorld:
    """The graph over unit vectors; those with a similarity of `reach` or more to a node they meet are its members."""
    vectors = np.ascontiguousarray(vectors, dtype=np.float32)
    n, rng = len(vectors), np.random.default_rng(seed)
    levels = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 8)
    world = SmallWorld(vectors, [np.full((n, 2 * LINKS), -1)], 0, np.arange(n))
    top, start = 0, 0
    while start < n:
        batch = np.arange(start, min(n, start + min(BATCH, max(1, start // 2))))
        rows = vectors[batch]
        if start:
            found, near = world.search(rows, BUILD_BEAM)
            owned = near[:, 0] >= reach
            world.owner[batch[owned]] = found[owned, 0]
        else:
            found, owned = np.empty((len(batch), 0), np.int64), np.zeros(len(batch), dtype=bool)
        # the same among the batch, in order
        among = rows @ rows.T
        leaders: list[int] = []
        for k in np.flatnonzero(~owned).tolist():
            near_leader = next((m for m in leaders if among[k, m] >= reach), None) if leaders else None
            if near_leader is None:
                leaders.append(k)
            else:
                world.owner[batch[k]] = batch[near_leader]
        if leaders:
            new, level = batch[leaders], levels[batch[leaders]]
            others = among[np.ix_(leaders, leaders)]
            np.fill_diagonal(others, -np.inf)
            closest = np.argsort(-others, axis=1, kind="stable")[:, :BUILD_BEAM]
            mates = np.where(np.take_along_axis(others, closest, axis=1) > -np.inf, new[closest], -1)
            _link(world, 0, new, np.concatenate([found[leaders], mates], axis=1), 2 * LINKS)
            for layer in range(1, int(level.max()) + 1):
                high = level >= layer
                if layer > top:
                    # the first nodes of a new layer are all linked to one another
                    world.layers.append(np.full((n, LINKS), -1))
                    known = np.empty((int(high.sum()), 0), np.int64)
                    top, world.entry = layer, int(new[high][0])
                else:
                    known = world._search(vectors[new[high]], BUILD_BEAM, layer)[0]
                _link(world, layer, new[high], np.concatenate([known, _mates(others, high, new)], axis=1), LINKS)
        start = int(batch[-1]) + 1
    return world.compact()


def _mates(others: np.ndarray, high: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The nearest new nodes of the same layer, for each new node of it."""
    inside = others[np.ix_(high, high)]
    closest = np.argsort(-inside, axis=1, kind="stable")[:, :BUILD_BEAM]
    return np.where(np.take_along_axis(inside, closest, axis=1) > -np.inf, new[high][closest], -1)
