"""A hierarchical navigable small-world graph in flat arrays, built and searched in batches.

All points are lifted to one length by an extra coordinate, so that the nearest point of the
graph is the one with the largest inner product with a query (whose extra coordinate is 0).
Points of a batch are inserted together: they look for neighbours in the graph so far and
among each other, then all links are made. Every step handles all points or queries of a
batch as arrays.
"""

from __future__ import annotations

import numpy as np

#: Links per node on upper layers (twice as many at the bottom), and beam width when building.
LINKS, BUILD_BEAM, BATCH = 32, 96, 256


class Graph:
    """``layers[l]`` holds (nodes of the layer, their neighbour rows); neighbours are node numbers, -1 where free."""

    def __init__(self, points: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.points, self.layers = points, layers
        self.place = []
        for nodes, _ in layers:
            place = np.full(len(points), -1, np.int32)
            place[nodes] = np.arange(len(nodes))
            self.place.append(place)

    # ---- search

    def beam(self, queries: np.ndarray, start: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best nodes found per query (-1 where fewer) and their products, best first."""
        q, n = len(queries), len(self.points)
        ids = np.full((q, width), -1, np.int32)
        sims = np.full((q, width), -np.inf, np.float32)
        open_ = np.zeros((q, width), bool)
        ids[:, 0], open_[:, 0] = start, True
        sims[:, 0] = np.einsum("qd,qd->q", queries, self.points[start])
        seen = np.zeros((q, n), bool)
        seen[np.arange(q), start] = True
        place, links = self.place[layer], self.layers[layer][1]
        live = np.arange(q)
        while len(live):
            best = np.argmax(np.where(open_[live], sims[live], -np.inf), axis=1)
            going = open_[live, best]
            live, best = live[going], best[going]
            if not len(live):
                break
            open_[live, best] = False
            near = links[place[ids[live, best]]]
            fresh = (near >= 0) & ~seen[live[:, None], near]
            rows, cols = np.nonzero(fresh)
            seen[live[rows], near[rows, cols]] = True
            found = np.full(near.shape, -np.inf, np.float32)
            found[rows, cols] = np.einsum("nd,nd->n", queries[live[rows]], self.points[near[rows, cols]])
            all_sims = np.concatenate([sims[live], found], axis=1)
            order = np.argpartition(-all_sims, width - 1, axis=1)[:, :width] if all_sims.shape[1] > width else np.argsort(-all_sims, axis=1)
            take = lambda a, o=order: np.take_along_axis(a, o, axis=1)
            sims[live] = take(all_sims)
            ids[live] = take(np.concatenate([ids[live], np.where(np.isfinite(found), near, -1)], axis=1))
            open_[live] = take(np.concatenate([open_[live], np.isfinite(found)], axis=1))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def search(self, queries: np.ndarray, width: int) -> np.ndarray:
        """Node numbers of the ``width`` best found per query, -1 where there are fewer; all nodes if they fit."""
        n = len(self.points)
        if n <= width:
            return np.broadcast_to(np.arange(n, dtype=np.int32), (len(queries), n))
        at = np.full(len(queries), self.layers[-1][0][0])
        for layer in range(len(self.layers) - 1, 0, -1):
            at = self.beam(queries, at, layer, 1)[0][:, 0]
        return self.beam(queries, at, 0, width)[0]


def lift(vectors: np.ndarray) -> np.ndarray:
    """Vectors with the coordinate that gives all of them the length of the longest."""
    norms = np.einsum("nd,nd->n", vectors.astype(np.float64), vectors.astype(np.float64))
    extra = np.sqrt(np.maximum(norms.max() - norms, 0))
    return np.concatenate([vectors, extra[:, None]], axis=1).astype(np.float32)


def diverse(sims: np.ndarray, between: np.ndarray, most: int) -> np.ndarray:
    """Which candidates (sorted best first) to link: those nearer to the point than to any one chosen before.

    Places left over go to the best of the others, so nodes keep enough links.
    """
    q, c = sims.shape
    chosen = np.zeros((q, c), bool)
    closest = np.full((q, c), -np.inf, np.float32)  # to the chosen ones so far
    count = np.zeros(q, np.int64)
    for k in range(c):
        pick = np.isfinite(sims[:, k]) & (sims[:, k] > closest[:, k]) & (count < most)
        chosen[:, k] = pick
        count += pick
        closest[pick] = np.maximum(closest[pick], between[pick, k])
    left = np.isfinite(sims) & ~chosen
    return chosen | left & (np.cumsum(left, axis=1) <= (most - count)[:, None])


def build(vectors: np.ndarray, seed: int = 0) -> Graph:
    """Graph over distinct non-zero vectors; the same input gives the same graph."""
    points = lift(vectors)
    n = len(points)
    levels = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
    order = np.argsort(-levels, kind="stable")  # the first point reaches the top layer and stays the entry
    layers = []
    for layer in range(levels.max() + 1):
        nodes = order[: int((levels >= layer).sum())].astype(np.int32)
        layers.append((nodes, np.full((len(nodes), LINKS * (2 if layer == 0 else 1)), -1, np.int32)))
    graph = Graph(points, layers)
    done, size = 1, 1
    while done < n:
        new = order[done:done + size]
        at = np.full(len(new), order[0])
        for layer in range(len(layers) - 1, -1, -1):
            joins = levels[new] >= layer
            if (~joins).any():
                at[~joins] = graph.beam(points[new[~joins]], at[~joins], layer, 1)[0][:, 0]
            if joins.any():
                ids, sims = graph.beam(points[new[joins]], at[joins], layer, BUILD_BEAM)
                at[joins] = ids[:, 0]
                _link(graph, layer, new[joins], ids, sims)
        done += len(new)
        size = min(2 * size, BATCH)
    return graph


def _link(graph: Graph, layer: int, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
    points, links, place = graph.points, graph.layers[layer][1], graph.place[layer]
    if len(new) > 1:  # those inserted together are candidates for each other
        own = points[new] @ points[new].T
        np.fill_diagonal(own, -np.inf)
        top = np.argsort(-own, axis=1)[:, :LINKS]
        ids = np.concatenate([ids, np.where(np.isfinite(np.take_along_axis(own, top, 1)), new[top], -1).astype(np.int32)], axis=1)
        sims = np.concatenate([sims, np.take_along_axis(own, top, 1)], axis=1)
    chosen = _choose(points, ids, sims, LINKS)
    links[place[new], :LINKS] = chosen
    # the way back: each chosen node gets the new ones beside its own links, cut to the best
    source = np.repeat(new, LINKS)[chosen.ravel() >= 0].astype(np.int32)
    target = chosen.ravel()[chosen.ravel() >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    heads = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, int)
    sizes = np.diff(np.r_[heads, len(target)])
    for at in range(0, len(heads), BATCH):
        group, count = target[heads[at:at + BATCH]], sizes[at:at + BATCH]
        added = np.full((len(group), count.max()), -1, np.int32)
        slot = np.arange(count.max())[None, :] < count[:, None]
        added[slot] = source[heads[at]:heads[at] + count.sum()]
        # two new points may have chosen each other already
        have = links[place[group]]
        added[(added[:, :, None] == have[:, None, :]).any(axis=2)] = -1
        every = np.concatenate([have, added], axis=1)
        near = np.where(every >= 0, np.einsum("qd,qcd->qc", points[group], points[every]), -np.inf).astype(np.float32)
        links[place[group]] = _choose(points, every, near, links.shape[1])


def _choose(points: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    out = np.full((len(ids), most), -1, np.int32)
    keep = np.isfinite(sims)
    if keep.sum(axis=1).max(initial=0) > most:
        near = points[ids]
        keep = diverse(sims, near @ near.transpose(0, 2, 1), most)
    rows, cols = np.nonzero(keep)
    out[rows, (np.cumsum(keep, axis=1) - 1)[rows, cols]] = ids[rows, cols]
    return out
