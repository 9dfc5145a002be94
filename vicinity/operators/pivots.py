"""Executor-local metric index: nested balls around farthest-point pivots."""

from __future__ import annotations

import numpy as np

from ..functions.distance import paired, rough_distances, slack, within

#: Pivots of a node at most. Where so many haven't brought its points within 1 / cover of its radius, as in many
#: dimensions, balls don't tell points apart, and the node is a leaf.
MAX_PIVOTS = 24
#: Pairs of a leaf that are computed one by one; more of them go through matrix products.
FEW_PAIRS = 4096


class PivotTree:
    """Each node's points are split among pivots picked farthest-first until they are ``1 / cover`` of the
    node's radius apart; nodes of at most ``leaf_size`` points, of radius 0, or that pivots don't split are leaves.
    Queries go down in blocks, and skip a child whose ball they cannot reach. ``comps`` counts distances."""

    def __init__(self, points: np.ndarray, cover: float = 1.55, leaf_size: int = 10):
        self.points, self.leaf_size = points, leaf_size
        self.shrink = 1.0 / max(cover, 1.01)
        self.comps = 0
        self.root = self._node(np.arange(len(points)), 0) if len(points) else None

    def _node(self, members: np.ndarray, center: int):
        d = rough_distances(self.points[members], self.points[center : center + 1])[:, 0]
        radius = d.max()
        self.comps += len(members)
        if len(members) <= self.leaf_size or radius == 0:
            return center, radius, members, None
        nearest, site = d.copy(), np.zeros(len(members), np.int64)
        pivots = [center]
        while nearest.max() > radius * self.shrink or len(pivots) == 1:
            if len(pivots) == MAX_PIVOTS:
                return center, radius, members, None
            self.comps += len(members)
            new = int(members[nearest.argmax()])
            d = rough_distances(self.points[members], self.points[new : new + 1])[:, 0]
            closer = d < nearest
            nearest[closer], site[closer] = d[closer], len(pivots)
            pivots.append(new)
        return center, radius, members, [self._node(members[site == k], p) for k, p in enumerate(pivots)]

    def query(self, q: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (query, point) within ``radius``."""
        r = np.float32(radius)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        todo = [(self.root, np.arange(len(q)))] if self.root else []
        while todo:
            (center, reach, members, children), at = todo.pop()
            d = rough_distances(q[at], self.points[center : center + 1])[:, 0]
            self.comps += len(at)
            at = at[d <= reach + r + slack(q.shape[1], d + reach + r)]
            if not len(at):
                continue
            if children is None and len(at) * len(members) > FEW_PAIRS:
                self.comps += len(at) * len(members)
                i, j = within(q[at], self.points[members], radius)
                found.append((at[i], members[j]))
            elif children is None:
                self.comps += len(at) * len(members)
                i, j = np.repeat(at, len(members)), np.tile(members, len(at))
                ok = paired(q[i], self.points[j]) <= r
                found.append((i[ok], j[ok]))
            else:
                todo.extend((c, at) for c in children)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def tree_kernel(cover: float, leaf_size: int, slice_size: int = -1):
    """A kernel for the tile joins; queries go in slices of ``slice_size`` (-1: all at once)."""

    def kernel(probe: np.ndarray, build: np.ndarray, radius: float):
        tree = PivotTree(build, cover, leaf_size)
        step = len(probe) if slice_size < 1 else slice_size
        parts = [(i + at, j) for at in range(0, len(probe), step) for i, j in [tree.query(probe[at : at + step], radius)]]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), tree.comps

    return kernel
