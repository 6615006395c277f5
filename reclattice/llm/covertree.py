"""A cover tree over unit vectors and the traversal of two trees at once."""

from __future__ import annotations

import numpy as np

LEAF = 48
# A level with fewer members to a child than this is not laid out: one matrix product is less work.
GATHERED = 8
# Distances are trusted to this; pairs nearer to the bound are decided on the cosine itself. They come
# from inner products, whose rounding moves a distance near zero by up to 5e-8.
MARGIN = 1e-7


class Node:
    """A point with a radius that covers all its members. ``children`` partition the members and
    have half the radius it was built for; a leaf has none, and stands for itself in ``centers``.
    A node is a leaf when it is small or when its members are too far apart for the next level."""

    __slots__ = ("center", "radius", "members", "children", "centers", "radii")

    def __init__(self, center: np.ndarray, radius: float, members: np.ndarray):
        self.center, self.radius, self.members = center, radius, members
        self.children: list[Node] = []
        self.centers, self.radii = center[None], np.array([radius])


def _apart(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Distances between unit vectors, all of ``one`` to all of ``two``."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (one @ two.T)))


def build(points: np.ndarray) -> Node:
    """Cover tree of unit vectors (rows). Each level covers with half the radius of the one above."""
    root = Node(points[0], float(_apart(points, points[0]).max()), np.arange(len(points)))
    stack = [(root, root.radius)]
    while stack:
        node, reach = stack.pop()
        if len(node.members) <= LEAF or node.radius <= MARGIN:
            continue
        # A net of this level: no two of its points are within ``reach``, all members are.
        reach /= 2
        rest, children = node.members, []
        own = points[rest]
        while len(rest) and len(children) * GATHERED <= len(node.members):
            away = _apart(own, own[0])
            near = away <= reach
            near[0] = True
            child = Node(points[rest[0]], float(away[near].max()), rest[near])
            children.append(child)
            rest, own = rest[~near], own[~near]
        if len(rest):
            continue
        node.children = children
        node.centers = np.stack([c.center for c in node.children])
        node.radii = np.array([c.radius for c in node.children])
        stack += [(child, reach) for child in node.children]
    return root


class Forest:
    """Union-find that keeps the least id of a set as its root."""

    def __init__(self, ids: np.ndarray):
        self.parent = {int(i): int(i) for i in ids}

    def find(self, x: int) -> int:
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def _unite(forest: Forest, hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Unites the ids of all pairs hit: least ids pass along the pairs until nothing changes."""
    i, j = np.nonzero(hit)
    low, low_right, before = left.copy(), right.copy(), None
    while before is None or not np.array_equal(before, low):
        before = low.copy()
        np.minimum.at(low_right, j, low[i])
        np.minimum.at(low, i, low_right[j])
    for ids, least in ((left, low), (right, low_right)):
        for x, y in zip(ids[ids != least].tolist(), least[ids != least].tolist(), strict=True):
            forest.union(x, y)


def links(one: np.ndarray, two: np.ndarray | None, ids_one, ids_two, weight_one, weight_two, cosine: float):
    """Counts and classes of the pairs with at least this cosine between two sets of unit vectors,
    or within ``one`` if ``two`` is None; a point is not paired with itself.

    Returns per point the weight of its partners, for both sets, and the forest of ids. A pair of
    nodes is dropped when its covering radii keep all pairs apart, and taken whole when they put
    all pairs within the distance; what is left is compared point by point.
    """
    far = np.sqrt(2 - 2 * cosine)
    same = two is None
    tree_one = build(one)
    tree_two = tree_one if same else build(two)
    if same:
        two, ids_two, weight_two = one, ids_one, weight_one
    found_one, found_two = np.zeros(len(one), np.int64), np.zeros(len(two), np.int64)
    forest = Forest(np.concatenate([ids_one, ids_two]))
    stack = [(tree_one, tree_two, float(np.linalg.norm(tree_one.center - tree_two.center)))]
    while stack:
        a, b, away = stack.pop()
        if away - a.radius - b.radius > far + MARGIN:
            continue
        if away + a.radius + b.radius < far - MARGIN:
            # All pairs link. Within one set the ordered pairs (a, b) and (b, a) both come by.
            found_one[a.members] += weight_two[b.members].sum()
            if same:
                if a is b:
                    found_one[a.members] -= weight_one[a.members]
            else:
                found_two[b.members] += weight_one[a.members].sum()
            top = int(ids_one[a.members[0]])
            for i in ids_one[a.members[1:]]:
                forest.union(top, int(i))
            for i in ids_two[b.members]:
                forest.union(top, int(i))
            continue
        if not a.children and not b.children:
            hit = one[a.members] @ two[b.members].T >= cosine
            if same and a is b:
                np.fill_diagonal(hit, False)
            if hit.any():
                found_one[a.members] += hit @ weight_two[b.members]
                if not same:
                    found_two[b.members] += hit.T @ weight_one[a.members]
                _unite(forest, hit, ids_one[a.members], ids_two[b.members])
            continue
        # One level down in both trees; all pairs of children are tested together.
        away = _apart(a.centers, b.centers)
        near = np.nonzero(away - a.radii[:, None] - b.radii <= far + MARGIN)
        below_a, below_b = a.children or [a], b.children or [b]
        stack += [(below_a[i], below_b[j], d) for i, j, d in zip(*(x.tolist() for x in near), away[near].tolist(), strict=True)]
    return found_one, found_two, forest
