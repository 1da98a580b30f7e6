"""Components inside a task: local roots, and the edges that tasks on parts of a group have to give."""

from __future__ import annotations

import numpy as np


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n nodes over the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def root_links(n: int, a: np.ndarray, b: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that a task on one part (side 2) or on two parts (sides 0 and 1) of a group adds.

    One part gives a star per component. Two parts give edges between the roots of the parts' own components only:
    their members hang on those roots already, by the tasks that hold the parts alone.
    """
    whole = local_roots(n, a, b)
    if n and side[0] == 2:
        node = np.flatnonzero(whole != np.arange(n))
        return node, whole[node]
    inside = side[a] == side[b]
    own = local_roots(n, a[inside], b[inside])
    node = np.flatnonzero((own == np.arange(n)) & (whole != np.arange(n)))
    return node, whole[node]
