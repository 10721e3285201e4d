"""BK-trees over 64-bit codes, built and searched level by level in numpy for many groups at once."""

from __future__ import annotations

import numpy as np

#: (query, node) pairs that a search step holds at most, about.
FRONTIER = 2_000_000
#: What a sketch's estimate has to fall short by to rule a pair out: six standard errors.
MARGIN = 0.15


def build(group: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree for each group: parent (-1 at a root) and edge, the distance to the parent, of every row; and the root of every row's group. A node's first row is its head; the others hang below it by their distance to it."""
    n = len(code)
    parent, edge, root = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int16), np.empty(n, dtype=np.int64)
    rows = np.argsort(group, kind="stable")
    heads = np.concatenate(([True], group[rows][1:] != group[rows][:-1])) if n else np.empty(0, dtype=bool)
    root[rows] = rows[heads][np.cumsum(heads) - 1] if n else rows
    head = root[rows]
    while len(rows):
        below = rows != head
        rows, head = rows[below], head[below]
        d = np.bitwise_count(code[rows] ^ code[head]).astype(np.int16)
        order = np.lexsort((rows, d, head))
        rows, head, d = rows[order], head[order], d[order]
        first = np.concatenate(([True], (head[1:] != head[:-1]) | (d[1:] != d[:-1]))) if len(rows) else np.empty(0, dtype=bool)
        parent[rows[first]], edge[rows[first]] = head[first], d[first]
        head = rows[first][np.cumsum(first) - 1] if len(rows) else head
    return parent, edge, root


def near(code: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray], queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, found row) of all rows of the query's tree within the radius, itself included. From a node at distance d only the edges from d - radius to d + radius are followed."""
    parent, edge, root = tree
    kids = np.flatnonzero(parent >= 0)
    kids = kids[np.lexsort((edge[kids], parent[kids]))]
    place = parent[kids] * 128 + edge[kids]  # sorted: a node's edges are one run
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(queries, root[queries])]
    while todo:
        q, node = todo.pop()
        if len(q) > FRONTIER:
            half = len(q) // 2
            todo += [(q[:half], node[:half]), (q[half:], node[half:])]
            continue
        d = np.bitwise_count(code[q] ^ code[node]).astype(np.int64)
        hit = d <= radius
        found.append((q[hit], node[hit]))
        low = np.searchsorted(place, node * 128 + np.maximum(d - radius, 0), "left")
        count = np.searchsorted(place, node * 128 + d + radius, "right") - low
        if total := int(count.sum()):
            at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            todo.append((np.repeat(q, count), kids[at]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (queries[:0], queries[:0])


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of one-byte sketches (0: nothing in this place). A place that both fill agrees by chance once in 255."""
    filled, same = ((a > 0) | (b > 0)).sum(axis=1), ((a == b) & (a > 0)).sum(axis=1)
    return np.where(filled == 0, 1.0, same / np.maximum(filled, 1))


def linked(group: np.ndarray, code: np.ndarray, radius: int, sketch: np.ndarray | None = None, sets: list | None = None, least_alike: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """For every row that has a link in its group to an earlier row of its linked part: the row, and the part's first row. With sketches, a link needs sets (sorted distinct 64-bit hashes) of a Jaccard similarity of least_alike."""
    n = len(code)
    tree = build(group, code)
    label = np.arange(n)
    _, of, sizes = np.unique(group, return_inverse=True, return_counts=True)
    pairs = np.cumsum(sizes[of])  # that the rows up to here can have at most
    cuts = np.unique(np.append(np.searchsorted(pairs, np.arange(0, pairs[-1], 2 * FRONTIER)), n)) if n else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True) if n else ():
        q, node = near(code, tree, np.arange(a, b), radius)
        pick = node < q
        q, node = q[pick], node[pick]
        if sketch is None:
            join(label, q, node)
        else:
            join_alike(label, q, node, sketch, sets, least_alike)
    rows = np.flatnonzero(label != np.arange(n))
    return rows, label[rows]


def jaccard(a, b) -> float:
    """Of two buffers of sorted distinct 64-bit hashes."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def join_alike(label: np.ndarray, q: np.ndarray, node: np.ndarray, sketch: np.ndarray, sets: list, least: float) -> None:
    """Join the pairs whose sets are alike; sketches that are far apart rule a pair out before. Each row's pairs are tried one, two, four ... at a time, and those that have met by then are passed over, so a dense group costs few comparisons."""
    order = np.lexsort((node, q))
    q, node = q[order], node[order]
    most = 1
    while len(q):
        apart = label[q] != label[node]
        q, node = q[apart], node[apart]
        if not len(q):
            return
        first = np.concatenate(([True], q[1:] != q[:-1]))
        rank = np.arange(len(q)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        now = np.flatnonzero(rank < most)
        for k in range(0, len(now), 50_000):
            part = now[k : k + 50_000]
            ok = part[alike(sketch[q[part]], sketch[node[part]]) >= least - MARGIN]
            ok = np.array([k for k in ok if jaccard(sets[q[k]], sets[node[k]]) >= least], dtype=np.int64)
            join(label, q[ok], node[ok])
        q, node = q[rank >= most], node[rank >= most]
        most *= 2


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the linked rows' labels in place; a label is the smallest row of its part."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label[:] = up
