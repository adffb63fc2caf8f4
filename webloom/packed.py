"""A graph as arrays, for fixpoints that take jobs for every round as joins: each task holds the whole graph, and what is dealt out is damping factors,
scenarios or blocks of sources.

The graph is broadcast like the small side of a join, up to LIMIT vertices and edges together; a larger one takes the joins.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import Graph

#: Vertices and edges of a graph that is broadcast: arrays of under 200 MB.
LIMIT = 1 << 23
#: Pairs of source and vertex that a search holds at a time, unless a single source reaches more.
PAIRS = 1 << 21
#: Rounds of taking off vertices on no cycle before strong components are searched.
TRIMS = 50


@dataclass
class Arrays:
    ids: np.ndarray  # of the vertices, ascending; elsewhere a vertex is its place here
    src: np.ndarray  # links by source, then target
    dst: np.ndarray
    first: np.ndarray  # each source's first link (n + 1)
    out: np.ndarray  # out-degrees; links to ids that aren't vertices count here only


def of(graph: Graph) -> Broadcast | None:
    """The graph's arrays, kept with it; None if it is too large, or its ids aren't all whole numbers."""
    return graph.once("packed", lambda: _pack(graph))


def column(df: DataFrame, name: str) -> np.ndarray | None:
    """A long column, null values making it None."""
    values = df.select(name).toArrow().column(0)
    return None if values.null_count else values.to_numpy()


def _pack(graph: Graph) -> Broadcast | None:
    kinds = dict(graph.vertices.dtypes)["id"], *(dict(graph.edges.dtypes)[c] for c in ("src", "dst"))
    if set(kinds) != {"bigint"} or graph.vertices.count() + graph.edges.count() > LIMIT:
        return None
    ids, ends = column(graph.vertices, "id"), graph.edges.select("src", "dst").toArrow()
    if ids is None or any(c.null_count for c in ends.columns):
        return None
    ids, (src, dst) = np.unique(ids), (c.to_numpy() for c in ends.columns)
    (src, known), (dst, met) = places(ids, src), places(ids, dst)
    out, n = np.bincount(src[known], minlength=len(ids)), len(ids)
    links = np.sort(src[known & met] * n + dst[known & met])
    src, dst = (links // max(n, 1)).astype(np.int32), (links % max(n, 1)).astype(np.int32)
    return graph.vertices.sparkSession.sparkContext.broadcast(Arrays(ids, src, dst, starts(src, n), out))


def places(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value is in ids, and whether it is there at all."""
    at = np.minimum(np.searchsorted(ids, values), max(len(ids) - 1, 0))
    return at, ids[at] == values if len(ids) else np.zeros(len(values), bool)


def starts(src: np.ndarray, n: int) -> np.ndarray:
    first = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(src, minlength=n), out=first[1:])
    return first


def weak(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Each vertex's component by its smallest member: roots hook to the smallest root beside them, then all jump to their root."""
    comp = np.arange(n)
    while True:
        a, b = comp[src], comp[dst]
        apart = a != b
        if not apart.any():
            return comp
        src, dst, a, b = src[apart], dst[apart], a[apart], b[apart]
        np.minimum.at(comp, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = comp[comp]
            if np.array_equal(above, comp):
                break
            comp = above


def strong(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Each vertex's strong component by one of its members: Tarjan's search without recursion; src ascends."""
    for _ in range(TRIMS):
        entered, left = np.zeros(n, bool), np.zeros(n, bool)
        entered[dst], left[src] = True, True
        on = entered[src] & left[dst]
        if on.all():
            break
        src, dst = src[on], dst[on]
    first = starts(src, n)
    at, end, to = memoryview(first[:-1].copy()), memoryview(first[1:].copy()), memoryview(np.ascontiguousarray(dst))
    order, low, comp = array("i", [0]) * n, array("i", [0]) * n, array("i", range(n))
    t, open_, inside = 0, [], bytearray(n)
    for root in np.flatnonzero(np.diff(first)).tolist():
        if order[root]:
            continue
        path = [root]
        while path:
            v = path[-1]
            if not order[v]:
                t += 1
                order[v] = low[v] = t
                open_.append(v)
                inside[v] = 1
            i = at[v]
            if i < end[v]:
                at[v] = i + 1
                w = to[i]
                if not order[w]:
                    path.append(w)
                elif inside[w] and order[w] < low[v]:
                    low[v] = order[w]
                continue
            path.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == order[v]:
                w = -1
                while w != v:
                    w = open_.pop()
                    inside[w] = 0
                    comp[w] = v
    return np.array(comp, np.int64)


def distances(first: np.ndarray, dst: np.ndarray, here: np.ndarray, sources: np.ndarray) -> tuple[float, int, int]:
    """Sum of the sources' mean distances to all others that they reach, how many reach one, and the largest distance; only over vertices that are `here`.

    All sources take a step together; a block that reaches more than PAIRS is halved.
    """
    n, front, k, far = len(first) - 1, np.arange(len(sources)) * (len(first) - 1) + sources, 0, 0
    seen, total, count = front, np.zeros(len(sources), np.int64), np.zeros(len(sources), np.int64)
    while len(front):
        k += 1
        who, at = np.divmod(front, n)
        links = first[at + 1] - first[at]
        if len(sources) > 1 and max(len(seen), links.sum()) > PAIRS:
            half = len(sources) // 2
            a, b = (distances(first, dst, here, x) for x in (sources[:half], sources[half:]))
            return a[0] + b[0], a[1] + b[1], max(a[2], b[2])
        to = dst[np.repeat(first[at] - (np.cumsum(links) - links), links) + np.arange(links.sum())]
        keys = (np.repeat(who, links) * n + to)[here[to]]
        keys = np.unique(keys)
        place = np.searchsorted(seen, keys)
        new = seen[np.minimum(place, len(seen) - 1)] != keys
        front = keys[new]
        if len(front):
            per = np.bincount(front // n, minlength=len(sources))
            count, total, far = count + per, total + k * per, k
            seen = np.insert(seen, place[new], front)
    some = count > 0
    return float((total[some] / count[some]).sum()), int(some.sum()), far
