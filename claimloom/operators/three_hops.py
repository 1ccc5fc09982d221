"""Three-hop paths of one block of start nodes, added up per pair in Arrow batches.

Python, because the adjacency that a block shares is looked up twice per path, which no built-in operator does without a shuffle of the paths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Paths that are held at once, about.  Where start nodes have many more, paths are first added up per node at two hops, so a hub holds at most the edges of its block.
PATHS = 250_000
#: Up to so many cells per path, sums are kept in a table of all pairs of the start nodes at hand; beyond, pairs are sorted.
CELLS = 16


def three_hops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, paths, support, penalty) of a block from its rows (src, h, dsts, weights, own): successors with weights and 1 + log(1 + degree) of each node it reaches.

    ``own`` marks the start nodes u; rows without weights hold further observed links of a start node.  Loops and observed links are left out.  A null weight adds nothing.
    """
    rows = pa.Table.from_batches(rows).combine_chunks() if (rows := list(batches)) else None
    if not rows:
        return
    column = lambda name: rows[name].combine_chunks()
    src, dsts, weights = column("src"), column("dsts"), column("weights")
    coded = pa.concat_arrays([src, dsts.flatten()]).dictionary_encode()
    codes, ids, size = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    node, ends = ids[: len(src)], ids[len(src) :]
    count, linked = dsts.value_lengths().to_numpy(zero_copy_only=False), weights.is_valid().to_numpy(zero_copy_only=False)
    of_link = np.repeat(linked, count)
    more_u, more_v = np.repeat(node, count)[~of_link], ends[~of_link]
    v, w = ends[of_link], weights.flatten().to_numpy(zero_copy_only=False).astype(float)
    node, count, h, own = node[linked], count[linked], column("h").to_numpy(zero_copy_only=False)[linked], column("own").to_numpy(zero_copy_only=False)[linked]
    start, length, disc = np.zeros(size, np.int64), np.zeros(size, np.int64), np.ones(size)
    start[node], length[node], disc[node] = np.cumsum(count) - count, count, h
    x, gaps = w / disc[v], bool(np.isnan(w).any())

    def below(values: np.ndarray) -> np.ndarray:
        """Sum of ``values`` of the successors of each node."""
        total = np.concatenate([[0], np.cumsum(values[v])])
        return total[start + length] - total[start]

    def edges_of(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of edges of each node, and the edges."""
        n = length[nodes]
        return n, np.arange(n.sum()) + np.repeat(start[nodes] - (np.cumsum(n) - n), n)

    us = node[own]
    place = np.full(size, -1)
    place[us] = np.arange(len(us))
    order = np.argsort(place[more_u], kind="stable")
    more_at, more_v = place[more_u][order], more_v[order]
    part = np.cumsum(below(below(length))[us]) // PATHS
    for lo, hi in zip(cuts := np.flatnonzero(np.diff(part, prepend=-1)), [*cuts[1:], len(us)]):
        u = us[lo:hi]
        n, e = edges_of(u)
        at, more = np.repeat(np.arange(len(u)) * size, n), slice(*np.searchsorted(more_at, [lo, hi]))
        gone = np.concatenate([np.arange(len(u)) * size + u, at + v[e], (more_at[more] - lo) * size + more_v[more]])
        n, f = edges_of(v[e])
        at, mid, s, s0, many, some = np.repeat(at, n), v[f], np.repeat(x[e], n) * x[f], np.repeat(w[e], n) * w[f], None, None
        if length[mid].sum() > 2 * PATHS:
            two, to = np.unique(at + mid, return_inverse=True)
            known = ~np.isnan(s)
            many, some = np.bincount(to), np.bincount(to, known)
            s, s0 = (np.bincount(to, np.where(known, sums, 0.0)) for sums in (s, s0))
            mid = two % size
            at = two - mid
        n, g = edges_of(mid)
        at, s, s0 = np.repeat(at, n) + v[g], np.repeat(s, n) * w[g], np.repeat(s0, n) * w[g]
        many, some = (None if c is None else np.repeat(c, n) for c in (many, some))
        if len(u) * size <= CELLS * len(at):
            paths = np.bincount(at, many, minlength=len(u) * size)
            paths[gone] = 0
            pair = cell = np.flatnonzero(paths)
            paths = paths[pair]
        else:
            pair, at = np.unique(at, return_inverse=True)
            paths = np.bincount(at, many)
            cell = np.flatnonzero(~np.isin(pair, gone))
            pair, paths = pair[cell], paths[cell]
        if not len(pair):
            continue
        none = None
        if gaps:
            some = ~np.isnan(s) * (1 if some is None else some)
            none = np.bincount(at, some)[cell] == 0
            s, s0 = np.where(some > 0, s, 0.0), np.where(some > 0, s0, 0.0)
        s, s0 = np.bincount(at, s)[cell], np.bincount(at, s0)[cell]
        yield pa.RecordBatch.from_arrays([codes.take(pa.array(u[pair // size])), codes.take(pa.array(pair % size)), pa.array(paths.astype(np.int64)), pa.array(s, mask=none), pa.array(s0 - s, mask=none)], ["u", "v", "paths", "support", "penalty"])
