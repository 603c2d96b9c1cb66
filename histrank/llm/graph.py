"""Robust-pruned directed graphs over unit vectors: building by batches, and beam search.

Vectors are inserted in batches that double in size.  For each batch a greedy beam search over the graph so far
proposes neighbours; relaxed distance pruning (alpha) keeps near and diverse ones; the reverse edges are added
and lists that grow too long are pruned again.  All steps run on whole batches of queries at once.
Distances are 1 - cosine.
"""

from __future__ import annotations

import numpy as np

#: Out-neighbours of each vector.
DEGREE = 24
#: Length of the beam when building and when searching.
BEAM = 40
#: Relaxation: a neighbour is dropped if one nearer to the vector is alpha times nearer to it.
ALPHA = 1.2
#: Vectors (chosen by stride) that every search is compared with to find its entry points, and entry points used.
ENTRIES, STARTS = 256, 8
#: Queries that are searched at once.
BLOCK = 1024


def _nearest(q: np.ndarray, x: np.ndarray, entries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    d = 1 - q @ x[entries].T
    k = min(k, len(entries))
    at = np.argpartition(d, k - 1, axis=1)[:, :k]
    return entries[at], np.take_along_axis(d, at, 1)


def beam_search(q: np.ndarray, x: np.ndarray, links: np.ndarray, entries: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the beam nearest vectors found for each row of q, nearest first; -1 where there are fewer.

    In each step the `width` nearest vectors not yet visited of every query are expanded together.
    """
    n = len(q)
    ids = np.full((n, beam), -1, np.int32)
    dist = np.full((n, beam), np.inf, np.float32)
    done = np.zeros((n, beam), bool)
    seen = np.zeros(n * len(x), bool)  # each vector is compared with a query once
    base = np.arange(n, dtype=np.int64) * len(x)
    start, d = _nearest(q, x, entries, STARTS)
    order = np.argsort(d, axis=1)[:, :beam]
    k = order.shape[1]
    ids[:, :k], dist[:, :k] = np.take_along_axis(start, order, 1), np.take_along_axis(d, order, 1)
    seen[(base[:, None] + start).ravel()] = True
    active = np.arange(n)
    while len(active):
        open_ = ~done[active] & (ids[active] >= 0)
        more = open_.any(axis=1)
        active, open_ = active[more], open_[more]
        if not len(active):
            break
        pick = open_ & (np.cumsum(open_, axis=1, dtype=np.int16) <= width)
        cur_ids = ids[active]
        done[active] |= pick
        rows, cols = np.nonzero(pick)
        hops = links[cur_ids[rows, cols]]
        flat = (base[active[rows]][:, None] + hops)[hops >= 0]
        flat = flat[~seen[flat]]
        if not len(flat):
            continue
        flat.sort()
        flat = flat[np.append(True, flat[1:] != flat[:-1])]
        seen[flat] = True
        owner, new = np.divmod(flat, len(x))
        near = 1 - np.einsum("ij,ij->i", x[new], q[owner])
        better = near < dist[owner, -1]
        owner, new, near = owner[better], new[better], near[better]
        if not len(owner):
            continue
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))  # owners are in order
        rows, counts = owner[first], np.diff(np.append(first, len(owner)))
        slot = np.arange(len(owner)) - np.repeat(first, counts)
        line = np.repeat(np.arange(len(rows)), counts)
        add_ids = np.full((len(rows), int(counts.max())), -1, np.int32)
        add_dist = np.full(add_ids.shape, np.inf, np.float32)
        add_ids[line, slot], add_dist[line, slot] = new, near
        all_dist = np.concatenate([dist[rows], add_dist], axis=1)
        order = np.argsort(all_dist, axis=1)[:, :beam]
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], add_ids], axis=1), order, 1)
        dist[rows] = np.take_along_axis(all_dist, order, 1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], np.zeros(add_ids.shape, bool)], axis=1), order, 1)
    return ids, dist


def robust_prune(points: np.ndarray, cand: np.ndarray, dist: np.ndarray, x: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most `degree` near and diverse candidates of each point; cand rows are ordered by dist, -1 fills up."""
    n, m = cand.shape
    alive = (cand >= 0) & (cand != points[:, None])
    out = np.full((n, degree), -1, np.int32)
    vecs = x[np.maximum(cand, 0)]
    between = 1 - vecs @ vecs.transpose(0, 2, 1)
    count = np.zeros(n, np.int64)
    rows = np.arange(n)
    for _ in range(degree):
        any_ = alive.any(axis=1)
        if not any_.any():
            break
        first = alive.argmax(axis=1)
        r = rows[any_]
        out[r, count[any_]] = cand[r, first[any_]]
        count[any_] += 1
        alive[r, first[any_]] = False
        alive[any_] &= ~(alpha * between[r, first[any_]] <= dist[any_])
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(links, entries) of the graph over the unit vectors x."""
    n = len(x)
    links = np.full((n, degree), -1, np.int32)
    entries = np.arange(0, n, max(1, n // ENTRIES), dtype=np.int32)[:ENTRIES] if n else np.zeros(0, np.int32)
    rest = np.setdiff1d(np.arange(n, dtype=np.int32), entries)
    rest = rest[np.random.default_rng(7).permutation(len(rest))]
    if n:
        _insert(entries, x, links, entries, degree, beam, alpha, among=entries)
    done, size = 0, max(64, len(entries))
    while done < len(rest):
        batch = rest[done : done + size]
        for at in range(0, len(batch), BLOCK):
            _insert(batch[at : at + BLOCK], x, links, entries, degree, beam, alpha)
        done += len(batch)
        size *= 2
    return links, entries


def _insert(points: np.ndarray, x: np.ndarray, links: np.ndarray, entries: np.ndarray, degree: int, beam: int, alpha: float, among: np.ndarray | None = None) -> None:
    if among is not None:
        cand, dist = _nearest(x[points], x, among, beam)
        order = np.argsort(dist, axis=1, kind="stable")
        cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
    else:
        cand, dist = beam_search(x[points], x, links, entries, beam)
    # points of one batch don't meet each other in the graph: their nearest in the batch are candidates as well
    if len(points) > 1:
        near, d = _nearest(x[points], x, points, min(8, len(points)))
        cand, dist = np.concatenate([cand, near.astype(np.int32)], 1), np.concatenate([dist, d.astype(np.float32)], 1)
        cand, dist = _tidy(cand, dist)
    links[points] = robust_prune(points, cand, dist, x, degree, alpha)
    src = np.repeat(points, degree)
    dst = links[points].ravel()
    ok = dst >= 0
    src, dst = src[ok], dst[ok]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    targets, first, counts = np.unique(dst, return_index=True, return_counts=True)
    most = 2 * degree  # in-edges of one batch that a list looks at; nearest first
    d = 1 - np.einsum("ij,ij->i", x[src], x[dst])
    order = np.lexsort((d, dst))
    src, d = src[order], d[order]
    slot = np.arange(len(src)) - np.repeat(first, counts)
    fits = slot < most
    extra = np.full((len(targets), min(most, int(counts.max()) if len(counts) else 0)), -1, np.int32)
    row = np.repeat(np.arange(len(targets)), counts)
    extra[row[fits], slot[fits]] = src[fits]
    for at in range(0, len(targets), BLOCK):
        t = targets[at : at + BLOCK]
        both = np.concatenate([links[t], extra[at : at + BLOCK]], axis=1)
        dd = np.where(both >= 0, 1 - (x[np.maximum(both, 0)] @ x[t][:, :, None])[:, :, 0], np.inf).astype(np.float32)
        both, dd = _tidy(both, dd)
        small = (both >= 0).sum(axis=1) <= degree
        pruned = both[:, :degree].copy() if both.shape[1] >= degree else np.pad(both, ((0, 0), (0, degree - both.shape[1])), constant_values=-1)
        if (~small).any():
            pruned[~small] = robust_prune(t[~small], both[~small], dd[~small], x, degree, alpha)
        links[t] = pruned


def _tidy(cand: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ordered by distance, repeats and gaps (-1) last."""
    by_id = np.argsort(cand, axis=1, kind="stable")
    ids = np.take_along_axis(cand, by_id, 1)
    d = np.take_along_axis(dist, by_id, 1)
    gap = ids < 0
    gap[:, 1:] |= ids[:, 1:] == ids[:, :-1]
    ids, d = np.where(gap, -1, ids), np.where(gap, np.inf, d).astype(np.float32)
    order = np.argsort(d, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
