"""A navigable small-world graph over Hamming distance, searched for whole batches of queries at once.

Nodes are inserted in a random order, in batches that grow with the graph; each is linked both ways to the nearest nodes
that a beam search of the graph so far finds.  Links made early span far, late ones near, and none is pruned, so
greedy beams get from anywhere to a query's neighbourhood.  A range search keeps a beam of the best nodes seen and
widens it for each query whose beam may not hold all of its neighbours yet.

All state of a batch of searches is one sorted array of 64-bit keys: query (20 bits), distance (10), node (32), and
whether the node's links are still to be followed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from cinnabar.llm.textkern import mix64, ragged

U64 = np.uint64
OPEN = U64(1)
BATCH = 8192
#: Doublings of a beam that met none but nodes of the query's own component, after which it isn't doubled again.
STALE = 2
#: Nodes in the beams of a batch, at most.
ROOM = 1 << 18
#: Distances that are computed at a time.
BLOCK = 1 << 15


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def between(codes: np.ndarray, node: np.ndarray, queries: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The distance of each of these nodes to the query beside it."""
    out = np.empty(len(node), np.int64)
    for k in range(0, len(node), BLOCK):
        out[k : k + BLOCK] = hamming(codes[node[k : k + BLOCK]], queries[query[k : k + BLOCK]])
    return out


def _keys(query: np.ndarray, dist: np.ndarray, node: np.ndarray) -> np.ndarray:
    return (query.astype(U64) << U64(43)) | (dist.astype(U64) << U64(33)) | (node.astype(U64) << U64(1)) | OPEN


def _query(keys: np.ndarray) -> np.ndarray:
    return (keys >> U64(43)).astype(np.int64)


def _dist(keys: np.ndarray) -> np.ndarray:
    return ((keys >> U64(33)) & U64(1023)).astype(np.int64)


def _node(keys: np.ndarray) -> np.ndarray:
    return ((keys >> U64(1)) & U64(0xFFFFFFFF)).astype(np.int64)


def _beams(keys: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The best `width` distinct nodes of each query; of an open and a closed copy of a node the closed one stays."""
    keys.sort()
    same = np.zeros(len(keys), bool)
    same[1:] = (keys[1:] | OPEN) == (keys[:-1] | OPEN)
    keys = keys[~same]
    query = _query(keys)
    first = np.searchsorted(query, np.arange(len(width)))
    return keys[np.arange(len(keys)) - first[query] < width[query]]


class SmallWorld:
    def __init__(self, codes: np.ndarray, links: int = 10, beam: int = 24, follow: int = 4) -> None:
        """codes: distinct rows of 64-bit words."""
        self.codes, self.links, self.beam, self.follow = codes, links, beam, follow
        self.order = np.argsort(mix64(np.arange(len(codes), dtype=U64), 9))
        self._one, self._two = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        self._build()

    def _index(self, n: int) -> None:
        """Adjacency of all links so far as offsets and targets."""
        one, two = np.concatenate(self._one), np.concatenate(self._two)
        both = np.unique((np.concatenate([one, two]).astype(U64) << U64(32)) | np.concatenate([two, one]).astype(U64))
        source = (both >> U64(32)).astype(np.int64)
        self.to = (both & U64(0xFFFFFFFF)).astype(np.int64)
        self.degree = np.bincount(source, minlength=len(self.codes))
        self.at = np.cumsum(self.degree) - self.degree
        self.entries = self.order[: min(16, n)]

    def _build(self) -> None:
        n, done = len(self.codes), min(64, len(self.codes))
        head = self.order[:done]
        dist = np.bitwise_count(self.codes[head][:, None] ^ self.codes[head][None]).sum(-1)
        near = np.argsort(dist, axis=1, kind="stable")[:, 1 : self.links + 1]
        self._one.append(np.repeat(head, near.shape[1]))
        self._two.append(head[near.ravel()])
        self._index(done)
        while done < n:
            batch = self.order[done : done + min(BATCH, max(16, done // 3))]
            keys = self.search(self.codes[batch], np.full(len(batch), self.beam))
            query = _query(keys)
            first = np.searchsorted(query, np.arange(len(batch)))
            best = np.arange(len(keys)) - first[query] < self.links
            self._one.append(batch[query[best]])
            self._two.append(_node(keys[best]))
            done += len(batch)
            self._index(done)

    def search(self, queries: np.ndarray, width: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
        """The beams, of the given widths, of a batch of queries (fewer than 2^20); `keys` goes on from earlier beams."""
        n = len(queries)
        if keys is None:
            query = np.repeat(np.arange(n), len(self.entries))
            node = np.tile(self.entries, n)
            keys = _beams(_keys(query, between(self.codes, node, queries, query), node), width)
        ended = []
        while True:
            still = np.flatnonzero(keys & OPEN)
            if not len(still):
                return np.sort(np.concatenate([*ended, keys]))
            query = _query(keys[still])
            active = np.zeros(n, bool)
            active[query] = True
            going = active[_query(keys)]
            if going.mean() < 0.7:  # beams that are complete are set aside
                ended.append(keys[~going])
                keys = keys[going]
                still = np.flatnonzero(keys & OPEN)
            first = np.searchsorted(query, np.arange(n))
            still = still[np.arange(len(still)) - first[query] < self.follow]
            query, node = _query(keys[still]), _node(keys[still])
            keys[still] &= ~OPEN
            degree = self.degree[node]
            target, query = self.to[ragged(self.at[node], degree)], np.repeat(query, degree)
            dist = between(self.codes, target, queries, query)
            all_queries = _query(keys)
            size = np.bincount(all_queries, minlength=n)
            worst = np.where(size >= width, _dist(keys)[np.cumsum(size) - 1], 1023)
            good = dist < worst[query]
            keys = _beams(np.concatenate([keys, _keys(query[good], dist[good], target[good])]), width)

    def within(self, queries: np.ndarray, radius: int, beam: int, linked: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Parts of (query, node, distance) of all nodes found within the radius.

        The beam of a query is doubled until its outer half holds no neighbour and doubling finds no further one.
        Beams of more than ROOM nodes in all are searched in halves, so that memory is bounded.
        linked tells of (query, node) whether they are known to be in one component, given all parts so far.  With it
        the beam isn't doubled again once a doubling has found no node of another component: a query amid thousands
        of copies needn't name them all.
        """
        for start in range(0, len(queries), BATCH):
            part = queries[start : start + BATCH]
            rows = np.arange(len(part))
            width = np.full(len(part), beam)
            todo = [(rows, np.full(len(part), -1), np.zeros(len(part), np.int64), width, self.search(part, width))]
            while todo:
                rows, before, stale, width, keys = todo.pop()
                inside = _dist(keys) <= radius
                query = _query(keys)
                hits = np.bincount(query[inside], minlength=len(rows))
                more = (hits > 0) & (hits * 2 > width) | (hits > 0) & (before >= 0) & (hits > before)
                more &= width < 2 * len(self.codes)
                ended = keys[inside & ~more[query]]
                if linked:  # all that is found is said at once, as it unites components
                    ended = keys[inside]
                    fresh = ~linked(rows[query[inside]] + start, _node(ended))
                    stale = np.where(np.bincount(query[inside][fresh], minlength=len(rows)) > 0, 0, stale + 1)
                    more &= stale < STALE
                yield rows[_query(ended)] + start, _node(ended), _dist(ended)
                if not more.any():
                    continue
                keys = keys[more[query]]
                query = (np.cumsum(more) - 1)[_query(keys)]
                keys = _keys(query, _dist(keys), _node(keys))
                rows, before, stale, width = rows[more], hits[more], stale[more], width[more] * 2
                pieces = min(len(rows), -(-int(np.minimum(width, len(self.codes)).sum()) // ROOM))
                for some in np.array_split(np.arange(len(rows)), pieces):
                    own = keys[(query >= some[0]) & (query <= some[-1])] - (U64(some[0]) << U64(43))
                    todo.append((rows[some], before[some], stale[some], width[some], self.search(part[rows[some]], width[some], own)))


def exact_within(codes: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Brute force: (query, node) of all pairs within the radius."""
    one, two = [], []
    for k, q in enumerate(queries):
        hit = np.flatnonzero(np.bitwise_count(codes ^ q).sum(axis=1) <= radius)
        one.append(np.full(len(hit), k))
        two.append(hit)
    return (np.concatenate(one), np.concatenate(two)) if one else (np.empty(0, np.int64), np.empty(0, np.int64))


def components(root: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component, given those so far and more edges (hook and shortcut until nothing changes)."""
    while True:
        a, b = root[one], root[two]
        apart = a != b
        if not apart.any():
            return root
        one, two = one[apart], two[apart]
        low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        root = root.copy()
        np.minimum.at(root, high, low)
        while True:
            short = root[root]
            if (short == root).all():
                break
            root = short
