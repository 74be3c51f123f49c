"""Exact best scores of many queries against many vectors, a block of products at a time.

A matrix product gives every score of a block; only what may still be among a
query's best ``k`` is summed again in the order of the components, as SQL does,
and rounded to six digits. What leaves a task is its best ``k`` of each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Vectors of a block, and scores of a tile of queries and such a block.
BLOCK, SCORES = 2048, 1_000_000
#: Candidates of a query that are gathered, in multiples of ``k``, before they are ranked.
HELD = 4
FOUND = "qid bigint, vec_id bigint, score double"


def rounded(x: np.ndarray) -> np.ndarray:
    """Millionths, halves away from zero; a negative zero is zero."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5), x) + 0.0


def first_of(group: np.ndarray, k: int) -> np.ndarray:
    """Which of rows sorted by ``group`` are among the first ``k`` of theirs."""
    n = len(group)
    return np.arange(n) < k if n <= k else np.r_[np.ones(k, bool), group[k:] != group[:-k]]


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), dim or len(flat) // max(len(column), 1))


class Best:
    """The best ``k`` vectors of each query by (score, id), the query's own id left out.

    Products are in single precision where the numbers allow it; the bound of
    their error widens what is summed again.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.single = bool((self.norms < 1e15).all())
        self.short = vectors.astype(np.float32) if self.single else vectors
        self.least = np.full(len(ids), -np.inf)
        self.q, self.r, self.v = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for a in range(0, len(ids) if len(self.ids) else 0, BLOCK):
            self._block(ids[a : a + BLOCK], np.ascontiguousarray(vectors[a : a + BLOCK]))

    def _block(self, ids: np.ndarray, x: np.ndarray) -> None:
        # of equal vectors the smallest ids alone can be among the best; one more, since a query is not its own
        _, same = np.unique(x.view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)
        order = np.lexsort((ids, same.ravel()))
        order = order[first_of(same.ravel()[order], self.k + 1)]
        ids, x = ids[order], x[order]
        longest = np.sqrt((x * x).sum(axis=1).max())
        single = self.single and longest < 1e15
        left, right = (self.short, x.astype(np.float32).T) if single else (self.vectors, x.T)
        error = (1.2e-7 if single else 1e-15) * (x.shape[1] + 4)
        step = max(1, SCORES // len(ids))
        for a in range(0, len(self.ids), step):
            scores = left[a : a + step] @ right
            # products below the smallest normal number lose up to that much each
            slack = 1.2e-6 + error * self.norms[a : a + step] * longest + x.shape[1] * 1e-37
            floor = self.least[a : a + step]
            if len(ids) > self.k + 1 and np.isneginf(floor).any():
                floor = np.maximum(floor, np.partition(scores, len(ids) - 1 - self.k, axis=1)[:, len(ids) - 1 - self.k])
            low = floor - slack
            low = np.nextafter(low.astype(np.float32), np.float32(-np.inf)) if single else low
            at = np.flatnonzero(scores >= low[:, None])
            qi, vi = a + at // len(ids), at % len(ids)
            other = self.ids[qi] != ids[vi]
            self._gather(qi[other], vi[other], ids, x)
        if self.waiting >= HELD * self.k * len(self.ids) or np.isneginf(self.least).any():
            self._rank()

    def _gather(self, qi: np.ndarray, vi: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        exact = np.zeros(len(qi))
        for a in range(0, len(qi), 4096):
            products = self.vectors[qi[a : a + 4096]] * x[vi[a : a + 4096]]
            for j in range(x.shape[1]):
                exact[a : a + 4096] += products[:, j]
        r = rounded(exact)
        best = ~(r < self.least[qi] * 1e6 - 0.5)
        self.more.append((qi[best], r[best], ids[vi[best]]))
        self.waiting += int(best.sum())

    def _rank(self) -> None:
        q, r, v = (np.concatenate(x) for x in zip((self.q, self.r, self.v), *self.more, strict=True))
        self.more, self.waiting = [], 0
        order = np.lexsort((v, -r, q))
        order = order[first_of(q[order], self.k)]
        self.q, self.r, self.v = q[order], r[order], v[order]
        n = np.bincount(self.q, minlength=len(self.ids))
        full = n >= self.k
        self.least[full] = self.r[np.cumsum(n)[full] - 1] / 1e6

    def found(self) -> pa.RecordBatch:
        self._rank()
        return pa.record_batch([pa.array(self.ids[self.q]), pa.array(self.v), pa.array(self.r / 1e6)], names=["qid", "vec_id", "score"])


def streamed(k: int, *keys: str):
    """For mapInArrow: rows (keys, kind, id, vec) sorted by keys and kind, where queries (kind 0) come before the vectors (kind 1) that they meet."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, best = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in (*keys, "kind")], axis=1)
            seams = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(seams, seams[1:], strict=False):
                if a == b:
                    continue
                own, kind = tuple(key[a, :-1]), key[a, -1]
                if own != at:
                    if best is not None:
                        yield best.found()
                    at, asked, best = own, [], None
                part = batch.slice(a, b - a)
                rows = part.column("id").to_numpy(), matrix(part.column("vec"))
                if kind == 0:
                    asked.append(rows)
                elif asked:
                    if best is None:
                        best = Best(np.concatenate([i for i, _ in asked]), np.concatenate([x for _, x in asked]), k)
                    best.add(*rows)
        if best is not None:
            yield best.found()

    return of
