"""An order of documents in which those that share terms stand near each other, learned from a bounded sample."""

from __future__ import annotations

import numpy as np

K1, B = 1.2, 0.75
#: Directions of the term space, documents from which they are learned, and rounds of subspace iteration.
DIMS, BASIS_DOCS, ROUNDS = 64, 2048, 3


class TermSpace:
    """BM25 vectors of length 1, projected to the leading directions of a sample.

    `idf` has one entry per term of the vocabulary, 0 for terms that no document has. A projection depends on the document alone.
    """

    def __init__(self, sample: list[np.ndarray], idf: np.ndarray, mean_length: float) -> None:
        self.idf, self.mean_length = idf, mean_length
        self.basis = np.random.default_rng(17).standard_normal((len(idf), DIMS)).astype(np.float32)
        if not sample:
            return
        doc, term, weight, starts = self._vectors(sample)
        by_term = np.argsort(term, kind="stable")
        known, begins = np.unique(term[by_term], return_index=True)
        for _ in range(ROUNDS):
            points = np.add.reduceat(self.basis[term] * weight[:, None], starts)
            points -= points.mean(0)
            back = np.add.reduceat(points[doc[by_term]] * weight[by_term, None], begins)
            self.basis = np.zeros_like(self.basis)
            self.basis[known, : min(DIMS, len(known))] = np.linalg.qr(back)[0]

    def points(self, docs: list[np.ndarray], most: int = 256) -> np.ndarray:
        out = np.empty((len(docs), DIMS), np.float32)
        for first in range(0, len(docs), most):
            _, term, weight, starts = self._vectors(docs[first : first + most])
            for at, begin, end in zip(range(first, len(docs)), starts, [*starts[1:], len(term)]):
                rows = self.basis.take(term[begin:end], 0)  # of one document, which fit the processor's cache
                rows *= weight[begin:end, None]
                rows.sum(0, out=out[at])
        return out

    def _vectors(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, weight) of all postings, by document and term, and where each document begins."""
        lengths, terms = np.array([len(d) for d in docs]), len(self.idf)
        kind = np.int32 if len(docs) * terms < 1 << 31 else np.int64
        pairs = np.sort(np.repeat(np.arange(len(docs), dtype=kind) * kind(terms), lengths) + np.concatenate(docs).astype(kind))
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        count = np.diff(first, append=len(pairs))
        doc, term = np.divmod(pairs[first], kind(terms))
        scale = K1 * (1 - B + B * lengths / self.mean_length)
        weight = self.idf[term] * count * (K1 + 1) / (count + scale[doc])
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        norm = np.sqrt(np.add.reduceat(weight * weight, starts))
        return doc, term, (weight / np.maximum(norm, 1e-30)[doc]).astype(np.float32), starts


class LexicalTree:
    """Halves a sample of points again and again, each part along the direction in which it differs most."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.directions = np.zeros(((1 << depth) - 1, DIMS), np.float32)
        self.thresholds = np.zeros(len(self.directions), np.float32)
        node = np.zeros(len(sample), np.int64)
        for level in range(depth):
            first = (1 << level) - 1
            order = np.argsort(node, kind="stable")
            ends = np.searchsorted(node[order], np.arange(first, 2 * first + 2))
            for at, begin, end in zip(range(first, 2 * first + 1), ends, ends[1:]):
                if end - begin > 1:
                    inside = sample[order[begin:end]]
                    self.directions[at] = np.linalg.eigh(np.cov(inside, rowvar=False))[1][:, -1]
                    self.thresholds[at] = np.median((inside * self.directions[at]).sum(1))
            node = self._down(sample, node)

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """Numbers from 0, near ones for points that part late."""
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = self._down(points, node)
        return node - ((1 << self.depth) - 1)

    def _down(self, points: np.ndarray, node: np.ndarray) -> np.ndarray:
        # Sums by row, not a matrix product: its last bits would depend on the other rows.
        return 2 * node + 1 + ((points * self.directions[node]).sum(1) > self.thresholds[node])
