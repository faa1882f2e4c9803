"""Subword lattice: log-space sums over every segmentation of a word.

A word is its byte string with one space in front.  Its segmentations are all
ways to cut it into vocabulary pieces; pieces never hold a space after their
first byte, so a text's lattice falls apart into the lattices of its words.
"""

from __future__ import annotations

import base64

import numpy as np

MULT = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
NEG = -np.inf


def read_pieces(path: str) -> list[bytes]:
    """Pieces of a public vocabulary file of ``base64 rank`` lines, in rank order."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    return [base64.b64decode(a) for a, _ in sorted(rows, key=lambda r: int(r[1]))]


class PieceTable:
    """Open-addressed lookup from the hash of a byte string to a piece number."""

    def __init__(self, pieces: list[bytes], bits: int = 20):
        keep = [(i, p) for i, p in enumerate(pieces) if p and b" " not in p[1:]]
        self.ids = np.array([i for i, _ in keep], dtype=np.int64)
        self.size = len(pieces)
        self.longest = max(len(p) for _, p in keep)
        self.shift = np.uint64(64 - bits)
        with np.errstate(over="ignore"):
            keys = np.array([self._hash(p) for _, p in keep], dtype=np.uint64)
            if len(np.unique(keys)) != len(keys):
                raise ValueError("two pieces share one 64-bit hash")
            self.layers = []
            left = np.arange(len(keys))
            mult = MIX
            while len(left):
                slots = ((keys[left] * mult) >> self.shift).astype(np.int64)
                _, first = np.unique(slots, return_index=True)
                table = np.full(1 << bits, -1, dtype=np.int32)
                table[slots[first]] = left[first]
                self.layers.append((mult, table))
                left = np.setdiff1d(left, left[first])
                mult = mult * MIX + np.uint64(2)
                mult |= np.uint64(1)
        self.keys = keys

    @staticmethod
    def _hash(p: bytes) -> np.uint64:
        h = np.uint64(0)
        for b in p:
            h = h * MULT + np.uint64(b + 1)
        return h

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row in ``ids`` for each hash, -1 where no piece has it."""
        out = np.full(hashes.shape, -1, dtype=np.int32)
        for mult, table in self.layers:
            row = table[((hashes * mult) >> self.shift).astype(np.int64)]
            hit = (row >= 0) & (self.keys[row] == hashes)
            out[hit] = row[hit]
        return out


def _matrix(words: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), length)


def _forward(mat: np.ndarray, table: PieceTable, logp: np.ndarray, edges: list | None = None):
    n, length = mat.shape
    alpha = np.full((n, length + 1), NEG)
    alpha[:, 0] = 0.0
    hashes = np.zeros((n, length), dtype=np.uint64)
    values = mat.astype(np.uint64) + np.uint64(1)
    padded = np.append(logp, NEG)
    for end in range(1, length + 1):
        lo = max(0, end - table.longest)
        with np.errstate(over="ignore"):
            hashes[:, lo:end] = hashes[:, lo:end] * MULT + values[:, end - 1 : end]
            row = table.find(hashes[:, lo:end])
        x = alpha[:, lo:end] + padded[row]
        top = x.max(axis=1)
        safe = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            alpha[:, end] = np.log(np.exp(x - safe[:, None]).sum(axis=1)) + safe
        if edges is not None:
            at, k = np.nonzero(row >= 0)
            edges.append((at, k + lo, row[at, k]))
    return alpha


def _by_length(words: list[bytes], cells: int):
    """Index batches of equal byte length, each of about ``cells`` matrix cells at most."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(lengths, kind="stable")
    bounds = np.flatnonzero(np.diff(lengths[order])) + 1
    for part in np.split(order, bounds):
        if len(part):
            step = max(1, cells // max(1, int(lengths[part[0]])))
            for i in range(0, len(part), step):
                yield int(lengths[part[0]]), part[i : i + step]


def log_marginals(words: list[bytes], table: PieceTable, logp: np.ndarray, cells: int = 400_000) -> np.ndarray:
    """Natural log of each word's probability, summed over all segmentations.

    ``logp`` is aligned with ``table.ids``.  An empty word gets 0.
    """
    out = np.zeros(len(words))
    for length, part in _by_length(words, cells):
        if length:
            out[part] = _forward(_matrix([words[i] for i in part], length), table, logp)[:, -1]
    return out


def expected_counts(words: list[bytes], weights: np.ndarray, table: PieceTable, logp: np.ndarray, cells: int = 200_000) -> np.ndarray:
    """Expected uses of each piece (aligned with ``table.ids``) over all segmentations, words weighted."""
    total = np.zeros(len(table.ids))
    for length, part in _by_length(words, cells):
        if not length:
            continue
        edges: list = []
        alpha = _forward(_matrix([words[i] for i in part], length), table, logp, edges)
        beta = np.full_like(alpha, NEG)
        beta[:, length] = 0.0
        w = weights[part]
        for end in range(length, 0, -1):
            at, start, row = edges[end - 1]
            if not len(at):
                continue
            flow = logp[row] + beta[at, end]
            share = np.exp(alpha[at, start] + flow - alpha[at, length]) * w[at]
            total += np.bincount(row, weights=share, minlength=len(total))
            # each (word, start) meets one edge per end, so plain assignment is safe
            beta[at, start] = np.logaddexp(beta[at, start], flow)
    return total
