"""Signature trees over token sets and their dual traversal.

A leaf holds up to LEAF sets, an inner node up to FANOUT nodes. A node keeps
the OR of its sets' bitmaps, the range of their sizes, the smallest number of
bits set, and the class of all of them, if it is one. Two nodes are compared
by the largest overlap that any pair below can have: of a set with s tokens
and b bits, at least b - |bits shared| tokens lie outside the other. If that
falls short of what the threshold needs for the smallest sizes, or the sizes
are too far apart, or all sets are of one class, nothing below is visited.
"""

from __future__ import annotations

import numpy as np

BITS = 2048
WORDS = BITS // 64
LEAF, FANOUT = 32, 8
U = np.uint64
#: Jaccard threshold as a fraction: 3/4.
NUM, DEN = 3, 4


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """The bitmap of a set of 64-bit hashes."""
    out = np.zeros(BITS, dtype=np.uint8)
    out[(tokens >> U(7)).astype(np.int64) % BITS] = 1
    return np.packbits(out).view(U)


def wide_bitmap(tokens: np.ndarray) -> bytes:
    """A bitmap of at least four bits per token, a power of two in size."""
    size = 1 << max(8, (4 * len(tokens) - 1).bit_length())
    out = np.zeros(size, dtype=np.uint8)
    out[(tokens >> U(7)).astype(np.int64) & (size - 1)] = 1
    return np.packbits(out).tobytes()


def can_link(n1: int, wide1: np.ndarray, n2: int, wide2: np.ndarray) -> bool:
    """Whether two sets can reach the threshold, by their wide bitmaps (bytes); the wider one is folded."""
    k = min(len(wide1), len(wide2))
    x, y = (np.bitwise_or.reduce(w.reshape(-1, k), axis=0).view(U) for w in (wide1, wide2))
    p1, p2, shared = (int(np.bitwise_count(z).sum()) for z in (x, y, x & y))
    return bool(_possible(n1, n1, p1, n2, n2, p2, shared))


def _possible(n1, m1, p1, n2, m2, p2, shared) -> np.ndarray:
    """Whether sets of sizes n1..m1 and n2..m2 with at least p1, p2 bits, shared of them common, can reach the threshold."""
    close = (DEN * m1 >= NUM * n2) & (DEN * m2 >= NUM * n1)
    most = np.minimum(m1 - np.maximum(0, p1 - shared), m2 - np.maximum(0, p2 - shared))
    # overlap >= t / (1 + t) * (|a| + |b|)
    return close & ((NUM + DEN) * most >= NUM * (n1 + n2))


class SignatureTree:
    def __init__(self, sizes: np.ndarray, bits: np.ndarray, classes: np.ndarray, largest: np.ndarray, wide: list[bytes | None] | None = None) -> None:
        """sizes (m), bits (m, WORDS), classes (m), largest (m): pairs within a class, or with a partner over largest, are not looked for.

        wide: wide bitmaps of large sets, for which BITS tell too little; they are asked pair by pair.
        """
        self.order = np.lexsort((classes, bits[:, 0], sizes))
        self.sizes, self.bits, self.classes, self.largest = sizes[self.order], bits[self.order], classes[self.order], largest[self.order]
        self.wide = [np.frombuffer(wide[k], dtype=np.uint8) if wide[k] is not None else None for k in self.order] if wide is not None else None
        self.pops = np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        m = len(sizes)
        cut = np.arange(0, m, LEAF)
        single = lambda c, k: np.where(np.minimum.reduceat(c, k) == np.maximum.reduceat(c, k), np.minimum.reduceat(c, k), -1)
        level = {
            "or": np.bitwise_or.reduceat(self.bits, cut, axis=0),
            "min": np.minimum.reduceat(self.sizes, cut), "max": np.maximum.reduceat(self.sizes, cut), "most": np.maximum.reduceat(self.largest, cut),
            "pop": np.minimum.reduceat(self.pops, cut), "class": single(self.classes, cut),
        }
        self.levels = [level]
        while len(level["min"]) > FANOUT:
            cut = np.arange(0, len(level["min"]), FANOUT)
            level = {
                "or": np.bitwise_or.reduceat(level["or"], cut, axis=0),
                "min": np.minimum.reduceat(level["min"], cut), "max": np.maximum.reduceat(level["max"], cut), "most": np.maximum.reduceat(level["most"], cut),
                "pop": np.minimum.reduceat(level["pop"], cut), "class": single(level["class"], cut),
            }
            self.levels.append(level)

    def _survive(self, depth: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x = self.levels[depth]
        out = np.empty(len(i), dtype=bool)
        for k in range(0, len(i), 65536):
            a, b = i[k : k + 65536], j[k : k + 65536]
            shared = np.bitwise_count(x["or"][a] & x["or"][b]).sum(axis=1).astype(np.int64)
            keep = _possible(x["min"][a], x["max"][a], x["pop"][a], x["min"][b], x["max"][b], x["pop"][b], shared)
            keep &= (x["min"][b] <= x["most"][a]) & (x["min"][a] <= x["most"][b])
            out[k : k + 65536] = keep & ~((x["class"][a] == x["class"][b]) & (x["class"][a] >= 0))
        return out

    def leaf_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves that the dual traversal reaches."""
        depth = len(self.levels) - 1
        i, j = np.triu_indices(len(self.levels[depth]["min"]))
        while True:
            keep = self._survive(depth, i, j)
            i, j = i[keep], j[keep]
            if not depth:
                return i, j
            depth -= 1
            n = len(self.levels[depth]["min"])
            a = (i[:, None] * FANOUT + np.repeat(np.arange(FANOUT), FANOUT)[None, :]).ravel()
            b = (j[:, None] * FANOUT + np.tile(np.arange(FANOUT), FANOUT)[None, :]).ravel()
            ok = (a <= b) & (a < n) & (b < n)
            i, j = a[ok], b[ok]

    def candidates(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of sets between two leaves that can reach the threshold."""
        p, q = slice(a * LEAF, a * LEAF + LEAF), slice(b * LEAF, b * LEAF + LEAF)
        shared = np.bitwise_count(self.bits[p][:, None, :] & self.bits[q][None, :, :]).sum(axis=2).astype(np.int64)
        s1, s2, p1, p2 = self.sizes[p][:, None], self.sizes[q][None, :], self.pops[p][:, None], self.pops[q][None, :]
        ok = _possible(s1, s1, p1, s2, s2, p2, shared) & (self.classes[p][:, None] != self.classes[q][None, :])
        ok &= (s2 <= self.largest[p][:, None]) & (s1 <= self.largest[q][None, :])
        x, y = np.nonzero(np.triu(ok, 1) if a == b else ok)
        return x + a * LEAF, y + b * LEAF

    def likely(self, x: int, y: int) -> bool:
        """Whether the wide bitmaps, if both sets have one, leave the pair possible."""
        if self.wide is None or self.wide[x] is None or self.wide[y] is None:
            return True
        return can_link(int(self.sizes[x]), self.wide[x], int(self.sizes[y]), self.wide[y])

    def pairs(self, spanning: bool) -> tuple[np.ndarray, np.ndarray]:
        """Candidate pairs as places of the input; with spanning, a forest that joins whatever candidates join."""
        out_i, out_j = [], []
        parent = list(range(len(self.sizes)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        leaves_i, leaves_j = self.leaf_pairs()
        if spanning:  # within leaves first
            first = np.argsort(leaves_i != leaves_j, kind="stable")
            leaves_i, leaves_j = leaves_i[first], leaves_j[first]
        whole: dict[int, int] = {}

        def one_root(leaf: int) -> int:
            r = whole.get(leaf)
            if r is not None:
                return root(r)
            roots = {root(x) for x in range(leaf * LEAF, min(leaf * LEAF + LEAF, len(parent)))}
            if len(roots) == 1:
                whole[leaf] = roots.pop()
                return root(whole[leaf])
            return -1

        for a, b in zip(leaves_i.tolist(), leaves_j.tolist(), strict=True):
            if spanning and a != b and (r := one_root(a)) >= 0 and r == one_root(b):
                continue
            x, y = self.candidates(a, b)
            if not spanning:
                if self.wide is not None and len(x):
                    keep = np.array([self.likely(u, v) for u, v in zip(x.tolist(), y.tolist(), strict=True)])
                    x, y = x[keep], y[keep]
                out_i.append(x)
                out_j.append(y)
                continue
            for u, v in zip(x.tolist(), y.tolist(), strict=True):
                ru, rv = root(u), root(v)
                if ru != rv and self.likely(u, v):
                    parent[max(ru, rv)] = min(ru, rv)
                    out_i.append(np.array([u]))
                    out_j.append(np.array([v]))
        if not out_i:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        return self.order[np.concatenate(out_i)], self.order[np.concatenate(out_j)]
