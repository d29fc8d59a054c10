"""A bidirectional LSTM in numpy that labels every leaf block of a page.

Input per block: hashed words of its tag path, hashed words of its text, and a
few measures. Two LSTMs read the sequence in both directions, so that each label
depends on the whole page; a logistic unit reads both states.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np

from .html_blocks import Block

PATH_DIM, WORD_DIM, EXTRA = 192, 48, 8
DIM = PATH_DIM + WORD_DIM + EXTRA
HIDDEN = 24
#: Elements of a path, counted from the block, that weigh each for themselves.
NEAR = 12
PIECES = re.compile(r"[a-z]+|[^\W\d_a-z]+")


def _slot(word: str, dim: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % dim


class Featurizer:
    """Vectors of blocks; slots of recurring paths and words are kept."""

    def __init__(self) -> None:
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words: dict[str, int] = {}

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        v = self.paths.get(path)
        if v is None:
            if len(self.paths) > 50_000:
                self.paths.clear()
            v = np.zeros(PATH_DIM, dtype=np.float32)
            # the innermost NEAR elements one by one, those around them once for each name
            near, outer = path[-NEAR:], dict.fromkeys(path[:-NEAR])
            for weight, name in [(1.0 if depth == 0 else 0.7, x) for depth, x in enumerate(reversed(near))] + [(0.4, x) for x in outer if x not in near]:
                tag, *names = name.split(" ")
                v[_slot(f"<{tag}>", PATH_DIM)] += weight
                for piece in {x for n in names for x in PIECES.findall(n)}:
                    v[_slot(piece.rstrip("s") if len(piece) > 3 else piece, PATH_DIM)] += weight
            self.paths[path] = v
        return v

    def block(self, b: Block, at: float, before: float) -> np.ndarray:
        v = np.zeros(DIM, dtype=np.float32)
        v[:PATH_DIM] = self.path(b.path)
        words = b.text.lower().split(" ")
        if len(self.words) > 300_000:
            self.words.clear()
        get = self.words.get
        for w in words:
            k = get(w)
            if k is None:
                k = self.words[w] = _slot(w, WORD_DIM)
            v[PATH_DIM + k] += 1
        v[PATH_DIM : PATH_DIM + WORD_DIM] /= np.sqrt(len(words)) * 4
        n = len(b.text)
        v[-8:] = (min(np.log1p(n) / 8, 2), min(1.0, b.link_chars / n), float(b.text[-1] in ".!?…:;\"»"), at, before, len(b.path) / 12, float("©" in b.text), sum(map(b.text.count, ".,;")) / n)
        return v

    def page(self, blocks: list[Block]) -> np.ndarray:
        n = len(blocks)
        total = sum(len(b.text) for b in blocks) or 1
        out, seen = np.empty((n, DIM), dtype=np.float32), 0
        for k, b in enumerate(blocks):
            out[k] = self.block(b, k / n, seen / total)
            seen += len(b.text)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(w: np.ndarray, u: np.ndarray, b: np.ndarray, x: np.ndarray, keep: bool = False):
    """States (steps, batch, HIDDEN) of one LSTM over x (steps, batch, DIM); what the backward pass needs, if kept."""
    steps, batch, _ = x.shape
    h = np.zeros((batch, HIDDEN), dtype=np.float32)
    c = np.zeros_like(h)
    states = np.empty((steps, batch, HIDDEN), dtype=np.float32)
    tape = []
    lifted = x.reshape(steps * batch, -1) @ w + b
    lifted = lifted.reshape(steps, batch, -1)
    for t in range(steps):
        z = lifted[t] + h @ u
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        before = c
        c = f * c + i * g
        tc = np.tanh(c)
        if keep:
            tape.append((i, f, o, g, before, tc, h))
        h = o * tc
        states[t] = h
    return (states, tape) if keep else states


def _back(u: np.ndarray, x: np.ndarray, tape: list, grad: np.ndarray):
    """Gradients of w, u and b from those of the states."""
    steps, batch, dim = x.shape
    dz_all = np.empty((steps, batch, 4 * HIDDEN), dtype=np.float32)
    du = np.zeros_like(u)
    dh_next = np.zeros((batch, HIDDEN), dtype=np.float32)
    dc_next = np.zeros_like(dh_next)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, before, tc, h = tape[t]
        dh = grad[t] + dh_next
        dc = dc_next + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dz_all[t] = dz
        du += h.T @ dz
        dh_next = dz @ u.T
        dc_next = dc * f
    flat = dz_all.reshape(steps * batch, -1)
    return x.reshape(steps * batch, dim).T @ flat, du, flat.sum(axis=0)


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(steps, batch, DIM) and the mask (steps, batch)."""
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), DIM), dtype=np.float32)
    mask = np.zeros((steps, len(pages)), dtype=np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
        mask[: len(p), k] = 1
    return x, mask


def turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's own steps in reverse, the padding left at the end."""
    steps = x.shape[0]
    t = np.arange(steps)[:, None]
    src = np.where(t < lengths[None, :], lengths[None, :] - 1 - t, t)
    return x[src, np.arange(x.shape[1])[None, :]]


@dataclass
class Labeller:
    weights: list[np.ndarray]

    @classmethod
    def fresh(cls, seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        out = []
        for _ in range(2):
            b = np.zeros(4 * HIDDEN, dtype=np.float32)
            b[HIDDEN : 2 * HIDDEN] = 1
            out += [rng.normal(0, 0.12, (DIM, 4 * HIDDEN)).astype(np.float32), rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32), b]
        return cls([*out, rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), np.zeros(1, dtype=np.float32)])

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page the chance of each block to be main text."""
        if not pages:
            return []
        x, mask = padded(pages)
        n = mask.sum(axis=0).astype(np.int64)
        w = self.weights
        h1 = _run(*w[0:3], x)
        h2 = turned(_run(*w[3:6], turned(x, n)), n)
        p = _sigmoid(h1 @ w[6][:HIDDEN] + h2 @ w[6][HIDDEN:] + w[7])
        return [p[: n[k], k] for k in range(len(pages))]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        n = mask.sum(axis=0).astype(np.int64)
        w = self.weights
        back = turned(x, n)
        h1, tape1 = _run(*w[0:3], x, keep=True)
        h2r, tape2 = _run(*w[3:6], back, keep=True)
        h2 = turned(h2r, n)
        p = _sigmoid(h1 @ w[6][:HIDDEN] + h2 @ w[6][HIDDEN:] + w[7])
        total = mask.sum()
        loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total)
        d = (p - y) * mask / total
        g1 = _back(w[1], x, tape1, d[..., None] * w[6][:HIDDEN])
        g2 = _back(w[4], back, tape2, turned(d[..., None] * w[6][HIDDEN:], n))
        top = np.concatenate([(d[..., None] * h1).sum(axis=(0, 1)), (d[..., None] * h2).sum(axis=(0, 1))])
        return loss, [*g1, *g2, top, np.array([d.sum()], dtype=np.float32)]

    @classmethod
    def fit(cls, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 14, batch: int = 24, rate: float = 6e-3, seed: int = 7) -> Labeller:
        model = cls.fresh(seed)
        rng = np.random.default_rng(seed)
        first = [np.zeros_like(w) for w in model.weights]
        second = [np.zeros_like(w) for w in model.weights]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for k in range(0, len(order), batch):
                chosen = order[k : k + batch]
                x, mask = padded([pages[c] for c in chosen])
                y = np.zeros_like(mask)
                for j, c in enumerate(chosen):
                    y[: len(labels[c]), j] = labels[c]
                _, grads = model.gradients(x, mask, y)
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
                for m, v, w, g in zip(first, second, model.weights, grads, strict=True):
                    g = g * min(1.0, 2.0 / (norm + 1e-9))
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return model
