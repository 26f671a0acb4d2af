"""Prediction by partial matching over bytes: n-grams of texts, and a small corpus's predictions as one dense table."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of the dense table's longest context. 0xFF, which UTF-8 never holds, stands before a text and ends it.
ORDER, EDGE = 3, 0xFF


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Of every byte and end of the texts: it and the order bytes before it as one number; where each text's start."""
    line = np.frombuffer(b"".join(b"\xff" * order + t + b"\xff" for t in texts), np.uint8)
    out = np.zeros(max(0, len(line) - order), np.int64)
    for k in range(order + 1):
        out = (out << 8) | line[k : len(line) - order + k]
    sizes = np.fromiter((len(t) + order + 1 for t in texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    keep = np.ones(len(line), bool)
    for k in range(order):  # no prediction of what stands before a text
        keep[begins + k] = False
    counts = sizes - order
    return out[keep[order:]], np.cumsum(counts) - counts


@dataclass
class Model:
    """Contexts of one, two and three bytes that were kept, and log10 of every byte's probability after each."""

    name: str
    contexts: list[np.ndarray]
    rows: np.ndarray

    def index(self) -> np.ndarray:
        """Row of the longest kept context for each three bytes."""
        at = np.zeros(1 << 24, np.uint16 if len(self.rows) < 1 << 16 else np.int32)
        row = 1
        for n, c in enumerate(self.contexts, 1):
            at.reshape(-1, 1 << 8 * n)[:, c] = np.arange(row, row + len(c))
            row += len(c)
        return at


def _rows(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Probabilities after each context: escape by method C, the escaped mass over bytes the context hasn't shown.

    The shorter context's probabilities are renormalised over those bytes only: what the longer one has shown is
    excluded there.
    """
    total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    rest = np.where(counts > 0, 0, below)
    mass = rest.sum(1, keepdims=True)
    escape = np.where(mass > 0, kinds / np.maximum(total + kinds, 1), 0)
    seen = np.where(total > 0, counts / np.maximum(total, 1), 0) * (1 - escape)
    return np.where(total > 0, seen + escape * rest / np.maximum(mass, 1e-300), below)


def build(name: str, tables: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """tables: for contexts of 0, 1, 2 and 3 bytes the grams (context and byte as one number) and their counts."""
    before, known = np.full((1, 256), 1 / 256), np.zeros(1, np.int64)
    contexts, out = [], []
    for n, (g, k) in enumerate(tables):
        c = np.unique(g >> 8) if n else np.zeros(1, np.int64)
        counts = np.zeros((len(c), 256))
        if len(g):
            counts[np.searchsorted(c, g >> 8), g & 255] = k
        # the row of the longest shorter context that was kept; a longer one's suffix is at least as frequent
        short = c & ((1 << 8 * max(0, n - 1)) - 1)
        at = np.minimum(np.searchsorted(known, short), len(known) - 1)
        rows = _rows(counts, before[at] if n else np.repeat(before, len(c), 0))
        if n:
            contexts.append(c)
        out.append(rows)
        before, known = rows, c
    return Model(name, contexts, np.log10(np.concatenate(out)).astype(np.float32))


def score(rows: np.ndarray, index: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """log10 probability of each text with its end."""
    g, begins = grams(texts)
    cost = rows.reshape(-1)[index[g >> 8].astype(np.int64) * 256 + (g & 255)]
    return np.add.reduceat(cost, begins, dtype=np.float64)
