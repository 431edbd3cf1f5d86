"""A plain Kneser-Ney model of one language in numpy, beside which the tables of the library are held."""

import numpy as np


class Model:
    """Interpolated Kneser-Ney model of one language; every order is a sorted array of gram codes."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, discount: float):
        order = np.argsort(grams)
        grams, counts = grams[order], counts[order].astype(np.float64)
        types = {4: (grams, counts)}
        for k in range(4 - 1, 0, -1):  # continuation counts: in how many longer grams a gram ends
            longer = types[k + 1][0]
            types[k] = tuple(x.astype(t) for x, t in zip(np.unique(longer & np.uint64((1 << 16 * k) - 1), return_counts=True), (np.uint64, np.float64)))
        self.keys, self.logs, self.contexts, self.back = {}, {}, {}, {}
        symbols = len(types[1][0]) + 1
        self.unseen = -np.log(symbols)
        below = np.full(len(types[1][0]), 1.0 / symbols)
        for k in range(1, 4 + 1):
            keys, n = types[k]
            d = discount if k == 4 else discount_of(n)
            contexts, start, size = np.unique(keys >> np.uint64(16), return_index=True, return_counts=True)
            total = np.add.reduceat(n, start)
            weight = d * size / total
            if k > 1:
                below = np.exp(self._log(keys & np.uint64((1 << 16 * (k - 1)) - 1), k - 1))
            p = np.maximum(n - d, 0) / np.repeat(total, size) + np.repeat(weight, size) * below
            self.keys[k], self.logs[k], self.contexts[k], self.back[k] = keys, np.log(p), contexts, np.log(weight)

    def _log(self, grams: np.ndarray, k: int) -> np.ndarray:
        """Log probability of the last letter of grams of ``k`` letters after the others."""
        out = np.full(len(grams), self.unseen)
        if not k:
            return out
        at, hit = _find(self.keys[k], grams)
        out[hit] = self.logs[k][at[hit]]
        rest = np.flatnonzero(~hit)
        if len(rest):
            at, known = _find(self.contexts[k], grams[rest] >> np.uint64(16))
            out[rest] = self._log(grams[rest] & np.uint64((1 << 16 * (k - 1)) - 1), k - 1) + np.where(known, self.back[k][at], 0.0)
        return out

    def log(self, grams: np.ndarray) -> np.ndarray:
        return self._log(grams, 4)


def _discount(counts: np.ndarray) -> float:
    once, twice = (counts == 1).sum(), (counts == 2).sum()
    return float(once / (once + 2 * twice)) if once and twice else 0.75


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _find(keys, wanted):
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def discount_of(counts):
    once, twice = (counts == 1).sum(), (counts == 2).sum()
    return float(once / (once + 2 * twice)) if once and twice else 0.75
