"""Character tagger in numpy: bidirectional LSTM with CRF transitions.

Every window has the same length; padding is a character of its own whose tag
is O. Tags are O and, per kind, one for the first character and one for the others.
"""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)
LENGTH = 96

# Character classes; 0 pads a window.
_SIGNS = " @.+-_%():,/\n"
CLASSES = len(_SIGNS) + 7
_ASCII = np.full(128, len(_SIGNS) + 1)
for _i, _c in enumerate(_SIGNS):
    _ASCII[ord(_c)] = _i + 1
for _c in range(128):
    if chr(_c).isdigit():
        _ASCII[_c] = len(_SIGNS) + 2
    elif chr(_c).islower():
        _ASCII[_c] = len(_SIGNS) + 3
    elif chr(_c).isupper():
        _ASCII[_c] = len(_SIGNS) + 4


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _ASCII[np.minimum(points, 127)], len(_SIGNS) + 5)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Parameters and passes. Axis 0 of LSTM arrays is the direction."""

    def __init__(self, hidden: int = 16, seed: int = 3):
        r = np.random.default_rng(seed)
        h = hidden
        self.hidden = h
        self.p = {
            "x": r.normal(0, 0.3, (2, CLASSES, 4 * h)),
            "h": r.normal(0, 1 / np.sqrt(h), (2, h, 4 * h)),
            "b": np.zeros((2, 1, 4 * h)),
            "o": r.normal(0, 1 / np.sqrt(2 * h), (2 * h, TAGS)),
            "ob": np.zeros(TAGS),
            "t": np.zeros((TAGS, TAGS)),
        }
        self.p["b"][:, :, h : 2 * h] = 1

    def emissions(self, ids: np.ndarray, trace: list | None = None) -> np.ndarray:
        """Scores (window, place, tag)."""
        p, h = self.p, self.hidden
        n, length = ids.shape
        both = np.stack([ids, ids[:, ::-1]])
        out = np.zeros((2, length, n, h))
        state, cell = np.zeros((2, n, h)), np.zeros((2, n, h))
        side = np.arange(2)[:, None]
        for k in range(length):
            z = p["x"][side, both[:, :, k]] + np.matmul(state, p["h"]) + p["b"]
            gates, new = _sigmoid(z[:, :, : 3 * h]), np.tanh(z[:, :, 3 * h :])
            before = cell
            cell = gates[:, :, h : 2 * h] * cell + gates[:, :, :h] * new
            bent = np.tanh(cell)
            if trace is not None:
                trace.append((both[:, :, k], state, before, gates, new, bent))
            state = gates[:, :, 2 * h :] * bent
            out[:, k] = state
        joined = np.concatenate([out[0], out[1, ::-1]], axis=2)
        if trace is not None:
            trace.append(joined)
        return (joined @ p["o"] + p["ob"]).transpose(1, 0, 2)

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log sum, tag probabilities, summed probabilities of neighbours)."""
        t = self.p["t"]
        n, length, _ = e.shape
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for k in range(1, length):
            a[:, k] = _logsum(a[:, k - 1, :, None] + t, 1) + e[:, k]
        for k in range(length - 2, -1, -1):
            b[:, k] = _logsum(t + (e[:, k + 1] + b[:, k + 1])[:, None, :], 2)
        z = _logsum(a[:, -1], 1)
        pairs = np.exp(a[:, :-1, :, None] + t + (e + b)[:, 1:, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
        return z, np.exp(a + b - z[:, None, None]), pairs

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Best tags of every window."""
        t = self.p["t"]
        n, length, _ = e.shape
        best, back = e[:, 0], np.zeros((n, length, TAGS), np.int64)
        for k in range(1, length):
            s = best[:, :, None] + t
            back[:, k] = s.argmax(axis=1)
            best = s.max(axis=1) + e[:, k]
        tags = np.zeros((n, length), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        for k in range(length - 1, 0, -1):
            tags[:, k - 1] = back[np.arange(n), k, tags[:, k]]
        return tags

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of ``tags``, and its gradients."""
        p, h = self.p, self.hidden
        n, length = ids.shape
        trace: list = []
        e = self.emissions(ids, trace)
        z, probability, pairs = self.marginals(e)
        rows, places = np.arange(n)[:, None], np.arange(length)[None, :]
        score = e[rows, places, tags].sum(axis=1) + p["t"][tags[:, :-1], tags[:, 1:]].sum(axis=1)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        de = probability
        de[rows, places, tags] -= 1
        np.add.at(pairs, (tags[:, :-1], tags[:, 1:]), -1)
        g["t"] = pairs / n
        de = de.transpose(1, 0, 2) / n
        joined = trace.pop()
        g["o"] = np.tensordot(joined, de, ((0, 1), (0, 1)))
        g["ob"] = de.sum(axis=(0, 1))
        dj = de @ p["o"].T
        douts = np.stack([dj[:, :, :h], dj[::-1, :, h:]])
        dstate, dcell = np.zeros((2, n, h)), np.zeros((2, n, h))
        for k in range(length - 1, -1, -1):
            own, state, before, gates, new, bent = trace[k]
            i, f, o = gates[:, :, :h], gates[:, :, h : 2 * h], gates[:, :, 2 * h :]
            dstate = dstate + douts[:, k]
            dcell = dcell + dstate * o * (1 - bent * bent)
            dz = np.concatenate(
                [dcell * new * i * (1 - i), dcell * before * f * (1 - f), dstate * bent * o * (1 - o), dcell * i * (1 - new * new)], axis=2
            )
            for d in (0, 1):
                np.add.at(g["x"][d], own[d], dz[d])
            g["h"] += np.matmul(state.transpose(0, 2, 1), dz)
            g["b"] += dz.sum(axis=1, keepdims=True)
            dstate = np.matmul(dz, p["h"].transpose(0, 2, 1))
            dcell = dcell * f
        return float((z - score).mean()), g

    def fit(self, ids: np.ndarray, tags: np.ndarray, passes: int, rate: float = 0.02, batch: int = 32, seed: int = 5) -> list[float]:
        """Adam; the losses of the passes."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, losses = 0, []
        for each in range(passes):
            total = 0.0
            order = r.permutation(len(ids))
            for at in range(0, len(ids), batch):
                own = order[at : at + batch]
                loss, g = self.gradients(ids[own], tags[own])
                total += loss * len(own)
                norm = np.sqrt(sum((x * x).sum() for x in g.values()))
                step += 1
                now = rate * (1 - each / passes)
                for k in self.p:
                    x = g[k] * min(1.0, 5 / norm)
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v2[k] = 0.999 * v2[k] + 0.001 * x * x
                    self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
            losses.append(total / len(ids))
        return losses
