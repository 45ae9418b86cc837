"""A bidirectional LSTM over symbols with a linear-chain CRF on top, in numpy: training, scores and decoding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Score of a step that the tags do not allow.
NEVER = -1e4


@dataclass
class Tagger:
    """Parameters by name: ``w`` (2, symbols, 4h) and ``u`` (2, h, 4h) of the two directions, gates in the order input,
    forget, output, candidate; ``v`` (2h, tags) and ``b`` (tags) of the emissions; ``a`` (tags, tags) and ``s`` (tags) of the
    CRF's steps and starts. ``allowed`` (tags + 1, tags): steps that may be, the last row for starts."""

    p: dict[str, np.ndarray]
    allowed: np.ndarray

    @property
    def steps(self) -> np.ndarray:
        return np.where(self.allowed[:-1], self.p["a"], NEVER)

    @property
    def starts(self) -> np.ndarray:
        return np.where(self.allowed[-1], self.p["s"], NEVER)

    def hidden(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (windows, length, 2h) of windows of symbols; with ``keep``, what ``gradients`` needs of each step."""
        w, u = self.p["w"], self.p["u"]
        h4 = u.shape[2]
        n, h = h4 // 4, np.zeros((2, len(x), h4 // 4), dtype=u.dtype)
        c = np.zeros_like(h)
        both = np.stack([x, x[:, ::-1]])
        # tanh of half the value gives the three sigmoid gates.
        half = np.full(h4, 0.5, dtype=u.dtype)
        half[3 * n :] = 1
        out = np.empty((2, x.shape[1], len(x), n), dtype=u.dtype)
        saved = []
        for t in range(x.shape[1]):
            z = np.matmul(h, u)
            z[0] += w[0][both[0, :, t]]
            z[1] += w[1][both[1, :, t]]
            z *= half
            np.tanh(z, out=z)
            gate = z[:, :, : 3 * n] * u.dtype.type(0.5)
            gate += u.dtype.type(0.5)
            before = (h, c)
            c = gate[:, :, n : 2 * n] * c + gate[:, :, :n] * z[:, :, 3 * n :]
            tc = np.tanh(c)
            h = gate[:, :, 2 * n :] * tc
            out[:, t] = h
            if keep:
                saved.append((*before, gate, z[:, :, 3 * n :], tc))
        return np.concatenate([out[0], out[1, ::-1]], axis=2).transpose(1, 0, 2), saved

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x)[0] @ self.p["v"] + self.p["b"]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags (windows, length), and the emissions."""
        em = self.emissions(x)
        steps, n = self.steps.astype(em.dtype), em.shape[1]
        score = em[:, 0] + self.starts.astype(em.dtype)
        back = np.empty(em.shape, dtype=np.int8)
        for t in range(1, n):
            by = score[:, None, :] + steps.T[None]
            back[:, t] = by.argmax(axis=2)
            score = by.max(axis=2) + em[:, t]
        tags = np.empty(em.shape[:2], dtype=np.int8)
        tags[:, -1] = score.argmax(axis=1)
        rows = np.arange(len(x))
        for t in range(n - 1, 0, -1):
            tags[:, t - 1] = back[rows, t, tags[:, t]]
        return tags, em

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags ``y`` a window, and its gradient by each parameter."""
        states, saved = self.hidden(x, keep=True)
        em = (states @ self.p["v"] + self.p["b"]).astype(np.float64)
        size, length, kinds = em.shape
        steps, starts = self.steps.astype(np.float64), self.starts.astype(np.float64)
        tiny, weight = 1e-300, np.exp(steps)
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[:, 0] = em[:, 0] + starts
        for t in range(1, length):
            top = alpha[:, t - 1].max(axis=1, keepdims=True)
            alpha[:, t] = em[:, t] + top + np.log(np.exp(alpha[:, t - 1] - top) @ weight + tiny)
        for t in range(length - 2, -1, -1):
            on = em[:, t + 1] + beta[:, t + 1]
            top = on.max(axis=1, keepdims=True)
            beta[:, t] = top + np.log(np.exp(on - top) @ weight.T + tiny)
        top = alpha[:, -1].max(axis=1, keepdims=True)
        total = top + np.log(np.exp(alpha[:, -1] - top).sum(axis=1, keepdims=True))
        rows = np.arange(size)[:, None]
        gold = em[rows, np.arange(length), y].sum() + starts[y[:, 0]].sum() + steps[y[:, :-1], y[:, 1:]].sum()
        d_em = np.exp(alpha + beta - total[:, :, None])
        pair = np.zeros_like(weight)
        for t in range(1, length):
            top = alpha[:, t - 1].max(axis=1, keepdims=True)
            pair += np.exp(alpha[:, t - 1] - top).T @ np.exp(np.minimum(em[:, t] + beta[:, t] + top - total, 600))
        pair *= weight
        np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        first = d_em[:, 0].sum(axis=0)
        np.subtract.at(first, y[:, 0], 1)
        d_em[rows, np.arange(length), y] -= 1
        kind = self.p["u"].dtype
        grad = {"a": np.where(self.allowed[:-1], pair, 0) / size, "s": np.where(self.allowed[-1], first, 0) / size}
        d_em = (d_em / size).astype(kind)
        grad["b"] = d_em.sum(axis=(0, 1))
        grad["v"] = states.reshape(-1, states.shape[2]).T @ d_em.reshape(-1, kinds)
        grad |= self._through_time(x, d_em @ self.p["v"].T, saved)
        return float((total.sum() - gold) / size), grad

    def _through_time(self, x: np.ndarray, d_states: np.ndarray, saved: list) -> dict[str, np.ndarray]:
        u = self.p["u"]
        n = u.shape[1]
        both = np.stack([x, x[:, ::-1]])
        down = np.stack([d_states[:, :, :n], d_states[:, ::-1, n:]])
        d_w, d_u = np.zeros_like(self.p["w"]), np.zeros_like(u)
        d_h, d_c = np.zeros((2, len(x), n), dtype=u.dtype), np.zeros((2, len(x), n), dtype=u.dtype)
        turned = u.transpose(0, 2, 1)
        for t in range(x.shape[1] - 1, -1, -1):
            h, c, gate, new, tc = saved[t]
            i, f, o = gate[:, :, :n], gate[:, :, n : 2 * n], gate[:, :, 2 * n :]
            d_h = d_h + down[:, :, t]
            d_c = d_c + d_h * o * (1 - tc * tc)
            d_z = np.concatenate([d_c * new * i * (1 - i), d_c * c * f * (1 - f), d_h * tc * o * (1 - o), d_c * i * (1 - new * new)], axis=2)
            for k in range(2):
                np.add.at(d_w[k], both[k, :, t], d_z[k])
            d_u += np.matmul(h.transpose(0, 2, 1), d_z)
            d_h = np.matmul(d_z, turned)
            d_c = d_c * f
        return {"w": d_w, "u": d_u}


def new_tagger(symbols: int, allowed: np.ndarray, size: int, seed: int = 0, kind: type = np.float32) -> Tagger:
    rng, tags = np.random.default_rng(seed), allowed.shape[1]
    draw = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(kind)
    p = {"w": draw(2, symbols, 4 * size), "u": draw(2, size, 4 * size), "v": draw(2 * size, tags), "b": np.zeros(tags, kind), "a": np.zeros((tags, tags), kind), "s": np.zeros(tags, kind)}
    p["w"][:, :, size : 2 * size] += 1  # forget little at first
    return Tagger(p, allowed)


def train(model: Tagger, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 128, rate: float = 0.02, seed: int = 0) -> list[float]:
    """Adam with a falling rate and clipped gradients, over shuffled batches; gives each epoch's mean loss. Reruns agree."""
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    losses, step, every = [], 0, -(-len(x) // batch)
    for _ in range(epochs):
        order, loss = rng.permutation(len(x)), 0.0
        for lo in range(0, len(x), batch):
            own = order[lo : lo + batch]
            value, grad = model.gradients(x[own], y[own])
            loss += value * len(own)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step += 1
            now = rate * (1 - 0.95 * step / (epochs * every))
            for k, g in grad.items():
                g = (g * min(1.0, 5 / (norm + 1e-12))).astype(model.p[k].dtype)
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.001 * (g * g - s[k])
                model.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(model.p[k].dtype)
        losses.append(loss / len(x))
    return losses
