"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, and Viterbi decoding of batches of windows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW = 96
EMBED, HIDDEN = 12, 20


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """x: steps x batch x in -> steps x batch x hidden. keep: gets what the backward pass needs."""
    steps, batch, _ = x.shape
    n = u.shape[0]
    h, c = np.zeros((batch, n), x.dtype), np.zeros((batch, n), x.dtype)
    out = np.empty((steps, batch, n), x.dtype)
    xw = x @ w + b
    for t in range(steps):
        g = xw[t] + h @ u
        s = _sigmoid(g[:, : 3 * n])
        i, f, o, z = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(g[:, 3 * n :])
        before = c
        c = f * c + i * z
        tc = np.tanh(c)
        if keep is not None:
            keep.append((i, f, o, z, before, tc, h))
        h = o * tc
        out[t] = h
    return out


def _lstm_back(x: np.ndarray, w: np.ndarray, u: np.ndarray, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = u.shape[0]
    d_g = np.empty((*x.shape[:2], 4 * n), x.dtype)
    d_h, d_c, d_u = np.zeros_like(d_out[0]), np.zeros_like(d_out[0]), np.zeros_like(u)
    for t in range(len(kept) - 1, -1, -1):
        i, f, o, z, before, tc, h = kept[t]
        dh = d_out[t] + d_h
        dc = d_c + dh * o * (1 - tc * tc)
        g = d_g[t]
        g[:, :n] = dc * z * i * (1 - i)
        g[:, n : 2 * n] = dc * before * f * (1 - f)
        g[:, 2 * n : 3 * n] = dh * tc * o * (1 - o)
        g[:, 3 * n :] = dc * i * (1 - z * z)
        d_u += h.T @ g
        d_h = g @ u.T
        d_c = dc * f
    flat = d_g.reshape(-1, 4 * n)
    return d_g @ w.T, x.reshape(-1, x.shape[2]).T @ flat, d_u, flat.sum(0)


@dataclass
class Tagger:
    p: dict[str, np.ndarray]
    tags: int

    @staticmethod
    def new(symbols: int, tags: int, seed: int = 5) -> Tagger:
        rng = np.random.default_rng(seed)
        p: dict[str, np.ndarray] = {"e": rng.standard_normal((symbols, EMBED)) * 0.3}
        for d in "fb":
            p[f"w{d}"] = rng.standard_normal((EMBED, 4 * HIDDEN)) / np.sqrt(EMBED)
            p[f"u{d}"] = rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)
            p[f"b{d}"] = np.zeros(4 * HIDDEN)
            p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1
        p |= {"o": rng.standard_normal((2 * HIDDEN, tags)) * 0.2, "ob": np.zeros(tags), "tr": np.zeros((tags, tags)), "st": np.zeros(tags)}
        return Tagger({k: v.astype(np.float32) for k, v in p.items()}, tags)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """x: windows x steps of symbols -> steps x windows x tags."""
        p, e = self.p, self.p["e"][x.T]
        h = np.concatenate([_lstm(e, p["wf"], p["uf"], p["bf"]), _lstm(e[::-1], p["wb"], p["ub"], p["bb"])[::-1]], 2)
        return h @ p["o"] + p["ob"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tag sequence of each window (Viterbi), windows x steps."""
        em, tr = self.emissions(x), self.p["tr"]
        steps, batch, _ = em.shape
        score, back = em[0] + self.p["st"], np.empty((steps, batch, self.tags), np.int8)
        for t in range(1, steps):
            each = score[:, :, None] + tr
            back[t] = each.argmax(1)
            score = each.max(1) + em[t]
        out = np.empty((steps, batch), np.int8)
        out[-1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            out[t - 1] = back[t, np.arange(batch), out[t]]
        return out.T

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag sequences y, and its gradients."""
        p, (batch, steps) = self.p, x.shape
        e = p["e"][x.T]
        kf: list = []
        kb: list = []
        hf, hb = _lstm(e, p["wf"], p["uf"], p["bf"], kf), _lstm(e[::-1], p["wb"], p["ub"], p["bb"], kb)[::-1]
        h = np.concatenate([hf, hb], 2)
        em, tr, yt, at = h @ p["o"] + p["ob"], p["tr"], y.T, np.arange(batch)
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[0] = em[0] + p["st"]
        for t in range(1, steps):
            alpha[t] = logsumexp(alpha[t - 1][:, :, None] + tr, 1) + em[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = logsumexp(tr + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        z = logsumexp(alpha[-1], 1)
        path = em[np.arange(steps)[:, None], at, yt].sum(0) + tr[yt[:-1], yt[1:]].sum(0) + p["st"][yt[0]]
        d_em = np.exp(alpha + beta - z[:, None])
        g = {"st": d_em[0].sum(0) - np.bincount(yt[0], minlength=self.tags)}
        pair = np.exp(alpha[:-1, :, :, None] + tr + (em[1:] + beta[1:])[:, :, None, :] - z[:, None, None]).sum((0, 1))
        np.subtract.at(pair, (yt[:-1].ravel(), yt[1:].ravel()), 1)
        g["tr"] = pair
        d_em[np.arange(steps)[:, None], at, yt] -= 1
        flat = d_em.reshape(-1, self.tags)
        g["o"], g["ob"] = h.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(0)
        d_h = d_em @ p["o"].T
        d_e, g["wf"], g["uf"], g["bf"] = _lstm_back(e, p["wf"], p["uf"], kf, d_h[:, :, :HIDDEN])
        d_b, g["wb"], g["ub"], g["bb"] = _lstm_back(np.ascontiguousarray(e[::-1]), p["wb"], p["ub"], kb, d_h[::-1, :, HIDDEN:])
        each, flat_x = (d_e + d_b[::-1]).reshape(-1, EMBED), x.T.ravel()
        g["e"] = np.stack([np.bincount(flat_x, each[:, k], len(p["e"])) for k in range(EMBED)], 1).astype(np.float32)
        return float((z - path).mean()), {k: v / batch for k, v in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 48, rate: float = 0.01, seed: int = 5) -> list[float]:
        """Adam with clipped gradients. Returns the mean loss of each epoch."""
        rng, n, losses = np.random.default_rng(seed), 0, []
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order, total = rng.permutation(len(x)), []
            for at in range(0, len(order), batch):
                loss, g = self.gradients(x[order[at : at + batch]], y[order[at : at + batch]])
                norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                n += 1
                step = rate * (0.5 if epoch >= epochs * 0.6 else 1)
                for k, a in g.items():
                    a = a * min(1.0, 5 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.999 * v[k] + 0.001 * a * a
                    self.p[k] = (self.p[k] - step * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
                total.append(loss)
            losses.append(float(np.mean(total)))
        return losses
