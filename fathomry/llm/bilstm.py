"""A bidirectional LSTM in numpy: training by back-propagation through time, and batched inference."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _reversed(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each sequence back to front within its own length; padding stays at the end."""
    t = np.arange(x.shape[1])[None, :]
    at = np.where(t < lengths[:, None], lengths[:, None] - 1 - t, t)
    return np.take_along_axis(x, at[:, :, None], axis=1)


def _run(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    n, steps, _ = x.shape
    size = u.shape[0]
    projected = x @ w + b
    h, c = np.zeros((n, size), x.dtype), np.zeros((n, size), x.dtype)
    out, cache = np.empty((n, steps, size), x.dtype), []
    for t in range(steps):
        a = projected[:, t] + h @ u
        gates, g = _sigmoid(a[:, : 3 * size]), np.tanh(a[:, 3 * size :])
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        before_h, before_c = h, c
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[:, t] = h
        if keep:
            cache.append((i, f, o, g, before_c, tc, before_h))
    return out, cache


def _back(x: np.ndarray, u: np.ndarray, cache: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, steps, size = dout.shape
    dh, dc = np.zeros((n, size), x.dtype), np.zeros((n, size), x.dtype)
    da_all, du = np.empty((n, steps, 4 * size), x.dtype), np.zeros_like(u)
    for t in reversed(range(steps)):
        i, f, o, g, before_c, tc, before_h = cache[t]
        dh = dh + dout[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        da = np.concatenate([dc * g * i * (1 - i), dc * before_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        du += before_h.T @ da
        da_all[:, t] = da
        dh, dc = da @ u.T, dc * f
    flat = da_all.reshape(-1, 4 * size)
    return x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0)


@dataclass
class Labeller:
    """Per step: ``flags`` independent yes/no outputs, then one of several classes."""

    weights: dict[str, np.ndarray]
    flags: int

    @classmethod
    def new(cls, inputs: int, size: int, flags: int, classes: int, seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        weights = {}
        for side in ("fore", "back"):
            bias = np.zeros(4 * size, np.float32)
            bias[size : 2 * size] = 1.0
            weights |= {f"{side}_w": draw(inputs, 4 * size), f"{side}_u": draw(size, 4 * size), f"{side}_b": bias}
        weights |= {"out_w": draw(2 * size + inputs, flags + classes), "out_b": np.zeros(flags + classes, np.float32)}
        return cls(weights, flags)

    def _states(self, x: np.ndarray, lengths: np.ndarray, keep: bool):
        w = self.weights
        fore, fore_cache = _run(x, w["fore_w"], w["fore_u"], w["fore_b"], keep)
        turned = _reversed(x, lengths)
        back, back_cache = _run(turned, w["back_w"], w["back_u"], w["back_b"], keep)
        # The leaf's own vector reaches the output too; the recurrent part adds its context.
        return np.concatenate([fore, _reversed(back, lengths), x], axis=2), turned, fore_cache, back_cache

    def scores(self, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the flags and of the classes, per step."""
        states = self._states(x, lengths, False)[0]
        z = states @ self.weights["out_w"] + self.weights["out_b"]
        e = np.exp(z[:, :, self.flags :] - z[:, :, self.flags :].max(axis=2, keepdims=True))
        return _sigmoid(z[:, :, : self.flags]), e / e.sum(axis=2, keepdims=True)

    def gradients(self, x: np.ndarray, lengths: np.ndarray, flags: np.ndarray, classes: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss per step and its gradients."""
        w, size = self.weights, self.weights["fore_u"].shape[0]
        states, turned, fore_cache, back_cache = self._states(x, lengths, True)
        z = states @ w["out_w"] + w["out_b"]
        live = (np.arange(x.shape[1])[None, :] < lengths[:, None]).astype(x.dtype)
        total = live.sum()
        p = _sigmoid(z[:, :, : self.flags])
        e = np.exp(z[:, :, self.flags :] - z[:, :, self.flags :].max(axis=2, keepdims=True))
        q = e / e.sum(axis=2, keepdims=True)
        picked = np.take_along_axis(q, classes[:, :, None], axis=2)[:, :, 0]
        tiny = 1e-7
        loss = -(live * (np.log(picked + tiny) + (flags * np.log(p + tiny) + (1 - flags) * np.log(1 - p + tiny)).sum(axis=2))).sum() / total
        hot = np.zeros_like(q)
        np.put_along_axis(hot, classes[:, :, None], 1.0, axis=2)
        dz = np.concatenate([p - flags, q - hot], axis=2) * (live / total)[:, :, None]
        dstates = dz @ w["out_w"].T
        grads = {"out_w": states.reshape(-1, states.shape[2]).T @ dz.reshape(-1, dz.shape[2]), "out_b": dz.sum(axis=(0, 1))}
        sides = (("fore", x, fore_cache, dstates[:, :, :size]), ("back", turned, back_cache, _reversed(dstates[:, :, size : 2 * size], lengths)))
        for side, seen, cache, dout in sides:
            grads[f"{side}_w"], grads[f"{side}_u"], grads[f"{side}_b"] = _back(seen, w[f"{side}_u"], cache, dout)
        return float(loss), grads

    def train(self, sequences: list[np.ndarray], flags: list[np.ndarray], classes: list[np.ndarray], epochs: int, batch: int, rate: float, seed: int) -> list[float]:
        """Adam with gradient clipping; sequences of like length share a batch. Returns the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, losses = 0, []
        by_length = np.argsort([len(s) for s in sequences], kind="stable")
        batches = [by_length[i : i + batch] for i in range(0, len(by_length), batch)]
        for epoch in range(epochs):
            total = 0.0
            for k in rng.permutation(len(batches)):
                x, lengths = pad([sequences[i] for i in batches[k]])
                y = pad([flags[i] for i in batches[k]])[0]
                c = pad([classes[i][:, None] for i in batches[k]])[0][:, :, 0].astype(np.int64)
                loss, grads = self.gradients(x, lengths, y, c)
                total += loss
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                scale = min(1.0, 5.0 / (norm + 1e-9))
                now = rate * (0.3 if epoch >= 2 * epochs // 3 else 1.0)
                for name, g in grads.items():
                    g = (g * scale).astype(np.float32)
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.001 * (g * g - second[name])
                    self.weights[name] -= now * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
            losses.append(total / len(batches))
        return losses


def pad(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in sequences])
    out = np.zeros((len(sequences), int(lengths.max()), sequences[0].shape[1]), np.float32)
    for i, s in enumerate(sequences):
        out[i, : len(s)] = s
    return out, lengths
