"""A gated recurrent network over word ids in numpy, with a class-factored softmax.

Ids are in order of frequency; class c has the ids from c * width on. A token is
predicted from the state before it: first its class, then the word in the class. Texts
are laid end to end in lanes, which run side by side; the state is carried from window
to window and cleared where a text begins.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

LANES = 256
WINDOW = 32
#: Tokens of a lane that is trained on, at least: few texts make few lanes, and so more updates.
LANE_TOKENS = 2048
RATE = 0.08
CLIP = 5.0
#: Logits are held within this, so their exponentials are finite.
MOST = np.float32(60.0)


@dataclass(frozen=True)
class Shape:
    hidden: int
    classes: int
    width: int

    @property
    def vocabulary(self) -> int:
        return self.classes * self.width

    def sizes(self) -> dict[str, tuple[int, ...]]:
        v, h = self.vocabulary, self.hidden
        return {"x": (v, 3 * h), "u": (h, 3 * h), "c": (h, self.classes), "cb": (self.classes,), "w": (self.classes, h, self.width), "wb": (self.classes, self.width)}


def unpack(flat: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, size in shape.sizes().items():
        n = int(np.prod(size))
        out[name] = flat[at : at + n].reshape(size)
        at += n
    return out


def initial(shape: Shape, counts: np.ndarray, seed: int = 7) -> np.ndarray:
    """Small random weights; output biases give the words' shares of all tokens."""
    rng = np.random.default_rng(seed)
    flat = np.concatenate([rng.normal(0, 0.1, int(np.prod(s))).astype(np.float32) for s in shape.sizes().values()])
    p = unpack(flat, shape)
    share = (counts + 0.5).reshape(shape.classes, shape.width)
    p["cb"][:] = np.log(share.sum(1) / share.sum())
    p["wb"][:] = np.log(share / share.sum(1, keepdims=True))
    return flat


def lanes(texts: list[np.ndarray], n: int = LANES) -> list[list[int]]:
    """Indices of texts by lane, longest texts first to the shortest lane; long lanes come first."""
    heap = [(0, k) for k in range(min(n, max(1, len(texts))))]
    out: list[list[int]] = [[] for _ in heap]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        size, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (size + len(texts[i]), k))
    return sorted((x for x in out if x), key=lambda x: -sum(len(texts[i]) for i in x))


def lay(texts: list[np.ndarray], most: int = LANES) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
    """(ids, begins, lengths of lanes, texts of lanes); ids and begins by time and lane."""
    by = lanes(texts, most)
    sizes = np.array([sum(len(texts[i]) for i in x) for x in by])
    ids = np.zeros((int(sizes[0]), len(by)), dtype=np.int32)
    begins = np.zeros(ids.shape, dtype=bool)
    for k, x in enumerate(by):
        row = np.concatenate([texts[i] for i in x])
        ids[: len(row), k] = row
        begins[np.cumsum([0] + [len(texts[i]) for i in x[:-1]]), k] = True
    return ids, begins, sizes, by


def run_window(p: dict, shape: Shape, ids: np.ndarray, begins: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """States before each token, the last state, and what the way back needs: both gates, the new states, and what the reset gate weighs."""
    n = shape.hidden
    x = p["x"].take(ids, axis=0)
    before, new, weighed = (np.empty((*ids.shape, n), dtype=np.float32) for _ in range(3))
    gates = np.empty((*ids.shape, 2 * n), dtype=np.float32)
    on = (~begins).astype(np.float32)[:, :, None]
    for t in range(len(ids)):
        h = np.multiply(h, on[t], out=before[t])
        a = h @ p["u"]
        rz, g = gates[t], new[t]
        np.add(x[t, :, : 2 * n], a[:, : 2 * n], out=rz)
        np.negative(rz, out=rz)
        np.exp(rz, out=rz)
        rz += 1.0
        np.reciprocal(rz, out=rz)
        weighed[t] = a[:, 2 * n :]
        np.multiply(rz[:, :n], weighed[t], out=g)
        g += x[t, :, 2 * n :]
        np.tanh(g, out=g)
        h = h - g
        h *= rz[:, n:]
        h += g
    return before, h, (gates, new, weighed)


def _within(weights: np.ndarray, biases: np.ndarray) -> bool:
    """Whether no logit can be beyond ``MOST``, as no state is beyond 1."""
    return bool(np.abs(weights).sum(-2).max() + np.abs(biases).max() < MOST)


def _chosen(logit: np.ndarray, of: np.ndarray, ones: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """The logits of ``of``, and the sums of the exponentials, which take the logits' place."""
    if not within:
        np.clip(logit, -MOST, MOST, out=logit)
    picked = logit[np.arange(len(of)), of]
    np.exp(logit, out=logit)
    return picked, logit @ ones


def _slopes(e: np.ndarray, total: np.ndarray, of: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The loss's gradients of the logits, in the place of their exponentials."""
    e *= (weight / total)[:, None]
    e[np.arange(len(of)), of] -= weight
    return e


def predict(p: dict, shape: Shape, h: np.ndarray, ids: np.ndarray, grads: dict | None = None, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of each id after state ``h``; with ``grads``, adds the gradients of the mean loss and returns that of ``h``."""
    of = np.arange(shape.vocabulary)
    cls = (of // shape.width).astype(np.int16)[ids]
    logit = h @ p["c"]
    logit += p["cb"]
    picked, total = _chosen(logit, cls, np.ones(shape.classes, dtype=np.float32), _within(p["c"], p["cb"]))
    out = picked - np.log(total)
    dh = None
    if grads is not None:
        d = _slopes(logit, total, cls, weight)
        grads["c"] += h.T @ d
        grads["cb"] += d.sum(0)
        dh = d @ p["c"].T
    # tokens of a class lie side by side, so that a class is a slice
    order = np.argsort(cls, kind="stable")
    ends = np.searchsorted(cls[order], np.arange(shape.classes + 1)).tolist()
    states, words = h[order], (of % shape.width)[ids[order]]
    weights = weight[order] if grads is not None else None
    picks, totals, back = np.empty(len(ids), np.float32), np.empty(len(ids), np.float32), np.empty_like(states)
    ones, within = np.ones(shape.width, dtype=np.float32), _within(p["w"], p["wb"])
    for c, (a, b) in enumerate(zip(ends, ends[1:])):
        if a == b:
            continue
        logit = states[a:b] @ p["w"][c]
        logit += p["wb"][c]
        picks[a:b], totals[a:b] = _chosen(logit, words[a:b], ones, within)
        if grads is not None:
            d = _slopes(logit, totals[a:b], words[a:b], weights[a:b])
            grads["w"][c] += states[a:b].T @ d
            grads["wb"][c] += d.sum(0)
            np.matmul(d, p["w"][c].T, out=back[a:b])
    out[order] += picks - np.log(totals)
    if grads is not None:
        dh[order] += back
    return out, dh


def score(flat: np.ndarray, shape: Shape, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each whole text (not empty: each has its end token)."""
    p = unpack(flat, shape)
    ids, begins, sizes, by = lay(texts)
    logs = np.zeros(ids.shape, dtype=np.float32)
    h = np.zeros((ids.shape[1], shape.hidden), dtype=np.float32)
    for t in range(0, len(ids), WINDOW):
        n = int((sizes > t).sum())
        part = ids[t : t + WINDOW, :n]
        before, h, _ = run_window(p, shape, part, begins[t : t + WINDOW, :n], h[:n])
        logs[t : t + WINDOW, :n] = predict(p, shape, before.reshape(-1, shape.hidden), part.reshape(-1))[0].reshape(part.shape)
    out = np.zeros(len(texts))
    for k, x in enumerate(by):
        sums = np.add.reduceat(logs[: sizes[k], k].astype(np.float64), np.cumsum([0] + [len(texts[i]) for i in x[:-1]]))
        out[x] = sums
    return out


def train(flat: np.ndarray, squares: np.ndarray, shape: Shape, texts: list[np.ndarray], rate: float = RATE) -> None:
    """One pass over the texts, window by window, changing ``flat`` (and Adagrad's ``squares``) in place."""
    p, grad = unpack(flat, shape), np.zeros_like(flat)
    g = unpack(grad, shape)
    # a window has few of the words, and the others' rows don't change
    n_x = p["x"].size
    squares_x, grad, rest, squares_rest = squares[:n_x].reshape(p["x"].shape), grad[n_x:], flat[n_x:], squares[n_x:]
    ids, begins, sizes, _ = lay(texts, min(LANES, max(1, sum(map(len, texts)) // LANE_TOKENS)))
    n = shape.hidden
    h = np.zeros((ids.shape[1], n), dtype=np.float32)
    for t in range(0, len(ids), WINDOW):
        live = int((sizes > t).sum())
        part, first = ids[t : t + WINDOW, :live], begins[t : t + WINDOW, :live]
        before, h, (gates, new, weighed) = run_window(p, shape, part, first, h[:live])
        real = (np.arange(t, t + len(part))[:, None] < sizes[:live]).astype(np.float32)
        weight = (real / real.sum()).reshape(-1)
        grad[:] = 0
        _, dout = predict(p, shape, before.reshape(-1, n), part.reshape(-1), g, weight)
        dout = dout.reshape(before.shape)
        r, z = gates[:, :, :n], gates[:, :, n:]
        # the slopes of what a step adds up, as multiples of the gradient that comes back to it
        by_new = (1 - z) * (1 - new * new)
        slopes = np.empty((*part.shape, 3, n), dtype=np.float32)
        np.multiply(by_new, weighed * (r * (1 - r)), out=slopes[:, :, 0])
        np.multiply(before - new, z * (1 - z), out=slopes[:, :, 1])
        np.multiply(by_new, r, out=slopes[:, :, 2])
        backs, on, u_back = np.empty_like(before), (~first).astype(np.float32)[:, :, None], np.ascontiguousarray(p["u"].T)
        back = np.zeros((live, n), dtype=np.float32)
        for k in range(len(part) - 1, -1, -1):
            backs[k] = back
            slopes[k] *= back[:, None, :]
            back = back * z[k]
            back += slopes[k].reshape(live, 3 * n) @ u_back
            back += dout[k]
            back *= on[k]
        g["u"] += before.reshape(-1, n).T @ slopes.reshape(-1, 3 * n)
        np.multiply(backs, by_new, out=slopes[:, :, 2])
        flat_ids = part.reshape(-1).astype(np.int16 if shape.vocabulary < 2**15 else np.int32)  # short integers are sorted by radix
        order = np.argsort(flat_ids, kind="stable")
        found, starts = np.unique(flat_ids[order], return_index=True)
        grad_x = np.add.reduceat(slopes.reshape(-1, 3 * n)[order], starts, axis=0)
        norm = float(np.sqrt(np.vdot(grad_x, grad_x) + np.vdot(grad, grad)))
        if norm > CLIP:
            grad *= CLIP / norm
            grad_x *= CLIP / norm
        sums = squares_x[found] + grad_x * grad_x
        squares_x[found] = sums
        p["x"][found] -= rate * grad_x / (np.sqrt(sums) + 1e-6)
        squares_rest += grad * grad
        rest -= rate * grad / (np.sqrt(squares_rest) + 1e-6)
