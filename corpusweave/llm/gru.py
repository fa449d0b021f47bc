"""A small gated recurrent language model in numpy: truncated backpropagation, class-factored softmax.

Tokens are numbered by falling frequency. The first ``k`` are words of the
model, in classes of ``WIDTH`` neighbours; all others are the tail, a class of
its own. P(word | before) = P(class | state) * P(word | class, state); the tail
has P(tail | state), and its words share it by their corpus counts (not here).
"""

from __future__ import annotations

import numpy as np

HIDDEN, WIDTH = 16, 32
WINDOW = 32
SEGMENT = 512
RATE = 0.15
F32 = np.float32


def start(k: int, seed: int = 3) -> dict:
    """Small random weights for ``k`` words (a multiple of WIDTH): inputs are k words, the tail (k) and the start of a text (k + 1)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    small = lambda *shape: (0.1 * rng.standard_normal(shape)).astype(F32)
    c = k // WIDTH + 1
    return {"x": small(k + 2, 3 * HIDDEN), "u": small(HIDDEN, 3 * HIDDEN), "n": np.zeros(HIDDEN, F32),
            "c": small(HIDDEN, c), "cb": np.zeros(c, F32), "w": small(k, HIDDEN), "wb": np.zeros(k, F32)}


def pack(p: dict) -> np.ndarray:
    return np.concatenate([p[name].ravel() for name in sorted(p)])


def unpack(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for name in sorted(like):
        n = like[name].size
        out[name] = flat[at:at + n].reshape(like[name].shape).astype(F32)
        at += n
    return out


def _sigmoid(x):
    e = np.exp(-x)
    e += 1
    return np.reciprocal(e, out=e)


def _step(p, g, h):
    """One step for a batch, a column each (numpy's inner loops then run over the batch): from the inputs' gate parts and the
    states to the next states, and what the backward step needs."""
    a = p["u"].T @ h
    zr = _sigmoid(g[:2 * HIDDEN] + a[:2 * HIDDEN])
    z, r = zr[:HIDDEN], zr[HIDDEN:]
    an = a[2 * HIDDEN:] + p["n"][:, None]
    n = np.tanh(g[2 * HIDDEN:] + r * an)
    return n + z * (h - n), (z, r, an, n)


def _log_share(x, at):
    """Log of the softmax of each column at the place ``at``; overwrites ``x``."""
    x -= x.max(axis=0)
    own = x[at, np.arange(x.shape[1])]
    return own - np.log(np.exp(x, out=x).sum(axis=0))


def _softmax_gradient(x, at, m):
    """Softmax of each column less one at the place ``at``, times ``m``; overwrites ``x``."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x *= m / x.sum(axis=0)
    x[at, np.arange(x.shape[1])] -= m
    return x


def _by_class(y):
    """Order of the targets by class, and (class, begin, end) in that order, for words of the model."""
    order = np.argsort(y, kind="stable")
    cls = y[order] // WIDTH
    cut = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]])) if len(cls) else []
    return order, [(int(cls[a]), a, b) for a, b in zip(cut, [*cut[1:], len(cls)])]


def log_probs(p: dict, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probability of each target (the tail: of its class) after each state (a row each)."""
    k, h = len(p["w"]), h.T
    out = _log_share(p["c"].T @ h + p["cb"][:, None], np.minimum(y, k) // WIDTH).astype(np.float64)
    own = np.flatnonzero(y < k)
    order, classes = _by_class(y[own])
    own = own[order]
    states, places = h.take(own, axis=1), y[own] % WIDTH
    for c, a, b in classes:
        part = slice(c * WIDTH, (c + 1) * WIDTH)
        out[own[a:b]] += _log_share(p["w"][part] @ states[:, a:b] + p["wb"][part][:, None], places[a:b])
    return out


def _output_gradient(p, h, y, grad):
    """Gradient of the mean negative log probability with respect to the states; adds those of the output weights to ``grad``."""
    k, m, h = len(p["w"]), F32(1 / max(1, len(y))), h.T
    pc = _softmax_gradient(p["c"].T @ h + p["cb"][:, None], np.minimum(y, k) // WIDTH, m)
    grad["c"] += h @ pc.T
    grad["cb"] += pc.sum(axis=1)
    dh = p["c"] @ pc
    own = np.flatnonzero(y < k)
    order, classes = _by_class(y[own])
    own = own[order]
    states, places = h.take(own, axis=1), y[own] % WIDTH
    d = np.empty_like(states)
    for c, a, b in classes:
        part = slice(c * WIDTH, (c + 1) * WIDTH)
        pw = _softmax_gradient(p["w"][part] @ states[:, a:b] + p["wb"][part][:, None], places[a:b], m)
        grad["w"][part] += pw @ states[:, a:b].T
        grad["wb"][part] += pw.sum(axis=1)
        d[:, a:b] = p["w"][part].T @ pw
    dh[:, own] += d
    return dh.T


def train(p: dict, state: dict, texts: list[np.ndarray], batch: int = 512) -> None:
    """One pass over ``texts`` (token numbers), in place; ``state`` holds the squared gradients (AdaGrad).

    Texts are cut into segments of SEGMENT tokens that run side by side; in a
    segment the state is carried from window to window, the gradient is not."""
    k = len(p["w"])
    pieces = []
    for t in texts:
        t = np.minimum(t, k)
        before = np.concatenate([[k + 1], t[:-1]])
        pieces += [(before[a:a + SEGMENT], t[a:a + SEGMENT]) for a in range(0, len(t), SEGMENT)]
    pieces.sort(key=lambda s: -len(s[1]))
    for at in range(0, len(pieces), batch):
        some = pieces[at:at + batch]
        length = np.array([len(y) for _, y in some])
        xs, ys = (np.zeros((len(some), length[0]), np.int32) for _ in range(2))
        for i, (x, y) in enumerate(some):
            xs[i, :len(x)], ys[i, :len(y)] = x, y
        h = np.zeros((HIDDEN, len(some)), F32)
        for lo in range(0, int(length[0]), WINDOW):
            times = range(lo, min(lo + WINDOW, int(length[0])))
            sizes = np.searchsorted(-length, -np.array(times), side="left")  # the segments longer than t come first
            ends = np.cumsum(sizes)
            inputs, targets = (np.concatenate([v[:m, t] for t, m in zip(times, sizes)]) for v in (xs, ys))
            gates = np.ascontiguousarray(p["x"].T).take(inputs, axis=1, mode="clip")
            befores, states, z, r, an, n = (np.empty((HIDDEN, len(inputs)), F32) for _ in range(6))
            for m, end in zip(sizes, ends):
                at = slice(end - m, end)
                befores[:, at] = h[:, :m]
                h, (z[:, at], r[:, at], an[:, at], n[:, at]) = _step(p, gates[:, at], h[:, :m])
                states[:, at] = h
            grad = {name: np.zeros_like(w) for name, w in p.items()}
            dh_all = _output_gradient(p, states.T, targets, grad).T
            dx, da = (np.empty((3 * HIDDEN, len(inputs)), F32) for _ in range(2))
            to_n, to_z, to_r = (1 - z) * (1 - n * n), (befores - n) * z * (1 - z), an * r * (1 - r)
            dh = np.zeros((HIDDEN, 0), F32)
            for m, end in zip(sizes[::-1], ends[::-1]):
                at = slice(end - m, end)
                d = dh_all[:, at]
                d[:, :dh.shape[1]] += dh
                dn = d * to_n[:, at]
                np.multiply(d, to_z[:, at], out=da[:HIDDEN, at])
                np.multiply(dn, to_r[:, at], out=da[HIDDEN:2 * HIDDEN, at])
                np.multiply(dn, r[:, at], out=da[2 * HIDDEN:, at])
                dx[2 * HIDDEN:, at] = dn
                dh = d * z[:, at] + p["u"] @ da[:, at]
            dx[:2 * HIDDEN] = da[:2 * HIDDEN]
            grad["u"] += befores @ da.T
            grad["n"] += da[2 * HIDDEN:].sum(axis=1)
            order = np.argsort(inputs, kind="stable")
            x = inputs[order]
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            grad["x"][x[first]] = np.add.reduceat(dx.take(order, axis=1), first, axis=1).T
            for name, g in grad.items():
                state[name] += g * g
                p[name] -= F32(RATE) * g / (np.sqrt(state[name]) + F32(1e-6))


def fresh_state(p: dict) -> dict:
    return {name: np.full_like(w, 1e-8) for name, w in p.items()}


def score(p: dict, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each whole text; the state is carried from its first token to its last."""
    k = len(p["w"])
    out = np.zeros(len(texts))
    order = sorted((i for i in range(len(texts)) if len(texts[i])), key=lambda i: -len(texts[i]))
    length = np.array([len(texts[i]) for i in order])
    flat = np.minimum(np.concatenate([texts[i] for i in order]), k) if order else np.empty(0, np.int64)
    begin = np.cumsum(length) - length
    owner = np.array(order)
    inputs = np.ascontiguousarray(p["x"].T)
    h = np.zeros((HIDDEN, len(order)), F32)
    x = np.full(len(order), k + 1)
    t, top = 0, int(length[0]) if order else 0
    while t < top:
        states, targets, owners, held = [], [], [], 0
        while t < top and held < 1 << 16:
            m = int(np.searchsorted(-length, -t, side="left"))
            h, _ = _step(p, inputs.take(x[:m], axis=1, mode="clip"), h[:, :m])
            y = flat[begin[:m] + t]
            states.append(h)
            targets.append(y)
            owners.append(owner[:m])
            x, held, t = y, held + m, t + 1
        got = log_probs(p, np.concatenate(states, axis=1).T, np.concatenate(targets))
        out += np.bincount(np.concatenate(owners), got, minlength=len(out))
    return out
