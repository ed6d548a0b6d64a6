"""A gated recurrent language model in numpy with a class-factored softmax.

Each step's input is the token before; P(token) = P(class of token | state) * P(token | class, state).  Training is
truncated back-propagation: states are carried from window to window, gradients are not.  Scoring carries the state over
all windows of a document, so its whole text has one log-likelihood.

Rows of the parameters are in the order of frequency (``rank``), so that each class is a range of rows.  What a call
holds besides its tokens is a window of a bounded number of streams, however long a document is.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32
#: Logits are held within this, so that no sum of exponentials overflows.
MOST = F32(60)


def classes_by_frequency(counts: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank, cuts): each token's place in the order of frequency, and where classes begin and end there: each fills a like sum of square roots."""
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(counts), np.int64)
    rank[order] = np.arange(len(counts))
    root = np.sqrt(counts[order])
    mass = np.cumsum(root)
    cls = np.minimum(classes - 1, (mass - root / 2) / mass[-1] * classes).astype(np.int64)
    return rank, np.r_[0, np.flatnonzero(np.diff(cls)) + 1, len(counts)]


def initial(counts: np.ndarray, classes: int, hidden: int, seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters whose predictions are the frequencies; ``rank`` and ``cuts`` (the classes) are not trained."""
    rng = np.random.default_rng(seed)
    rank, cuts = classes_by_frequency(counts, classes)
    own = np.sort(counts)[::-1]
    mass = np.add.reduceat(own, cuts[:-1])
    v, c = len(counts), len(mass)
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(F32)
    return {
        "E": draw(v, 3 * hidden), "U": draw(hidden, 3 * hidden), "b": np.zeros(3 * hidden, F32), "Wc": draw(hidden, c) * F32(0.1), "bc": np.log(mass / mass.sum()).astype(F32),
        "Wo": draw(v, hidden) * F32(0.1), "bo": np.log(own / np.repeat(mass, np.diff(cuts))).astype(F32), "rank": rank, "cuts": cuts,
    }


def _sigmoid(x):
    x *= F32(0.5)
    np.tanh(x, out=x)
    x += F32(1)
    x *= F32(0.5)
    return x


def step(u: np.ndarray, gx: np.ndarray, h: np.ndarray):
    """One step for a batch from the inputs' share ``gx`` of the gates; returns the new state and what back-propagation needs."""
    n = h.shape[1]
    gh = h @ u
    zr = gh[:, : 2 * n] + gx[:, : 2 * n]
    _sigmoid(zr)
    z, ghn = zr[:, :n], gh[:, 2 * n :]
    new = zr[:, n:] * ghn
    new += gx[:, 2 * n :]
    np.tanh(new, out=new)
    out = h - new
    out *= z
    out += new
    return out, (h, zr, new, ghn)


def _sorted(x: np.ndarray) -> np.ndarray:
    """The order that sorts row numbers, ties as they stand: few numbers are sorted as short integers, which is done by counting."""
    return np.argsort(x.astype(np.uint16) if len(x) and int(x.max()) < 1 << 16 else x, kind="stable")


def _softmax_at(a: np.ndarray, at: np.ndarray, y: np.ndarray, ones: np.ndarray, grad: bool):
    """Log probabilities of ``y`` under the rows of logits ``a``; with ``grad``, ``a`` becomes the gradient."""
    np.maximum(a, -MOST, out=a)
    np.minimum(a, MOST, out=a)
    out = a[at, y]
    np.exp(a, out=a)
    s = a @ ones
    out -= np.log(s)
    if grad:
        a /= s[:, None]
        a[at, y] -= 1
    return out


def _log_probs(p: dict, h: np.ndarray, y: np.ndarray, grad: dict | None = None):
    cuts = p["cuts"]
    order = _sorted(y)
    y, h = y[order], h[order]
    ones = np.ones(max(len(y), len(p["bo"])), F32)
    c = np.searchsorted(cuts, y, "right") - 1
    at = np.arange(len(y))
    a = h @ p["Wc"]
    a += p["bc"]
    ours = _softmax_at(a, at, c, ones[: a.shape[1]], grad is not None)
    if grad is not None:
        grad["Wc"] += h.T @ a
        grad["bc"] += ones[: len(y)] @ a
        dh = a @ p["Wc"].T
    edge = np.searchsorted(y, cuts).tolist()
    for k, (i, j) in enumerate(zip(edge[:-1], edge[1:])):
        m, n = int(cuts[k]), int(cuts[k + 1])
        if i == j or n - m == 1:
            continue
        w, hr = p["Wo"][m:n], h[i:j]
        a = hr @ w.T
        a += p["bo"][m:n]
        ours[i:j] += _softmax_at(a, at[: j - i], y[i:j] - m, ones[: n - m], grad is not None)
        if grad is not None:
            grad["Wo"][m:n], grad["bo"][m:n] = a.T @ hr, ones[: j - i] @ a
            dh[i:j] += a @ w
    out = np.empty(len(y), F32)
    out[order] = ours
    if grad is None:
        return out
    back = np.empty_like(dh)
    back[order] = dh
    return out, back


def log_probs(p: dict, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probability of each target token after each state."""
    return _log_probs(p, h, p["rank"][y])


def train(p: dict, documents: list[np.ndarray], start: int, streams: int = 256, window: int = 16, rate: float = 0.1, caution: float = 3e-3, past: dict | None = None) -> int:
    """Adagrad steps over the documents, in place: they are cut into ``streams`` of like length, ``window`` steps at a time.

    The state starts anew with each document; a stream that begins inside one has no state from before.
    """
    docs = [d for d in documents if len(d)]
    if not docs:
        return 0
    y_all = p["rank"][np.concatenate(docs)]
    size = np.array([len(d) for d in docs])
    fresh_all = np.zeros(len(y_all), bool)
    fresh_all[np.cumsum(size) - size] = True
    x_all = np.r_[p["rank"][start], y_all[:-1]]
    x_all[fresh_all] = p["rank"][start]
    streams = max(1, min(streams, len(y_all) // window))
    length = -(-len(y_all) // streams)
    first = np.arange(streams) * length
    first = first[first < len(y_all)]
    ends = np.minimum(first + length, len(y_all))
    names = ("E", "U", "b", "Wc", "bc", "Wo", "bo")
    past = {k: np.full_like(p[k], caution) for k in names} if past is None else past
    h = np.zeros((len(first), p["U"].shape[0]), F32)
    n = h.shape[1]
    for t0 in range(0, length, window):
        t1 = min(length, t0 + window)
        at = first + np.arange(t0, t1)[:, None]
        inside = at < ends  # the last stream may be shorter
        at = np.minimum(at, len(y_all) - 1)
        x, keep = x_all[at], ~fresh_all[at]
        gx = p["E"][x.ravel()].reshape(t1 - t0, len(first), 3 * n)
        gx += p["b"]
        tape, states = [], np.empty((t1 - t0, len(first), n), F32)
        for t in range(t1 - t0):
            h = h * keep[t, :, None]
            h, kept = step(p["U"], gx[t], h)
            tape.append(kept)
            states[t] = h
        grad = {k: np.zeros_like(p[k]) for k in ("Wc", "bc", "Wo", "bo")}
        stack, y = states.reshape(-1, n), y_all[at].ravel()
        if inside.all():
            dh = _log_probs(p, stack, y, grad)[1]
        else:
            some = np.flatnonzero(inside.ravel())
            dh = np.zeros_like(stack)
            dh[some] = _log_probs(p, stack[some], y[some], grad)[1]
        dh = dh.reshape(states.shape)
        back = np.zeros_like(h)
        u_gates, u_new = np.ascontiguousarray(p["U"][:, : 2 * n].T), np.ascontiguousarray(p["U"][:, 2 * n :].T)
        dg, dgh = np.empty_like(gx), np.empty_like(states)
        for t in range(t1 - t0 - 1, -1, -1):
            before, zr, new, ghn = tape[t]
            z, r = zr[:, :n], zr[:, n:]
            d = dh[t]
            d += back
            g, gh = dg[t], dgh[t]
            dz, dr, dnew = g[:, :n], g[:, n : 2 * n], g[:, 2 * n :]
            slope = zr * (1 - zr)  # of both gates at once
            dzn = d * z
            np.subtract(d, dzn, out=dnew)
            dnew *= 1 - new * new
            np.subtract(before, new, out=dz)
            dz *= d
            np.multiply(dnew, ghn, out=dr)
            g[:, : 2 * n] *= slope
            np.multiply(dnew, r, out=gh)
            back = g[:, : 2 * n] @ u_gates
            back += gh @ u_new
            back += dzn
            back *= keep[t, :, None]
        before = np.concatenate([tape[0][0][None], states[:-1]])
        before[1:] *= keep[1:, :, None]
        before, dg = before.reshape(-1, n), dg.reshape(-1, 3 * n)
        grad["U"] = np.hstack([before.T @ dg[:, : 2 * n], before.T @ dgh.reshape(-1, n)])
        grad["b"] = dg.sum(0)
        xs = x.ravel()
        order = _sorted(xs)
        starts = np.r_[0, np.flatnonzero(np.diff(xs[order])) + 1]
        seen = xs[order][starts]
        scale = F32(16 / (max(1, len(first)) * window))

        def move(k, g, at=slice(None)):
            g *= scale
            np.clip(g, -1, 1, out=g)
            new = g * g
            new += past[k][at]
            past[k][at] = new
            np.sqrt(new, out=new)
            g /= new
            g *= F32(rate)
            p[k][at] -= g

        for k in ("U", "b", "Wc", "bc", "Wo", "bo"):
            move(k, grad[k])
        move("E", np.add.reduceat(dg[order], starts), seen)
    return len(y_all)


def score(p: dict, documents: list[np.ndarray], start: int, window: int = 16, streams: int = 512) -> np.ndarray:
    """The natural log probability of every token, documents one after another, the state carried over all windows of each."""
    size = np.array([len(d) for d in documents], np.int64)
    flat = p["rank"][np.concatenate([np.zeros(0, np.int64), *documents])]
    order = np.argsort(-size, kind="stable")  # those still running come first
    order = order[: int((size > 0).sum())]
    out = np.zeros(len(flat), F32)
    n = p["U"].shape[0]
    begin = p["rank"][start]
    for group in (order[i : i + streams] for i in range(0, len(order), streams)):
        lengths, first = size[group], (np.cumsum(size) - size)[group]
        h = np.zeros((len(group), n), F32)
        last = np.full(len(group), begin, np.int64)
        held_states, held_places, held = [], [], 0
        for t0 in range(0, int(lengths[0]), window):
            live = np.searchsorted(-lengths, -np.arange(t0, min(t0 + window, int(lengths[0])))).tolist()
            at = np.minimum(first[: live[0]] + np.arange(t0, t0 + len(live))[:, None], len(flat) - 1)
            x = np.empty_like(at)
            x[0] = last[: live[0]]
            x[1:] = flat[at[:-1]]
            gx = p["E"][x.ravel()].reshape(*x.shape, 3 * n)
            gx += p["b"]
            for t, k in enumerate(live):
                h, _ = step(p["U"], gx[t, :k], h[:k])
                held_states.append(h)
                held_places.append(at[t, :k])
                held += k
            last = flat[at[-1, : live[-1]]]
            if held >= 16384:
                _place(p, flat, out, held_states, held_places)
                held_states, held_places, held = [], [], 0
        if held:
            _place(p, flat, out, held_states, held_places)
    return out


def _place(p, flat, out, states, places):
    places = np.concatenate(places)
    out[places] = _log_probs(p, np.concatenate(states), flat[places])


TRAINED = ("E", "U", "b", "Wc", "bc", "Wo", "bo")


def to_vector(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in TRAINED])


def from_vector(like: dict, v: np.ndarray) -> dict:
    out, at = {"rank": like["rank"], "cuts": like["cuts"]}, 0
    for k in TRAINED:
        out[k] = v[at : at + like[k].size].reshape(like[k].shape).astype(F32)
        at += like[k].size
    return out
