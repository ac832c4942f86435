"""A small causal self-attention model in numpy: forward, backward, training and window scoring."""

from __future__ import annotations

import numpy as np

WIDTH, CONTEXT, FRESH = 16, 16, 32  # model width; words seen before, and scored, by a window
SPAN = CONTEXT + FRESH
GROUPS, MEMBERS = 32, 64  # a class is a member of a group: its probability is that of the group times its own in there
SMALL, LARGE, SMALL_STEPS = 16, 64, 200  # windows a step, and how many steps are small
RATE = 0.015
SAFE = 60.0  # exp(-60) to 64 * exp(60) are single-precision numbers, with room for products
_LATER = np.triu(np.full((SPAN, SPAN), -1e9, np.float32), 1)


def initial(inputs: int, outputs: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Parameters for `inputs` ids; outputs: counts of the GROUPS * MEMBERS classes to predict, which set the biases."""
    r = np.random.default_rng(seed)
    outputs = outputs.reshape(GROUPS, MEMBERS) + 0.5
    p = {"E": r.normal(0, 0.3, (inputs, WIDTH)), "P": r.normal(0, 0.05, (SPAN, WIDTH)), "Q": r.normal(0, 0.25, (WIDTH, WIDTH)), "K": r.normal(0, 0.25, (WIDTH, WIDTH)), "V": r.normal(0, 0.25, (WIDTH, WIDTH)), "O": r.normal(0, 0.1, (WIDTH, GROUPS)), "B": np.log(outputs.sum(1) / outputs.sum()), "M": r.normal(0, 0.1, (GROUPS, WIDTH, MEMBERS)), "C": np.log(outputs / outputs.sum(1, keepdims=True))}
    return {k: v.astype(np.float32) for k, v in p.items()}


def window_starts(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sequences of these lengths: sequence and first scored place of each window; each place is scored once."""
    n = -(-lengths // FRESH)
    seq = np.repeat(np.arange(len(lengths)), n)
    return seq, (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * FRESH


def gather(flat: np.ndarray, begin: np.ndarray, lengths: np.ndarray, seq: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Input ids of the windows and which places exist. Place -CONTEXT.. of the sequence is 0 beyond its ends."""
    place = first[:, None] - CONTEXT + np.arange(SPAN)
    real = (place >= 0) & (place < lengths[seq][:, None])
    return np.where(real, flat[np.where(real, begin[seq][:, None] + place, 0)], 0), real


def forward(p: dict, ids: np.ndarray, real: np.ndarray, since: int = 0):
    """Inputs, queries (scaled, of the places from `since` on), keys and values, attention weights (each row times its sum),
    these sums, and what is read by them."""
    x = p["E"].take(ids, 0) + p["P"]
    y = (x.reshape(-1, WIDTH) @ _projections(p)).reshape(*ids.shape, 3 * WIDTH)
    q, k, v = y[:, since:, :WIDTH], y[:, :, WIDTH : 2 * WIDTH], y[:, :, 2 * WIDTH :]
    s = q @ k.transpose(0, 2, 1)
    steep = _steep(s)
    s += _LATER[since:]
    if not real[:, 0].all():  # the first window of a text has nothing in front
        s += np.where(real[:, None, :], np.float32(0), np.float32(-1e9))
        steep |= since < CONTEXT  # places in front of a text see nothing: shifted, they still have a sum
    if steep:
        s -= s.max(2, keepdims=True)
    np.exp(s, out=s)
    total = (s.reshape(-1, SPAN) @ np.ones(SPAN, s.dtype)).reshape(*s.shape[:2], 1)
    c = s @ v
    c /= total
    return x, q, k, v, s, total, c


def _steep(z: np.ndarray) -> bool:
    """Whether exponentials could leave the range of single precision, so that each row has to be shifted by its maximum."""
    return z.size > 0 and not -SAFE < z.min() <= z.max() < SAFE


def _projections(p: dict) -> np.ndarray:
    return np.hstack([p["Q"] * np.float32(WIDTH**-0.5), p["K"], p["V"]])


def score(p: dict, flat: np.ndarray, begin: np.ndarray, lengths: np.ndarray, targets: np.ndarray, block: int = 64) -> np.ndarray:
    """Natural log-probability of each target given the inputs up to its place; all sequences one after the other."""
    out = np.zeros(len(flat), np.float64)
    seq, first = window_starts(lengths)
    for i in range(0, len(seq), block):
        w, f = seq[i : i + block], first[i : i + block]
        ids, real = gather(flat, begin, lengths, w, f)
        x, *_, c = forward(p, ids, real, CONTEXT)
        h = x[:, CONTEXT:] + c
        fresh = real[:, CONTEXT:]
        at = ((begin[w] + f)[:, None] + np.arange(FRESH))[fresh]
        out[at] = log_probabilities(p, h[fresh], targets[at])
    return out


def _chosen(z: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of one entry of each row of z, which then holds the exponentials; and their sums."""
    if _steep(z):
        z -= z.max(1, keepdims=True)
    chosen = z[np.arange(len(z)), at]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    return chosen - np.log(total), total


def _by_group(targets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """Order of the rows by the group of their class; groups that occur and their rows in that order."""
    group = (targets // MEMBERS).astype(np.int16)  # 16 bits are sorted by digits
    order = np.argsort(group, kind="stable")
    edges = np.searchsorted(group[order], np.arange(GROUPS + 1)).tolist()
    return order, [(g, slice(edges[g], edges[g + 1])) for g in range(GROUPS) if edges[g] < edges[g + 1]]


def _members(p: dict, h: np.ndarray, groups: list[tuple[int, slice]]) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order of their groups: what speaks for each member of the group, and the rows with a one behind (for the bias)."""
    h = np.concatenate([h, np.ones((len(h), 1), h.dtype)], 1)
    weights = np.concatenate([p["M"], p["C"][:, None]], 1)
    z = np.empty((len(h), MEMBERS), np.result_type(h, weights))
    for g, rows in groups:
        np.matmul(h[rows], weights[g], out=z[rows])
    return z, h


def log_probabilities(p: dict, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
    order, groups = _by_group(targets)
    h, own = h.take(order, 0), targets[order]
    z = h @ p["O"]
    z += p["B"]
    out = np.empty(len(h), np.float64)
    out[order] = _chosen(z, own // MEMBERS)[0].astype(np.float64) + _chosen(_members(p, h, groups)[0], own % MEMBERS)[0]
    return out


def gradients(p: dict, ids: np.ndarray, real: np.ndarray, targets: np.ndarray) -> tuple[dict, float]:
    """Gradients of the mean loss over all places."""
    x, q, k, v, a, total, c = forward(p, ids, real)
    n = np.float32(max(1, int(real.sum())))
    rows = np.flatnonzero(real)
    order, groups = _by_group(targets.ravel()[rows])
    rows = rows[order]
    hf, tf = (x + c).reshape(-1, WIDTH).take(rows, 0), targets.ravel()[rows]

    def slope(z: np.ndarray, at: np.ndarray) -> float:
        """Sum of the log-probabilities; z becomes the gradient of the mean loss."""
        chosen, sums = _chosen(z, at)
        z *= (1 / (n * sums))[:, None]
        z[np.arange(len(z)), at] -= 1 / n
        return float(chosen.sum())

    z = hf @ p["O"]
    z += p["B"]
    loss = -slope(z, tf // MEMBERS)
    g = {"O": hf.T @ z, "B": z.sum(0)}
    df = z @ p["O"].T
    z, hf = _members(p, hf, groups)
    loss -= slope(z, tf % MEMBERS)
    both = np.zeros((GROUPS, WIDTH + 1, MEMBERS), z.dtype)
    for i, own in groups:
        np.matmul(hf[own].T, z[own], out=both[i])
        df[own] += z[own] @ p["M"][i].T
    g["M"], g["C"] = both[:, :WIDTH], both[:, WIDTH]
    dh = np.zeros_like(x)
    dh.reshape(-1, WIDTH)[rows] = df
    part = dh / total  # as the rows of a are not divided by their sums
    dv, da = a.transpose(0, 2, 1) @ part, part @ v.transpose(0, 2, 1)
    da -= (part * c).sum(2, keepdims=True)  # the sum of da times the weights: c is what they read from v
    da *= a
    d = np.concatenate([da @ k, da.transpose(0, 2, 1) @ q, dv], 2).reshape(-1, 3 * WIDTH)
    g["Q"], g["K"], g["V"] = np.hsplit(x.reshape(-1, WIDTH).T @ d, 3)
    g["Q"] = g["Q"] * np.float32(WIDTH**-0.5)
    dx = dh + (d @ _projections(p).T).reshape(x.shape)
    dx *= real[:, :, None]
    g["P"] = dx.sum(0)
    flat = ids.ravel().astype(np.int16 if len(p["E"]) <= 1 << 15 else np.int64)
    order = np.argsort(flat, kind="stable")
    own = flat[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    g["E"] = np.zeros_like(p["E"])
    g["E"][own[first]] = np.add.reduceat(dx.reshape(-1, WIDTH).take(order, 0), first, axis=0)
    return g, loss / float(n)


class Training:
    """Adam over windows that come piece by piece; small steps first, so that little text is enough to begin with."""

    def __init__(self, p: dict[str, np.ndarray], seed: int = 5):
        self.flat = np.concatenate([v.ravel() for v in p.values()])  # all parameters, which p shows by name
        ends = np.cumsum([v.size for v in p.values()])
        self.p = {k: x.reshape(v.shape) for (k, v), x in zip(p.items(), np.split(self.flat, ends[:-1]), strict=True)}
        self.m, self.s = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.random, self.step, self.seen = np.random.default_rng(seed), 0, 0

    def windows(self, flat: np.ndarray, targets: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> None:
        """One pass over all windows of these sequences: side by side, so that every place is a target once."""
        n = -(-lengths // SPAN)
        seq = np.repeat(np.arange(len(lengths)), n)
        first = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * SPAN
        order, at = self.random.permutation(len(seq)), 0
        while at < len(order):
            x = order[at : at + (SMALL if self.step < SMALL_STEPS else LARGE)]
            at += len(x)
            place = first[x][:, None] + np.arange(SPAN)
            real = place < lengths[seq[x]][:, None]
            place = np.where(real, begin[seq[x]][:, None] + place, begin[seq[x]][:, None])
            self.update(np.where(real, flat[place], 0), real, targets[place])

    def update(self, ids: np.ndarray, real: np.ndarray, targets: np.ndarray) -> None:
        g, _ = gradients(self.p, ids, real, targets)
        self.step += 1
        self.seen += len(ids)
        rate, small = RATE / (1 + self.step / 400), (1 - 0.99**self.step) ** 0.5
        d = np.concatenate([g[k].ravel() for k in self.p])
        square = d * d
        for mean, new, keep in ((self.m, d, 0.9), (self.s, square, 0.99)):
            mean *= keep
            new *= 1 - keep
            mean += new
        np.sqrt(self.s, out=d)
        d += 1e-8 * small
        np.divide(self.m, d, out=d)
        d *= rate * small / (1 - 0.9**self.step)
        self.flat -= d
