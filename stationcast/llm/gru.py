"""A gated recurrent language model over symbols, in numpy.

Symbols stand in groups of equal size; the output is a softmax over groups times a
softmax inside the group. Training is truncated backpropagation through time over
parallel streams whose state is carried from window to window and reset where a document
starts; scoring carries the state through a whole document.
"""

from __future__ import annotations

import numpy as np

GROUPS, GROUP = 24, 24
SYMBOLS = GROUPS * GROUP
HIDDEN = 24
STREAMS, WINDOW = 128, 32
RATE, CLIP = 0.01, 1.0
#: Symbols scored in one go.
SCORED = 1 << 13
#: States that are worth a gather and products by planes; below, calls cost more than numbers.
WIDE = 256
#: Logits that differ by no more keep their exponentials within single precision.
SPREAD = 80.0
SHAPES = {
    "input": (SYMBOLS, 3 * HIDDEN), "state": (HIDDEN, 3 * HIDDEN),
    "group": (HIDDEN, GROUPS), "group_bias": (GROUPS,),
    "inside": (GROUPS, HIDDEN, GROUP), "inside_bias": (GROUPS, GROUP),
}

Parameters = dict[str, np.ndarray]


def begin(counts: np.ndarray, seed: int = 0) -> Parameters:
    """Small weights, and the output biases of symbol ``counts``."""
    rng = np.random.default_rng(seed)
    p = {name: (rng.standard_normal(shape) * 0.1).astype(np.float32) for name, shape in SHAPES.items()}
    share = (np.asarray(counts, float) + 0.1).reshape(GROUPS, GROUP)
    p["group_bias"] = np.log(share.sum(axis=1) / share.sum()).astype(np.float32)
    p["inside_bias"] = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
    return p


def flat(p: Parameters) -> np.ndarray:
    return np.concatenate([p[name].ravel() for name in SHAPES])


def views(vector: np.ndarray) -> Parameters:
    """The parameters that lie one after the other in ``vector``."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = vector[at : at + n].reshape(shape)
        at += n
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.divide(1, x, out=x)


def exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(x - top) and ``top``: one number for all, or that of each column where exponentials would vanish."""
    top = x.max()
    if top - x.min() > SPREAD:
        top = x.max(axis=0)
    out = x - top
    return np.exp(out, out=out), top


def by_group(symbols: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The places of the symbols in the order of their groups, and each group's part of these."""
    group = (symbols // GROUP).astype(np.int8)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(GROUPS + 1))
    return order, [(g, slice(bounds[g], bounds[g + 1])) for g in range(GROUPS) if bounds[g] < bounds[g + 1]]


def group_logits(p: Parameters, state: np.ndarray) -> np.ndarray:
    """Logits of the groups, a column for each state (row): softmaxes are quicker down columns."""
    out = p["group"].T @ state.T
    out += p["group_bias"][:, None]
    return out


def inner_logits(p: Parameters, state: np.ndarray, parts: list[tuple[int, slice]]) -> np.ndarray:
    """Logits inside the groups, a column for each state (row); states stand in the order of the groups."""
    out = np.empty((GROUP, len(state)), np.result_type(p["inside"], state))
    for g, at in parts:
        np.matmul(p["inside"][g].T, state[at].T, out=out[:, at])
        out[:, at] += p["inside_bias"][g][:, None]
    return out


def log_likelihood(p: Parameters, state: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log-probabilities of ``target`` after the states (rows)."""

    def chosen(x: np.ndarray, which: np.ndarray) -> np.ndarray:
        e, top = exponentials(x)
        return x[which, np.arange(len(which))] - top - np.log(e.sum(axis=0))

    out = chosen(group_logits(p, state), target // GROUP)
    order, parts = by_group(target)
    out[order] += chosen(inner_logits(p, state.take(order, axis=0), parts), target[order] % GROUP)
    return out


def planes(table: np.ndarray) -> np.ndarray:
    """The columns of both gates and of the candidate one after the other, times -1 and 2 as their exponentials need them."""
    out = np.ascontiguousarray(table.reshape(len(table), 3, HIDDEN).swapaxes(0, 1))
    out[:2] *= -1
    out[2] *= 2
    return out


def gated(weights: np.ndarray, x: np.ndarray, h: np.ndarray, g: np.ndarray, zr: np.ndarray, n: np.ndarray, out: np.ndarray) -> None:
    """The next state into ``out``; what a step back needs is left in ``g``, ``zr`` and ``n``. ``weights`` and ``x`` are planes.

    tanh(a) is 1 - 2 / (1 + exp(2 a)): NumPy's exponentials take a third of the time.
    """
    np.matmul(h, weights, out=g)
    np.add(x[:2], g[:2], out=zr)
    np.exp(zr, out=zr)
    zr += 1
    np.divide(1, zr, out=zr)
    np.multiply(zr[1], g[2], out=n)
    n += x[2]
    np.exp(n, out=n)
    n += 1
    np.divide(-2, n, out=n)
    n += 1
    np.subtract(h, n, out=out)
    out *= zr[0]
    out += n


def step(p: Parameters, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The next state after inputs ``x`` (rows of the input table)."""
    g = h @ p["state"]
    zr = sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
    z, r, gn = zr[:, :HIDDEN], zr[:, HIDDEN:], g[:, 2 * HIDDEN :]
    n = r * gn
    n += x[:, 2 * HIDDEN :]
    np.tanh(n, out=n)
    out = h - n
    out *= z
    out += n
    return out, (h, z, r, n, gn)


def score(p: Parameters, documents: list[np.ndarray], first: int) -> np.ndarray:
    """Natural log-probability of each document's symbols, each after the ones before it; ``first`` precedes all."""
    out = np.zeros(len(documents))
    length = np.array([len(d) for d in documents], np.int64)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    if not len(order):
        return out
    size = length[order]
    start = np.cumsum(size) - size
    symbols = np.concatenate([documents[i] for i in order])
    h = np.zeros((len(order), HIDDEN), np.float32)
    last = np.full(len(order), first)
    active = len(order)
    weights, table = planes(p["state"]), planes(p["input"])
    g, zr, n = (np.empty((k, len(order), HIDDEN), np.float32) for k in (3, 2, 1))
    states, targets, owners, held = [], [], [], 0
    for t in range(int(size[0])):
        if size[active - 1] <= t:
            while size[active - 1] <= t:
                active -= 1
            g, zr, n = (a[:, :active] for a in (g, zr, n))
        if active < WIDE:
            h, _ = step(p, p["input"].take(last[:active], axis=0), h[:active])
        else:
            before, h = h[:active], np.empty((active, HIDDEN), np.float32)
            gated(weights, table.take(last[:active], axis=1), before, g, zr, n[0], h)
        last = symbols[start[:active] + t]
        states.append(h)
        targets.append(last)
        owners.append(order[:active])
        held += active
        if held >= SCORED or t == size[0] - 1:
            found = log_likelihood(p, np.concatenate(states), np.concatenate(targets))
            out += np.bincount(np.concatenate(owners), weights=found, minlength=len(out))
            states, targets, owners, held = [], [], [], 0
    return out


class Trainer:
    """Adam over truncated backpropagation; ``feed`` takes documents, ``vector`` holds the result."""

    def __init__(self, parameters: Parameters, first: int):
        self.vector = flat(parameters)
        self.parameters = views(self.vector)
        self.first = first
        self.mean, self.square, self.grad = (np.zeros_like(self.vector) for _ in range(3))
        self.updates = self.symbols = 0

    def feed(self, documents: list[np.ndarray]) -> None:
        """One pass over the documents, laid out in parallel streams."""
        symbols = np.concatenate([np.array([], np.int64), *documents])
        n = len(symbols)
        if not n:
            return
        starts = np.cumsum([0, *(len(d) for d in documents)])[:-1]
        new = np.zeros(n, bool)
        new[starts[starts < n]] = True
        before = np.where(new, self.first, np.roll(symbols, 1))
        width = min(STREAMS, -(-n // WINDOW))
        length = -(-n // width)
        pad = width * length - n

        def streams(x: np.ndarray, fill) -> np.ndarray:
            return np.append(x, np.full(pad, fill, x.dtype)).reshape(width, length).T

        symbols, before, new = streams(symbols, 0), streams(before, self.first), streams(new, True)
        real = streams(np.ones(n, bool), False)
        h = np.zeros((width, HIDDEN), np.float32)
        for at in range(0, length, WINDOW):
            span = slice(at, at + WINDOW)
            h = self.window(before[span], symbols[span], new[span], real[span], h)
        self.symbols += n

    def window(self, before: np.ndarray, target: np.ndarray, new: np.ndarray, real: np.ndarray, h: np.ndarray) -> np.ndarray:
        p, (steps, width) = self.parameters, before.shape
        kept = (~new).astype(np.float32)[:, :, None]
        weights, table = planes(p["state"]), planes(p["input"])
        x = table.take(before, axis=1)
        old, n, states = (np.empty((steps, width, HIDDEN), np.float32) for _ in range(3))
        zr, g = (np.empty((steps, k, width, HIDDEN), np.float32) for k in (2, 3))
        for t in range(steps):
            np.multiply(h, kept[t], out=old[t])
            gated(weights, x[:, t], old[t], g[t], zr[t], n[t], states[t])
            h = states[t]
        z, r = zr[:, 0], zr[:, 1]
        grad = views(self.grad)
        back = self.output(states.reshape(-1, HIDDEN), target.ravel(), real.ravel(), grad).reshape(states.shape)
        # what a step passes on is its own gradient times these factors
        by_n = (1 - z) * (1 - n * n)
        gates = np.stack([(old - n) * z * (1 - z), by_n * (g[:, 2] / 2) * r * (1 - r), by_n * r], axis=2)
        carried = np.zeros((width, HIDDEN), np.float32)
        deltas = np.empty((steps, width, 3, HIDDEN), np.float32)
        to_state = np.ascontiguousarray(p["state"].T)
        for t in range(steps - 1, -1, -1):
            back[t] += carried
            np.multiply(back[t][:, None, :], gates[t], out=deltas[t])
            carried = (back[t] * z[t] + deltas[t].reshape(width, -1) @ to_state) * kept[t]
        grad["state"][...] = old.reshape(-1, HIDDEN).T @ deltas.reshape(-1, 3 * HIDDEN)
        deltas[:, :, 2] = back * by_n  # the candidate's input isn't gated
        rows, places = deltas.reshape(-1, 3 * HIDDEN), before.ravel().astype(np.int16)
        order = np.argsort(places, kind="stable")
        ranked = places[order]
        edge = np.flatnonzero(np.append([True], ranked[1:] != ranked[:-1]))
        grad["input"][...] = 0
        grad["input"][ranked[edge]] = np.add.reduceat(rows.take(order, axis=0), edge, axis=0)
        self.update()
        return h

    def output(self, state: np.ndarray, target: np.ndarray, real: np.ndarray, grad: Parameters) -> np.ndarray:
        """The gradients of both softmaxes into ``grad``; returns that of the states."""
        p, weight = self.parameters, (real / max(int(real.sum()), 1)).astype(np.float32)

        def errors(x: np.ndarray, which: np.ndarray, weight: np.ndarray) -> np.ndarray:
            d, _ = exponentials(x)
            d *= weight / d.sum(axis=0)
            d[which, np.arange(len(which))] -= weight
            return d

        d = errors(group_logits(p, state), target // GROUP, weight)
        grad["group"][...], grad["group_bias"][...] = state.T @ d.T, d.sum(axis=1)
        back = d.T @ p["group"].T
        grad["inside"][...], grad["inside_bias"][...] = 0, 0
        order, parts = by_group(target)
        own, inner = state.take(order, axis=0), np.empty_like(back)
        d = errors(inner_logits(p, own, parts), target[order] % GROUP, weight[order])
        grad["inside_bias"][[g for g, _ in parts]] = np.add.reduceat(d, [at.start for _, at in parts], axis=1).T
        for g, at in parts:
            np.matmul(own[at].T, d[:, at].T, out=grad["inside"][g])
            np.matmul(d[:, at].T, p["inside"][g].T, out=inner[at])
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        back += inner.take(place, axis=0)
        return back

    def update(self) -> None:
        g = self.grad * min(1.0, CLIP / (float(np.sqrt(self.grad @ self.grad)) + 1e-9))
        self.updates += 1
        rate = RATE * np.sqrt(1 - 0.99**self.updates) / (1 - 0.9**self.updates)
        self.mean += 0.1 * (g - self.mean)
        self.square += 0.01 * (g * g - self.square)
        self.vector -= np.float32(rate) * self.mean / (np.sqrt(self.square) + 1e-6)
