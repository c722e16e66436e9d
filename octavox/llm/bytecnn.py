"""A small byte convolutional network in numpy: training on sampled windows, scoring of whole texts in Arrow batches.

The input is a text's UTF-8 bytes, mapped to at most `SYMBOLS` symbols. Filters of widths 2, 3 and 4 slide over
windows; each filter keeps its maximum in a window (max pooling after a rectifier) and a linear layer maps the maxima
to logits. For scoring, filters are folded into two tables by pairs of symbols, so that a position costs two
look-ups instead of a product. An optional second input channel counts, around each position, the bytes that
repeat an earlier part of the same window.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

SYMBOLS, WIDTHS, TAIL, SPAN = 96, (2, 3, 4), 4, 32
PIECE = 96
#: Steps of training at least, so that small samples are learned too.
LEAST_STEPS = 400
_SLOTS = 15
_slots: dict[int, np.ndarray] = {}


@dataclass
class Net:
    classes: list
    size: int
    step: int
    fold_case: bool
    repeats: bool
    symbol: np.ndarray
    taps: list = field(default_factory=list)  # for each width: (width, SYMBOLS, filters)
    bias: np.ndarray | None = None
    repeat: np.ndarray | None = None  # (SPAN + 1, all filters)
    out: np.ndarray | None = None
    out_bias: np.ndarray | None = None

    def folded(self) -> tuple[np.ndarray, np.ndarray]:
        first, second = [], []
        for t in self.taps:
            pad = np.zeros((4 - len(t), *t.shape[1:]), np.float32)
            full = np.concatenate([t, pad])
            first.append((full[0][:, None] + full[1][None]).reshape(SYMBOLS * SYMBOLS, -1))
            second.append((full[2][:, None] + full[3][None]).reshape(SYMBOLS * SYMBOLS, -1))
        return np.ascontiguousarray(np.concatenate(first, 1) + self.bias, np.float32), np.ascontiguousarray(np.concatenate(second, 1), np.float32)


def fold_bytes(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the two-byte letters of Latin-1."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        after = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][after] += 32
    return out


def windows_of(offsets: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of every window; windows cover each text wholly, an empty text has one empty window."""
    lengths = np.diff(offsets)
    count = np.maximum(1, -(-(lengths - size) // step) + 1)
    doc = np.repeat(np.arange(len(lengths)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][doc] + k * step
    return doc, start, np.minimum(offsets[1:][doc], start + size + TAIL)


def cut(data: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the windows as rows, and which of them are there."""
    at = start[:, None] + np.arange(size + TAIL)
    there = at < end[:, None]
    if not len(data):
        return np.zeros(at.shape, np.uint8), there
    return np.where(there, data[np.minimum(at, len(data) - 1)], 0), there


def repeat_counts(rows: np.ndarray, there: np.ndarray, size: int) -> np.ndarray:
    """For each position, how many of the next SPAN five-byte strings come again later in the same window."""
    r = rows.astype(np.uint32)
    code = r[:, :size].copy()
    for k in range(1, 5):
        code *= np.uint32(0x01000193)
        code += r[:, k : k + size]
    slot = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - _SLOTS)).astype(np.int64)
    slot += (np.arange(len(rows)) << _SLOTS)[:, None]
    table = _slots.get(len(rows))
    if table is None:
        _slots.clear()
        table = _slots[len(rows)] = np.zeros(len(rows) << _SLOTS, np.int16)
    place = np.broadcast_to(np.arange(size, dtype=np.int16), slot.shape)
    table[slot] = place
    again = (table[slot] != place) & there[:, 4 : size + 4]
    total = np.zeros((len(rows), size + SPAN + 1), np.int16)
    np.cumsum(again, axis=1, out=total[:, 1 : size + 1])
    total[:, size + 1 :] = total[:, size : size + 1]
    return total[:, SPAN : SPAN + size] - total[:, :size]


def pooled(net: Net, tables, symbols: np.ndarray, repeats: np.ndarray | None, with_places: bool = False):
    """Maxima of all filters in each window, rectified; also their places, for training."""
    n, size = len(symbols), symbols.shape[1] - TAIL
    s = symbols.astype(np.int32)
    pair = s[:, :-1] * SYMBOLS + s[:, 1:]
    value = np.take(tables[0], pair[:, :size].ravel(), axis=0, mode="clip")
    value += np.take(tables[1], pair[:, 2 : size + 2].ravel(), axis=0, mode="clip")
    if repeats is not None:
        value += np.take(net.repeat, repeats.ravel(), axis=0, mode="clip")
    value = value.reshape(n, size, -1)
    if with_places:
        places = value.argmax(1)
        return np.maximum(np.take_along_axis(value, places[:, None], 1)[:, 0], 0), places
    while value.shape[1] > 1:
        half = value.shape[1] // 2
        odd = value[:, 2 * half :]
        value = np.maximum(value[:, :half], value[:, half : 2 * half])
        if odd.shape[1]:
            value[:, :1] = np.maximum(value[:, :1], odd)
    return np.maximum(value[:, 0], 0)


def train(raw: np.ndarray, there: np.ndarray, labels: np.ndarray, classes: list, *, size: int, step: int, fold_case: bool, repeats: bool, filters: int = 8, epochs: int = 8, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Net:
    """Fit a net to sampled windows by Adam; seeded, so that the same windows give the same net."""
    rng = np.random.default_rng(seed)
    bytes_seen = np.bincount(raw[there], minlength=256)
    symbol = np.ones(256, np.uint8)  # 0: past the end of a text, 1: any rare byte
    common = np.argsort(-bytes_seen, kind="stable")[: SYMBOLS - 2]
    common = common[bytes_seen[common] > 0]
    symbol[common] = np.arange(2, 2 + len(common))
    net = Net(classes, size, step, fold_case, repeats, symbol)
    total = filters * len(WIDTHS)
    net.taps = [rng.normal(0, 0.5 / w**0.5, (w, SYMBOLS, filters)).astype(np.float32) for w in WIDTHS]
    for t in net.taps:
        t[:, 0] = 0
    net.bias, net.repeat = np.zeros(total, np.float32), np.zeros((SPAN + 1, total), np.float32)
    net.out, net.out_bias = rng.normal(0, 0.1, (total, len(classes))).astype(np.float32), np.zeros(len(classes), np.float32)
    symbols = np.where(there, symbol[raw], 0).astype(np.uint8)
    counted = np.concatenate([repeat_counts(raw[i : i + PIECE], there[i : i + PIECE], size) for i in range(0, len(raw), PIECE)]) if repeats and len(raw) else None
    params = [*net.taps, net.bias, net.repeat, net.out, net.out_bias]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    a_round = max(1, -(-len(raw) // batch))
    epochs = max(epochs, -(-LEAST_STEPS // a_round))
    turn, steps = 0, epochs * a_round
    count = np.bincount(labels, minlength=len(classes))
    share = len(labels) / (len(classes) * np.maximum(count, 1))  # classes weigh alike
    for _ in range(epochs):
        order = rng.permutation(len(raw))
        for i in range(0, len(raw), batch):
            take = order[i : i + batch]
            top, places = pooled(net, net.folded(), symbols[take], None if counted is None else counted[take], True)
            logits = top @ net.out + net.out_bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(take)), labels[take]] -= 1
            p *= (share[labels[take]] / len(take))[:, None]
            back = (p @ net.out.T) * (top > 0)
            rows = np.arange(len(take))[:, None]
            grads = []
            for k, t in enumerate(net.taps):
                own = slice(k * filters, (k + 1) * filters)
                g = np.zeros_like(t)
                for j in range(len(t)):
                    np.add.at(g[j], (symbols[take][rows, places[:, own] + j], np.arange(filters)[None]), back[:, own])
                g[:, 0] = 0
                grads.append(g)
            g = np.zeros_like(net.repeat)
            if counted is not None:
                np.add.at(g, (counted[take][rows, places], np.arange(total)[None]), back)
            grads += [back.sum(0), g, top.T @ p + 1e-4 * net.out, p.sum(0)]
            turn += 1
            lr = rate * (1 - 0.9 * turn / steps)
            for q, d, m, v in zip(params, grads, mean, square, strict=True):
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                q -= lr * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-6)
    return net


def score_texts(net: Net, tables, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean logits of each text over all its windows, weighted by the bytes in them."""
    if net.fold_case:
        data = fold_bytes(data)
    doc, start, end = windows_of(offsets, net.size, net.step)
    sums = np.zeros((len(offsets) - 1, len(net.classes)))
    weight = np.zeros(len(offsets) - 1)
    for i in range(0, len(doc), PIECE):
        own = slice(i, i + PIECE)
        raw, there = cut(data, start[own], end[own], net.size)
        counts = repeat_counts(raw, there, net.size) if net.repeats else None
        top = pooled(net, tables, np.where(there, net.symbol[raw], 0), counts)
        w = np.maximum(np.minimum(end[own] - start[own], net.size), 1).astype(float)
        np.add.at(sums, doc[own], (top @ net.out + net.out_bias) * w[:, None])
        np.add.at(weight, doc[own], w)
    return sums / np.maximum(weight, 1)[:, None]


def sampled_windows(data: np.ndarray, offsets: np.ndarray, size: int, step: int, fold_case: bool, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to `most` windows of each text, evenly spaced: document, bytes, presence."""
    if fold_case:
        data = fold_bytes(data)
    doc, start, end = windows_of(offsets, size, step)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    n = count[doc]
    keep = (n <= most) | ((k * most) // np.maximum(n, 1) != ((k - 1) * most) // np.maximum(n, 1))
    raw, there = cut(data, start[keep], end[keep], size)
    return doc[keep], raw, there
