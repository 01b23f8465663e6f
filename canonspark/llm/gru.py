"""A small gated recurrent language model in numpy.

Words are numbered by the vocabulary (see ``lm_scoring``): the ``short`` most
frequent ones have an embedding and an output each and lie in classes of
``per_class``; every other word is known to the network by its class only.  The
output is factored: a softmax over the classes, and for a class of short-list
words a softmax over its members.

Training is back-propagation through time, truncated to windows of ``steps``
words; the state is carried from window to window.  Several documents run side
by side in *lanes*, each lane a queue of documents with a reset state at every
start.  Scoring runs the same forward pass over whole documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shape:
    short: int = 1024      # words with an output of their own
    per_class: int = 32
    others: int = 9        # classes known by their number only
    embed: int = 16
    hidden: int = 24

    @property
    def short_classes(self) -> int:
        return self.short // self.per_class

    @property
    def classes(self) -> int:
        return self.short_classes + self.others

    def sizes(self) -> dict[str, tuple[int, ...]]:
        h = self.hidden
        return {"E": (self.short + self.others, self.embed), "W": (self.embed, 3 * h), "b": (3 * h,),
                "U": (h, 2 * h), "V": (h, h), "C": (h, self.classes), "c": (self.classes,),
                "O": (self.short_classes, h, self.per_class), "o": (self.short_classes, self.per_class)}


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unpack(flat: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, size in sorted(shape.sizes().items()):
        n = int(np.prod(size))
        out[k] = flat[at : at + n].reshape(size).astype(np.float32)
        at += n
    return out


def start(shape: Shape, word_log_p: np.ndarray, class_log_p: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights; output biases at the log frequencies."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.normal(0, 0.1, s)).astype(np.float32) for k, s in sorted(shape.sizes().items())}
    p["b"][:] = 0
    p["c"][:] = class_log_p
    p["o"][:] = word_log_p.reshape(p["o"].shape)
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def _row_max(x: np.ndarray) -> np.ndarray:
    """Largest entry of every row, as a column; whole halves at a time, as rows are short."""
    while x.shape[-1] > 1:
        half = (x.shape[-1] + 1) // 2
        x = np.maximum(x[..., :half], x[..., -half:])
    return x


def _flat(x: np.ndarray, ok: np.ndarray, every: bool) -> np.ndarray:
    """The entries of a window that stand for words, in one row; not copied if all do."""
    return x.reshape(-1, *x.shape[2:]) if every else x[ok]


def _softmax(x: np.ndarray) -> np.ndarray:
    """Overwrites x."""
    x -= _row_max(x)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def _target_log_p(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log softmax at one place of every row; overwrites x."""
    at = x[np.arange(len(x)), target]
    if x.size and not -60 < x.max() < 60:
        top = x.max(axis=1)
        at -= top
        x -= top[:, None]
    np.exp(x, out=x)
    return at - np.log(x @ np.ones(x.shape[1], dtype=x.dtype))


def lanes_of(lengths: np.ndarray, count: int) -> list[list[int]]:
    """Deal documents to lanes, longest first, to the lane with the least words."""
    count = max(1, min(count, len(lengths)))
    lanes: list[list[int]] = [[] for _ in range(count)]
    load = np.zeros(count, dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        j = int(load.argmin())
        lanes[j].append(int(i))
        load[j] += lengths[i]
    return lanes


class Streams:
    """Documents in lanes, read window by window: memory is that of the documents and
    of one window, however long a lane is."""

    def __init__(self, docs: list[np.ndarray], count: int):
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        lanes = lanes_of(lengths, count)
        lanes.sort(key=lambda lane: -sum(lengths[i] for i in lane))
        order = np.array([i for lane in lanes for i in lane])
        self.words = np.concatenate([docs[i] for i in order]).astype(np.int32)
        self.doc = np.repeat(order.astype(np.int32), lengths[order])
        self.first = np.zeros(len(self.words), dtype=bool)
        self.first[np.cumsum(lengths[order]) - lengths[order]] = True
        self.length = np.array([sum(lengths[i] for i in lane) for lane in lanes], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length

    def windows(self, steps: int):
        """Matrices (time x live lane): word before, word, document; -1 where a lane has
        ended and, for the word before, where a document starts (its state is reset
        and the end mark, number 0, stands before it)."""
        for t in range(0, int(self.length[0]), steps):
            live = int((self.length > t).sum())  # lanes are sorted by length
            time = np.arange(t, min(t + steps, int(self.length[0])))[:, None]
            inside = time < self.length[:live]
            at = np.where(inside, self.start[:live] + time, 0)
            word = np.where(inside, self.words[at], -1)
            before = np.where(inside, self.words[np.maximum(at - 1, 0)], 0)
            before[self.first[at] & inside] = -1
            yield before, word, np.where(inside, self.doc[at], -1)


class Model:
    """Forward and backward passes over windows of lanes."""

    def __init__(self, p: dict[str, np.ndarray], shape: Shape):
        self.p, self.shape = p, shape

    def _steps(self, before: np.ndarray, h: np.ndarray, keep: bool):
        """Run a window (time x lane); returns hidden states after every step."""
        p, n = self.p, self.shape.hidden
        table = p["E"] @ p["W"] + p["b"]
        u, v = p["U"], p["V"]
        given = table[np.maximum(before, 0)]
        out = np.empty((*before.shape, n), dtype=np.float32)
        saved = []
        for t in range(len(before)):
            fresh = before[t] < 0
            if fresh.any():
                h = np.where(fresh[:, None], np.float32(0), h)
            x = given[t]
            gate = _sigmoid(x[:, : 2 * n] + h @ u)
            z, r = gate[:, :n], gate[:, n:]
            rh = r * h
            cand = np.tanh(x[:, 2 * n :] + rh @ v)
            new = cand + z * (h - cand)
            if keep:
                saved.append((h, z, r, rh, cand))
            h = out[t] = new
        return out, h, saved

    def log_p(self, states: np.ndarray, target: np.ndarray):
        """Natural log P of the numbers ``target`` (short words, then other classes)
        given states; and what the backward pass needs."""
        s, p = self.shape, self.p
        cls = np.where(target < s.short, target // s.per_class, target - s.short + s.short_classes)
        lc = _log_softmax(states @ p["C"] + p["c"])
        lp = lc[np.arange(len(target)), cls].astype(np.float64)
        within = []
        mine = np.flatnonzero(target < s.short)
        order = mine[np.argsort(cls[mine], kind="stable")]
        cuts = np.searchsorted(cls[order], np.arange(s.short_classes + 1))
        for k in range(s.short_classes):
            rows = order[cuts[k] : cuts[k + 1]]
            if len(rows):
                lw = _log_softmax(states[rows] @ p["O"][k] + p["o"][k])
                m = target[rows] % s.per_class
                lp[rows] += lw[np.arange(len(rows)), m]
                within.append((k, rows, lw, m))
        return lp, cls, lc, within

    def score_p(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        """``log_p`` without what the backward pass needs."""
        s, p = self.shape, self.p
        cls = np.where(target < s.short, target // s.per_class, target - s.short + s.short_classes)
        lp = _target_log_p(states @ p["C"] + p["c"], cls).astype(np.float64)
        order = np.argsort(cls, kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(s.short_classes + 1))
        flat, member = states[order], target[order] % s.per_class
        for k in range(s.short_classes):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                lp[order[a:b]] += _target_log_p(flat[a:b] @ p["O"][k] + p["o"][k], member[a:b])
        return lp

    def score(self, docs: list[np.ndarray], lanes: int = 512, steps: int = 64) -> np.ndarray:
        """Natural log P of whole documents (arrays of numbers, not empty)."""
        total = np.zeros(len(docs))
        if not docs:
            return total
        lane = Streams(docs, lanes)
        h = np.zeros((len(lane.length), self.shape.hidden), dtype=np.float32)
        for before, word, doc in lane.windows(steps):
            out, h, _ = self._steps(before, h[: word.shape[1]], False)
            ok = word >= 0
            every = bool(ok.all())
            doc, out, word = (_flat(x, ok, every) for x in (doc, out, word))
            total += np.bincount(doc, weights=self.score_p(out, word), minlength=len(docs))
        return total

    def train(self, docs: list[np.ndarray], lanes: int = 512, steps: int = 16, rate: float = 0.1,
              memory: dict[str, np.ndarray] | None = None) -> int:
        """One pass of truncated back-propagation with Adagrad; words learned from.
        Few words run in fewer lanes, so that they give updates enough."""
        if not docs:
            return 0
        lanes = min(lanes, max(8, sum(map(len, docs)) // 1000))
        memory = memory if memory is not None else {}
        lane, learned = Streams(docs, lanes), 0
        h = np.zeros((len(lane.length), self.shape.hidden), dtype=np.float32)
        for before, word, _ in lane.windows(steps):
            states, h_end, saved = self._steps(before, h[: word.shape[1]], True)
            grads = self._back(before, word, states, saved)
            h = h_end
            known = int((word >= 0).sum())
            learned += known
            weight = np.float32(np.sqrt(known / (steps * len(lane.length))))
            for k, g in grads.items():
                g = np.clip(g * weight, -1, 1)
                m = memory.setdefault(k, np.full(g.shape, 1e-2, dtype=np.float32))
                m += g * g
                self.p[k] -= (rate * g / np.sqrt(m)).astype(np.float32)
        return learned

    def _back(self, before, word, states, saved) -> dict[str, np.ndarray]:
        s, p, n = self.shape, self.p, self.shape.hidden
        ok = word >= 0
        every = bool(ok.all())
        flat, target = _flat(states, ok, every), _flat(word, ok, every)
        cls = np.where(target < s.short, target // s.per_class, target - s.short + s.short_classes)
        scale = np.float32(1.0 / np.sqrt(max(1, len(flat))))
        dc = _softmax(flat @ p["C"] + p["c"])
        dc[np.arange(len(cls)), cls] -= 1
        dc *= scale
        g = {"C": flat.T @ dc, "c": dc.sum(axis=0), "O": np.zeros_like(p["O"]), "o": np.zeros_like(p["o"])}
        df = dc @ p["C"].T
        # rows of one class lie together
        order = np.argsort(cls, kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(s.short_classes + 1))
        of_class, member = flat[order], target[order] % s.per_class
        inner = np.zeros_like(of_class)
        for k in range(s.short_classes):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                dw = _softmax(of_class[a:b] @ p["O"][k] + p["o"][k])
                dw[np.arange(b - a), member[a:b]] -= 1
                dw *= scale
                g["O"][k], g["o"][k] = of_class[a:b].T @ dw, dw.sum(axis=0)
                inner[a:b] = dw @ p["O"][k].T
        df[order] += inner
        if every:
            dstates = df.reshape(states.shape)
        else:
            dstates = np.zeros_like(states)
            dstates[ok] = df
        dx = np.zeros((*before.shape, 3 * n), dtype=np.float32)
        dh = np.zeros_like(states[0])
        ut, vt = np.ascontiguousarray(p["U"].T), np.ascontiguousarray(p["V"].T)
        for t in range(len(before) - 1, -1, -1):
            h, z, r, rh, cand = saved[t]
            d = dstates[t] + dh
            dz = d * z
            dcand = (d - dz) * (1 - cand * cand)
            drh = dcand @ vt
            dr = drh * r
            dg = np.concatenate([(dz - dz * z) * (h - cand), (dr - dr * r) * h], axis=1)
            dx[t, :, : 2 * n], dx[t, :, 2 * n :] = dg, dcand
            dh = dz + dr + dg @ ut
            dh[before[t] < 0] = 0
        # the recurrent weights from all steps at once
        held, mixed = (np.concatenate([x[i] for x in saved]) for i in (0, 3))
        flat_dx = dx.reshape(-1, 3 * n)
        g["U"], g["V"] = held.T @ flat_dx[:, : 2 * n], mixed.T @ flat_dx[:, 2 * n :]
        at = np.maximum(before, 0).ravel()
        order = np.argsort(at, kind="stable")
        firsts = np.flatnonzero(np.diff(at[order], prepend=-1))
        by_word = np.zeros((len(p["E"]), 3 * n), dtype=np.float32)
        by_word[at[order][firsts]] = np.add.reduceat(flat_dx[order], firsts, axis=0)
        g["b"] = by_word.sum(axis=0)
        g["W"], g["E"] = p["E"].T @ by_word, by_word @ p["W"].T
        return g
