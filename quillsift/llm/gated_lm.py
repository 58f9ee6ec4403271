"""A gated recurrent language model over words in numpy, with a class-factored output softmax.

The LM's own words are the most frequent ones; words of neighbouring rank share a class. A word's
probability is that of its class given the state, times its own within the class. All other words are one
more class, within which a word has its smoothed share of the counts: over all words the model is a
proper distribution. Before training, the biases alone make it equal to the smoothed unigram model.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import islice

import numpy as np

WIDTH = 16
CLASSES, PER_CLASS = 48, 64
OWN_WORDS = CLASSES * PER_CLASS
#: The class, and the input, of all words that are not the LM's own.
OTHER = OWN_WORDS
#: Words that a state is carried over in training, at most; in scoring it is carried over whole texts.
SECTION = 4096
NAMES = ("x", "u", "class_w", "class_b", "word_w", "word_b")


@dataclass
class GatedLM:
    """x: input tables of the gates (words x 3 widths); u: recurrent weights; class_*, word_*: output layers."""

    x: np.ndarray
    u: np.ndarray
    class_w: np.ndarray
    class_b: np.ndarray
    word_w: np.ndarray
    word_b: np.ndarray

    @classmethod
    def unigram(cls, counts: np.ndarray, other_mass: float, seed: int = 11) -> GatedLM:
        """``counts``: smoothed counts of the own words, most frequent first; ``other_mass``: of all others."""
        random = np.random.default_rng(seed)
        own = np.zeros(OWN_WORDS)
        own[: len(counts)] = counts
        mass = np.maximum(own.reshape(CLASSES, PER_CLASS).sum(1), 1e-30)
        with np.errstate(divide="ignore"):
            word_b = np.maximum(np.log(own.reshape(CLASSES, PER_CLASS)), -1e9)
        f = np.float32
        return cls(
            (random.standard_normal((OWN_WORDS + 1, 3 * WIDTH)) * 0.1).astype(f),
            (random.standard_normal((WIDTH, 3 * WIDTH)) / WIDTH**0.5).astype(f),
            np.zeros((WIDTH, CLASSES + 1), f),
            np.log(np.r_[mass, max(other_mass, 1e-30)]).astype(f),
            np.zeros((CLASSES, WIDTH, PER_CLASS), f),
            word_b.astype(f),
        )

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in NAMES]

    def to_bytes(self) -> bytes:
        return b"".join(a.astype("<f4").tobytes() for a in self.arrays())

    @classmethod
    def from_bytes(cls, blob: bytes) -> GatedLM:
        shapes = ((OWN_WORDS + 1, 3 * WIDTH), (WIDTH, 3 * WIDTH), (WIDTH, CLASSES + 1), (CLASSES + 1,), (CLASSES, WIDTH, PER_CLASS), (CLASSES, PER_CLASS))
        out, at = [], 0
        for shape in shapes:
            n = int(np.prod(shape))
            out.append(np.frombuffer(blob, "<f4", n, at).reshape(shape).astype(np.float32))
            at += 4 * n
        return cls(*out)

    def states(self, ids: np.ndarray, h: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``ids``: steps x texts. The state before each word, and the one after the last.

        Inside, texts are the last axis, so that the gates are contiguous.
        """
        steps, texts = ids.shape
        w = WIDTH
        gates = np.ascontiguousarray(self.x[ids].transpose(0, 2, 1))
        u = np.ascontiguousarray(self.u.T)
        # The first two gates are 1 / (1 + exp(-a)): what goes into them is negated before the walk.
        np.negative(gates[:, : 2 * w], out=gates[:, : 2 * w])
        np.negative(u[: 2 * w], out=u[: 2 * w])
        every = np.empty((steps + 1, w, texts), np.float32)
        every[0] = h.T
        recurrent = np.empty((steps if keep is not None else 1, w, texts), np.float32)
        hu, by = np.empty((3 * w, texts), np.float32), np.empty((w, texts), np.float32)
        for t in range(steps):
            h, after, zr, n = every[t], every[t + 1], gates[t, : 2 * w], gates[t, 2 * w :]
            np.matmul(u, h, out=hu)
            zr += hu[: 2 * w]
            np.exp(zr, out=zr)
            zr += 1.0
            np.reciprocal(zr, out=zr)
            if keep is not None:
                recurrent[t] = hu[2 * w :]
            n += np.multiply(zr[w:], hu[2 * w :], out=by)
            np.tanh(n, out=n)
            np.subtract(h, n, out=after)
            after *= zr[:w]
            after += n
        before = every[:-1]
        if keep is not None:
            keep["memory"] = before, gates, recurrent
        return np.ascontiguousarray(before.transpose(0, 2, 1)), np.ascontiguousarray(every[-1].T)

    def log_probabilities(self, h: np.ndarray, ids: np.ndarray, gradients: dict | None = None) -> np.ndarray:
        """Natural log of the probability of each word (of the class, for OTHER) after each state."""
        own_class = np.minimum(ids // PER_CLASS, CLASSES)
        order = np.argsort(own_class.astype(np.uint8), kind="stable")
        own_class, places = own_class[order], ids[order] % PER_CLASS
        cuts = np.searchsorted(own_class, np.arange(CLASSES + 1))
        rows, counted = h[order], np.arange(len(ids))
        # Classes are the first axis and words the last: sums over classes run over contiguous words.
        logits = self.class_w.T @ rows.T
        logits += self.class_b[:, None]
        if not _tame(self.class_w, self.class_b):
            logits -= logits.max(0)
        log_p = logits[own_class, counted]
        np.exp(logits, out=logits)
        total = logits.sum(0)
        log_p -= np.log(total)
        if gradients is not None:
            logits /= total
            logits[own_class, counted] -= 1.0
            gradients["class_w"], gradients["class_b"] = rows.T @ logits.T, logits.sum(1)
            dh = logits.T @ self.class_w.T
            gw, gb = np.zeros_like(self.word_w), np.zeros_like(self.word_b)
        tame = _tame(self.word_w, self.word_b)
        for classes in _of_like_size(np.diff(cuts)):
            # Classes x words x places; a class with fewer words repeats its last one, which counts for nothing.
            sizes = cuts[classes + 1] - cuts[classes]
            turn = np.arange(sizes[0])
            at = cuts[classes][:, None] + np.minimum(turn, sizes[:, None] - 1)
            real = turn < sizes[:, None]
            w, b = self.word_w[classes], self.word_b[classes]
            states = rows[at]
            inner = states @ w
            inner += b[:, None, :]
            if not (tame or _tame(w, b)):
                inner -= inner.max(2, keepdims=True)
            flat = inner.reshape(-1, PER_CLASS)
            picked = np.arange(at.size) * PER_CLASS + places[at].ravel()
            chosen = flat.ravel()[picked]
            np.exp(flat, out=flat)
            total = flat @ np.ones(PER_CLASS, flat.dtype)
            log_p[at[real]] += (chosen - np.log(total))[real.ravel()]
            if gradients is not None:
                flat /= total[:, None]
                flat.ravel()[picked] -= 1.0
                if sizes[-1] < sizes[0]:
                    flat[~real.ravel()] = 0.0
                gw[classes], gb[classes] = states.transpose(0, 2, 1) @ inner, inner.sum(1)
                dh[at[real]] += (inner @ w.transpose(0, 2, 1))[real]
        out = np.empty_like(log_p)
        out[order] = log_p
        if gradients is not None:
            gradients["h"] = np.empty_like(h)
            gradients["h"][order] = dh
            gradients["word_w"], gradients["word_b"] = gw, gb
        return out


def _tame(w: np.ndarray, b: np.ndarray) -> bool:
    """Whether exp of all sums w'h + b is safe as it is: no state goes beyond -1 and 1, so |w| bounds their size."""
    reach = np.abs(w).sum(-2)
    return bool((b + reach).max() < 80 and (b - reach).max(-1).min() > -80)


def _of_like_size(sizes: np.ndarray) -> list[np.ndarray]:
    """Places of the sizes above 0 in groups, largest first; within a group none is under half of the first."""
    order = np.argsort(-sizes, kind="stable")
    out, begin = [], 0
    for k in range(len(order) + 1):
        if k == len(order) or not sizes[order[k]] or 2 * sizes[order[k]] < sizes[order[begin]]:
            if k > begin:
                out.append(order[begin:k])
            begin = k
            if k == len(order) or not sizes[order[k]]:
                break
    return out


@dataclass
class Trainer:
    """Truncated backpropagation through windows of ``steps`` words, with Adam."""

    model: GatedLM
    rate: float = 0.01
    steps: int = 32
    texts: int = 32
    done: int = 0
    #: How much of the window is words. The rate goes with it: the last texts, few side by side, would carry the model away.
    filled: float = 1.0
    moments: list = field(default_factory=list)

    def _apply(self, gradients: list[np.ndarray]) -> None:
        if not self.moments:
            self.moments = [(np.zeros_like(a), np.zeros_like(a), np.empty_like(a)) for a in self.model.arrays()]
        norm = float(np.sqrt(sum(float(np.vdot(g, g)) for g in gradients)))
        scale = np.float32(min(1.0, 1.0 / (norm + 1e-12)))
        self.done += 1
        fix = (1 - 0.99**self.done) ** 0.5 / (1 - 0.9**self.done)
        for a, g, (m, v, by) in zip(self.model.arrays(), gradients, self.moments, strict=True):
            m *= np.float32(0.9)
            m += np.multiply(g, np.float32(0.1) * scale, out=by)
            np.multiply(g, g, out=by)
            by *= np.float32(0.01) * scale * scale
            v *= np.float32(0.99)
            v += by
            np.sqrt(v, out=by)
            by += np.float32(1e-6)
            np.divide(m, by, out=by)
            by *= np.float32(self.rate * self.filled * fix)
            a -= by

    def window(self, ids: np.ndarray, valid: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One update over a window; the state that the next window starts from."""
        model, w = self.model, WIDTH
        keep: dict = {}
        before, after = model.states(ids, h, keep)
        at = np.flatnonzero(valid.ravel())
        g: dict = {}
        model.log_probabilities(before.reshape(-1, w)[at], ids.ravel()[at], g)
        scale = np.float32(1.0 / len(at))
        self.filled = len(at) / (self.steps * self.texts)
        dh_out = np.zeros((before.shape[0] * before.shape[1], w), np.float32)
        dh_out[at] = g["h"] * scale
        dh_out = dh_out.reshape(before.shape)
        before, gates, recurrent = keep["memory"]
        z, r, n = gates[:, :w], gates[:, w : 2 * w], gates[:, 2 * w :]
        # What a step multiplies the gradient of its state by, for all steps at once: towards the gates' sums,
        # of which the last one's input and recurrent part differ by r.
        open_ = 1 - z
        to_n = open_ * (1 - n * n)
        dhu = np.empty((len(ids), 3, w, ids.shape[1]), np.float32)
        np.multiply((before - n) * z, open_, out=dhu[:, 0])
        np.multiply(to_n, r, out=dhu[:, 2])
        np.multiply(dhu[:, 2] * (1 - r), recurrent, out=dhu[:, 1])
        dh_out = np.ascontiguousarray(dh_out.transpose(0, 2, 1))
        dh, by = np.zeros_like(before[0]), np.empty_like(before[0])
        for t in range(len(ids) - 1, -1, -1):
            dhu[t] *= dh
            to_n[t] *= dh
            dh *= z[t]
            dh += np.matmul(model.u, dhu[t].reshape(3 * w, -1), out=by)
            dh += dh_out[t]
        dhu = dhu.reshape(gates.shape)
        dx = np.concatenate([dhu[:, : 2 * w], to_n], 1)
        du = (before @ dhu.transpose(0, 2, 1)).sum(0)
        dx = dx.transpose(0, 2, 1).reshape(-1, 3 * w)
        flat = ids.ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        begin = np.flatnonzero(np.r_[True, np.diff(flat[order]) != 0])
        gx = np.zeros_like(model.x)
        gx[flat[order[begin]]] = np.add.reduceat(dx[order], begin, axis=0)
        self._apply([gx, du, g["class_w"] * scale, g["class_b"] * scale, g["word_w"] * scale, g["word_b"] * scale])
        return after

    def train(self, texts: Iterable[np.ndarray]) -> int:
        """One pass over texts (arrays of word ids); the number of words.

        ``self.texts`` of them run side by side; one that ends makes way for the next. The state is carried
        from window to window of a text; texts beyond SECTION words are learned from in sections, each
        of which starts from the empty state, so that no long text runs alone to its end.
        """
        sections = (t[at : at + SECTION] for t in texts for at in range(0, len(t), SECTION))
        lanes: list[np.ndarray] = []
        h, seen = np.zeros((0, WIDTH), np.float32), 0
        while True:
            new = list(islice(sections, self.texts - len(lanes)))
            if not lanes and not new:
                return seen
            lanes += new
            h = np.concatenate([h, np.zeros((len(new), WIDTH), np.float32)])
            ids, valid = padded([t[: self.steps] for t in lanes])
            h = self.window(ids, valid, h)
            seen += int(valid.sum())
            on = [i for i, t in enumerate(lanes) if len(t) > self.steps]
            lanes, h = [lanes[i][self.steps :] for i in on], h[on]


def padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Steps x texts of ids (padded by OTHER), and which are words of the text."""
    sizes = np.array([len(p) for p in parts])
    valid = np.arange(sizes.max())[:, None] < sizes
    ids = np.full(valid.shape[::-1], OTHER, np.int64)
    ids[valid.T] = np.concatenate(parts)
    return np.ascontiguousarray(ids.T), valid


def log10_probabilities(model: GatedLM, texts: list[np.ndarray], together: int = 256, words: int = 16_384) -> np.ndarray:
    """Log10 probability of each whole text (classes only for OTHER), the state carried across windows.

    The longest texts start; one that ends makes way for the next. A window has about ``words`` words, so
    that the last texts go in long windows.
    """
    out = np.zeros(len(texts))
    waiting = iter(sorted((i for i in range(len(texts)) if len(texts[i])), key=lambda i: -len(texts[i])))
    lanes, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros((0, WIDTH), np.float32)
    while True:
        new = list(islice(waiting, together - len(lanes)))
        if not len(lanes) and not new:
            return out / np.log(10.0)
        lanes, at = np.r_[lanes, new].astype(np.int64), np.r_[at, np.zeros(len(new), np.int64)]
        h = np.concatenate([h, np.zeros((len(new), WIDTH), np.float32)])
        steps = words // min(len(lanes), together)
        ids, valid = padded([texts[i][a : a + steps] for i, a in zip(lanes, at, strict=True)])
        before, h = model.states(ids, h)
        flat = np.flatnonzero(valid.ravel())
        before, at_words = before.reshape(-1, WIDTH)[flat], ids.ravel()[flat]
        # In parts whose tables stay in a processor's cache.
        p = np.concatenate([model.log_probabilities(before[k : k + 4096], at_words[k : k + 4096]) for k in range(0, len(flat), 4096)])
        out[lanes] += np.bincount(flat % len(lanes), weights=p.astype(np.float64), minlength=len(lanes))
        at += steps
        on = np.array([len(texts[i]) for i in lanes]) > at
        lanes, at, h = lanes[on], at[on], h[on]
