"""A gated recurrent language model with class-factored output, in numpy.

Words of the network's vocabulary lie in classes of equal size; one more class
stands for all other words.  The probability of a word is that of its class
times that of the word within its class, both softmaxes of the hidden state;
within the class of other words it is their share of counts (see ``lm``).
Training is truncated backpropagation through time over windows of parallel
streams; scoring carries each document's state from its first word to its end.
"""

from __future__ import annotations

import numpy as np

#: Classes, words of a class, width of word vectors and of the hidden state.
CLASSES, SLOTS, EMBED, HIDDEN = 32, 64, 16, 24
#: Ids: the end of a text, then words by rank, then all others.
WORDS = CLASSES * SLOTS
END, OTHER = 0, WORDS
#: Steps of a training window, streams side by side in training and in scoring.
WINDOW, STREAMS, SIDE = 16, 256, 256
SHAPES = {
    "embed": (WORDS + 1, EMBED), "wx": (3 * HIDDEN, EMBED), "wh": (3 * HIDDEN, HIDDEN), "b": (3 * HIDDEN, 1),
    "wc": (CLASSES + 1, HIDDEN), "bc": (CLASSES + 1, 1), "ww": (CLASSES, SLOTS, HIDDEN), "bw": (CLASSES, SLOTS, 1),
}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of one flat array of all parameters."""
    out, k = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[k:k + n].reshape(shape)
        k += n
    return out


def initial(counts: np.ndarray, other: float) -> np.ndarray:
    """Parameters that give every word its share of ``counts`` (by id) and others theirs."""
    rng = np.random.RandomState(5)
    flat = np.zeros(SIZE, dtype=np.float32)
    p = unpack(flat)
    for name, scale in (("embed", 0.3), ("wx", 0.25), ("wh", 0.2), ("wc", 0.05), ("ww", 0.05)):
        p[name][...] = rng.randn(*SHAPES[name]) * scale
    # places of the vocabulary that no word has get next to nothing
    c = np.where(counts > 0, counts + 1.0, 1e-4).reshape(CLASSES, SLOTS)
    p["bw"][..., 0] = np.log(c / c.sum(axis=1, keepdims=True))
    mass = np.append(c.sum(axis=1), other + 1.0)
    p["bc"][:, 0] = np.log(mass / mass.sum())
    return flat


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _states(p: dict, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool):
    """Hidden states (hidden x steps x streams) of a window; ``fresh`` steps start from zero.

    Arrays have the features first, so that every operation runs along the streams.
    """
    steps, n = inputs.shape
    x = np.ascontiguousarray(p["embed"][inputs.ravel()].T)
    gx = (p["wx"] @ x + p["b"]).reshape(3 * HIDDEN, steps, n)
    gx = np.ascontiguousarray(gx.transpose(1, 0, 2))
    hs = np.empty((HIDDEN, steps, n), dtype=np.float32)
    kept = []
    anew = fresh.any(axis=1)
    for t in range(steps):
        if anew[t]:
            h = h * ~fresh[t]
        a = p["wh"] @ h
        a[:2 * HIDDEN] += gx[t, :2 * HIDDEN]
        zr = _sigmoid(a[:2 * HIDDEN])
        z, r, hn = zr[:HIDDEN], zr[HIDDEN:], a[2 * HIDDEN:]
        c = r * hn
        c += gx[t, 2 * HIDDEN:]
        np.tanh(c, out=c)
        if keep:
            kept.append((h, z, r, hn, c))
        h = h - c
        h *= z
        h += c
        hs[:, t] = h
    return hs, h, kept, x


def _exp_logits(w: np.ndarray, b: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of logits and their sums; logits are bounded as states lie in (-1, 1)."""
    e = w @ f
    e += b
    np.minimum(e, 80, out=e)
    np.exp(e, out=e)
    return e, e.sum(axis=0)


def log_probabilities(p: dict, f: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log of each target's class, and word where it is in the vocabulary, from columns of states."""
    cls = targets // SLOTS
    order = np.argsort(cls, kind="stable")
    f, y, cls = np.ascontiguousarray(f[:, order]), targets[order], cls[order]
    e, total = _exp_logits(p["wc"], p["bc"], f)
    prob = (e[cls, np.arange(len(y))] / total).astype(np.float64)
    ends = np.searchsorted(cls, np.arange(CLASSES + 1))
    for c in range(CLASSES):
        a, z = ends[c], ends[c + 1]
        if z > a:
            e, total = _exp_logits(p["ww"][c], p["bw"][c], f[:, a:z])
            prob[a:z] *= e[y[a:z] % SLOTS, np.arange(z - a)] / total
    out = np.empty(len(y))
    out[order] = np.log(np.maximum(prob, 1e-300))
    return out


def _gradient(p: dict, g: dict, hs: np.ndarray, kept: list, x: np.ndarray, inputs: np.ndarray, targets: np.ndarray,
              fresh: np.ndarray, live: np.ndarray) -> None:
    """Add the gradient of a window's negative log likelihood to ``g``; ``live`` marks real steps."""
    steps, n = inputs.shape
    y, on = targets.ravel(), live.ravel()
    cls = np.where(on, y // SLOTS, CLASSES + 1)
    order = np.argsort(cls, kind="stable")
    n_on = int(on.sum())
    order_on = order[:n_on]
    f, y, cls = np.ascontiguousarray(hs.reshape(HIDDEN, -1)[:, order_on]), y[order_on], cls[order_on]
    e, total = _exp_logits(p["wc"], p["bc"], f)
    e /= total
    e[cls, np.arange(n_on)] -= 1
    g["wc"] += e @ f.T
    g["bc"] += e.sum(axis=1, keepdims=True)
    df = p["wc"].T @ e
    ends = np.searchsorted(cls, np.arange(CLASSES + 1))
    for c in range(CLASSES):
        a, z = ends[c], ends[c + 1]
        if z > a:
            e, total = _exp_logits(p["ww"][c], p["bw"][c], f[:, a:z])
            e /= total
            e[y[a:z] % SLOTS, np.arange(z - a)] -= 1
            g["ww"][c] += e @ f[:, a:z].T
            g["bw"][c] += e.sum(axis=1, keepdims=True)
            df[:, a:z] += p["ww"][c].T @ e
    dh = np.zeros((HIDDEN, steps * n), dtype=np.float32)
    dh[:, order_on] = df
    dh = np.ascontiguousarray(dh.reshape(HIDDEN, steps, n).transpose(1, 0, 2))
    dgx = np.empty((steps, 3 * HIDDEN, n), dtype=np.float32)
    da = np.empty((3 * HIDDEN, n), dtype=np.float32)
    back = np.zeros((HIDDEN, n), dtype=np.float32)
    anew = fresh.any(axis=1)
    for t in reversed(range(steps)):
        h, z, r, hn, c = kept[t]
        back += dh[t]
        dc = back * (1 - z)
        dc *= 1 - c * c
        d = dgx[t]
        d[:HIDDEN] = back * (h - c) * (z - z * z)
        d[HIDDEN:2 * HIDDEN] = dc * hn * (r - r * r)
        d[2 * HIDDEN:] = dc
        da[:2 * HIDDEN] = d[:2 * HIDDEN]
        np.multiply(dc, r, out=da[2 * HIDDEN:])
        g["wh"] += da @ h.T
        back *= z
        back += p["wh"].T @ da
        if anew[t]:
            back *= ~fresh[t]
    rows = np.ascontiguousarray(dgx.transpose(1, 0, 2)).reshape(3 * HIDDEN, -1)
    g["b"] += rows.sum(axis=1, keepdims=True)
    g["wx"] += rows @ x.T
    dx = np.ascontiguousarray((p["wx"].T @ rows).T)
    ids = inputs.ravel()
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.append(True, ids[order][1:] != ids[order][:-1]))
    g["embed"][ids[order][first]] += np.add.reduceat(dx[order], first, axis=0)


class Trainer:
    """Truncated backpropagation with Adam over ids of whole documents, given piece by piece."""

    def __init__(self, flat: np.ndarray, rate: float):
        self.flat, self.rate = flat.copy(), rate
        self.m, self.v, self.t = np.zeros_like(flat), np.zeros_like(flat), 0
        self.grad = np.zeros_like(flat)

    def run(self, targets: np.ndarray, starts: np.ndarray, streams: int = STREAMS, window: int = WINDOW) -> None:
        """``targets``: documents with their ends, one after another; ``starts`` marks first tokens.

        The tokens are cut into parallel streams of equal length; a document
        cut by that starts its second part from the zero state.
        """
        inputs = np.append(END, targets[:-1])
        inputs[starts] = END
        streams = max(1, min(streams, len(targets) // (2 * window)))
        steps = -(-len(targets) // streams)
        pad = steps * streams - len(targets)
        cut = lambda x, fill: np.append(x, np.full(pad, fill, x.dtype)).reshape(streams, steps).T
        x, y, fresh = cut(inputs, END), cut(targets, END), cut(starts, True)
        live = cut(np.ones(len(targets), dtype=bool), False)
        h = np.zeros((HIDDEN, streams), dtype=np.float32)
        p, g = unpack(self.flat), unpack(self.grad)
        for k in range(0, steps, window):
            at = slice(k, k + window)
            hs, h, kept, vec = _states(p, x[at], fresh[at], h, True)
            self.grad[:] = 0
            _gradient(p, g, hs, kept, vec, x[at], y[at], fresh[at], live[at])
            self._step(max(1, int(live[at].sum())))

    def _step(self, n: int) -> None:
        g = self.grad
        g /= n
        norm = float(np.sqrt(g @ g))
        if norm > 1:
            g /= norm
        self.t += 1
        self.m += 0.1 * (g - self.m)
        g *= g
        self.v += 0.01 * (g - self.v)
        a = self.rate / (1 - 0.9**self.t)
        d = np.sqrt(self.v / (1 - 0.99**self.t))
        d += 1e-6
        self.flat -= a * self.m / d


def score(flat: np.ndarray, docs: list[np.ndarray], streams: int = SIDE, window: int = 32) -> np.ndarray:
    """Natural log likelihood of each document (ids with its end), from the zero state to its end.

    Documents are dealt to parallel streams, longest first, each to the
    shortest stream so far, and stand there one after another.
    """
    import heapq

    out = np.zeros(len(docs))
    if not docs:
        return out
    p = unpack(flat)
    sizes = np.array([len(d) for d in docs])
    n = min(streams, len(docs))
    heap = [(0, s) for s in range(n)]
    lists: list[list[int]] = [[] for _ in range(n)]
    for k in np.argsort(-sizes, kind="stable"):
        size, s = heapq.heappop(heap)
        lists[s].append(int(k))
        heapq.heappush(heap, (size + int(sizes[k]), s))
    lists.sort(key=lambda x: -int(sizes[x].sum()))
    length = np.array([int(sizes[x].sum()) for x in lists])
    steps = int(length[0])
    # streams stay as they are and are laid side by side a window at a time: memory follows the tokens, not the longest
    flows = [np.concatenate([docs[k] for k in some]) for some in lists]
    flow_doc = [np.repeat(np.array(some, dtype=np.int32), sizes[some]) for some in lists]
    flow_new = []
    for s, some in enumerate(lists):
        new = np.zeros(length[s], dtype=bool)
        new[np.append(0, np.cumsum(sizes[some])[:-1])] = True
        flow_new.append(new)
    h, last = np.zeros((HIDDEN, n), dtype=np.float32), np.zeros((1, n), dtype=np.int16)
    for k in range(0, steps, window):
        on = int(np.searchsorted(-length, -k, side="left"))  # streams that have not ended
        w = min(window, steps - k)
        y, doc, fresh = np.zeros((w, on), np.int16), np.zeros((w, on), np.int32), np.zeros((w, on), bool)
        for s in range(on):
            m = min(w, int(length[s]) - k)
            y[:m, s], doc[:m, s], fresh[:m, s] = flows[s][k:k + m], flow_doc[s][k:k + m], flow_new[s][k:k + m]
        x = np.vstack([last[:, :on], y[:-1]])
        x[fresh] = END
        last = y[-1:]
        hs, h, _, _ = _states(p, x, fresh, np.ascontiguousarray(h[:, :on]), False)
        live = (np.arange(k, k + w)[:, None] < length[None, :on]).ravel()
        lp = log_probabilities(p, hs.reshape(HIDDEN, -1)[:, live], y.ravel()[live].astype(np.int64))
        out += np.bincount(doc.ravel()[live], weights=lp, minlength=len(docs))
    return out
