"""A bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the sum of a learned vector for the word and of learned
vectors for its characters in runs of four bytes (both by hashed index), so
unseen words are read by their characters. Windows of ``WINDOW`` words, one
every ``STRIDE``, go through a recurrent layer in each direction; attention
weighs the states, and a logistic unit scores their mean. A text's score is
that of its highest window, calibrated on whole training texts.

Training is by multiple instances: in each epoch a toxic text teaches by its
highest window, a clean one by its highest and by random ones.
"""

from __future__ import annotations

import numpy as np

from .words import Batch, mix64, pieces

WINDOW, STRIDE = 32, 16
DIM, HIDDEN, LOOK = 16, 8, 8
BUCKETS = 1 << 14
GRAM = 4
_SLICE = 1 << 15
STEPS = 180
_U = np.uint64


def _separators() -> np.ndarray:
    sep = np.ones(256, bool)
    for lo, hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
        sep[lo:hi] = False
    return sep


_SEPARATORS = _separators()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Features:
    """The distinct words of some texts: rows of the embedding table of each, and the tokens."""

    def __init__(self, texts: list[str | None]):
        batch = Batch(texts, _SEPARATORS)
        data = np.frombuffer(b"\n".join((t or "").encode("utf-8", "surrogatepass") for t in texts), np.uint8)
        self.hashes, first, self.tokens = np.unique(batch.words, return_index=True, return_inverse=True)
        self.at = batch.at
        begin, size = batch.begin[first], (batch.end - batch.begin)[first]
        # Each word between a mark at both ends, so that its edges count.
        long = size + 2
        start = np.concatenate(([0], np.cumsum(long)))
        marked = np.full(start[-1] + GRAM, 1, np.uint8)
        inner = np.arange(start[-1]) - np.repeat(start[:-1], long)
        is_inner = (inner > 0) & (inner <= np.repeat(size, long))
        marked[: start[-1]][is_inner] = _FOLD[data[(np.repeat(begin, long) + inner - 1)[is_inner]]]
        grams = np.maximum(long - GRAM + 1, 1)
        self.bounds = np.concatenate(([0], np.cumsum(grams + 1))).astype(np.int64)
        self.index = np.empty(self.bounds[-1], np.int32)
        for a in range(0, len(size), _SLICE):  # the row of the word, then those of its runs of characters
            z = min(a + _SLICE, len(size))
            many = grams[a:z] + 1
            at = np.concatenate(([0], np.cumsum(many)))
            nth = np.arange(at[-1]) - np.repeat(at[:-1], many)
            where = np.repeat(start[a:z], many) + nth - 1
            code = np.zeros(at[-1], _U)
            for k in range(GRAM):
                code = (code << _U(8)) | marked[where + k].astype(_U)
            index = (mix64(code + _U(77)) % _U(BUCKETS)).astype(np.int32)
            index[at[:-1]] = BUCKETS + (self.hashes[a:z] % _U(BUCKETS)).astype(np.int32)
            self.index[self.bounds[a] : self.bounds[z]] = index
        self.weight = (1 / np.sqrt(grams + 1)).astype(np.float32)

    def embed(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.hashes), table.shape[1]), np.float32)
        for a in range(0, len(out), _SLICE):
            z = min(a + _SLICE, len(out))
            lo, hi = self.bounds[a], self.bounds[z]
            out[a:z] = np.add.reduceat(table[self.index[lo:hi]], self.bounds[a:z] - lo, axis=0) * self.weight[a:z, None]
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First token and number of tokens of each window, and the windows' bounds by text."""
        n = np.diff(self.at)
        count = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, 1)
        bounds = np.concatenate(([0], np.cumsum(count)))
        step = (np.arange(bounds[-1]) - np.repeat(bounds[:-1], count)) * STRIDE
        return np.repeat(self.at[:-1], count) + step, np.minimum(WINDOW, np.repeat(n, count) - step), bounds


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        normal = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {"table": normal(2 * BUCKETS, DIM, scale=0.05), "wa": normal(2 * HIDDEN, LOOK, scale=0.3), "ba": np.zeros(LOOK, np.float32), "va": normal(LOOK, scale=0.3), "w": normal(2 * HIDDEN, scale=0.3), "b": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": normal(DIM, 3 * HIDDEN, scale=0.3), f"k{d}": np.zeros(3 * HIDDEN, np.float32), f"u{d}": normal(HIDDEN, 3 * HIDDEN, scale=0.3)}
        self.scale, self.shift = 1.0, 0.0

    def _run(self, d: str, inputs: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """inputs: (T, N, 3 HIDDEN) projections in time order of this direction."""
        u, h2 = self.p[f"u{d}"], 2 * HIDDEN
        h = np.zeros((inputs.shape[1], HIDDEN), np.float32)
        out = np.empty((len(inputs), *h.shape), np.float32)
        for t, x in enumerate(inputs):
            gates = _sigmoid(x[:, :h2] + h @ u[:, :h2])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(x[:, h2:] + (r * h) @ u[:, h2:])
            if keep is not None:
                keep.append((h, z, r, c))
            h = h + mask[t][:, None] * z * (c - h)
            out[t] = h
        return out

    def _attend(self, states: np.ndarray, mask: np.ndarray):
        look = np.tanh(states @ self.p["wa"] + self.p["ba"])
        score = np.where(mask > 0, look @ self.p["va"], -1e9)
        share = np.exp(score - score.max(axis=0)) * mask
        share /= np.maximum(share.sum(axis=0), 1e-9)
        pooled = (share[:, :, None] * states).sum(axis=0)
        return look, share, pooled

    def logits(self, feats: Features, some: np.ndarray | None = None, chunk: int = 2048) -> np.ndarray:
        """One logit for each window (or for ``some`` of them)."""
        vectors = feats.embed(self.p["table"])
        project = {d: np.vstack([vectors @ self.p[f"x{d}"] + self.p[f"k{d}"], np.zeros((1, 3 * HIDDEN), np.float32)]) for d in "fb"}
        first, size, _ = feats.windows()
        if some is not None:
            first, size = first[some], size[some]
        out = np.empty(len(first), np.float32)
        for a in range(0, len(first), chunk):
            ids, mask = self._ids(feats, first[a : a + chunk], size[a : a + chunk], len(vectors))
            ahead = self._run("f", project["f"][ids], mask, None)
            back = self._run("b", project["b"][ids[::-1]], mask[::-1], None)[::-1]
            pooled = self._attend(np.concatenate((ahead, back), axis=2), mask)[2]
            out[a : a + chunk] = pooled @ self.p["w"] + self.p["b"][0]
        return out

    @staticmethod
    def _ids(feats: Features, first: np.ndarray, size: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
        long = max(1, int(size.max(initial=1)))
        step = np.arange(long)[:, None]
        inside = step < size
        tokens = np.append(feats.tokens, pad)
        return np.where(inside, tokens[np.where(inside, first + step, len(tokens) - 1)], pad), inside.astype(np.float32)

    def gradients(self, feats: Features, some: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        first, size, _ = feats.windows()
        ids, mask = self._ids(feats, first[some], size[some], len(feats.hashes))
        used, flat = np.unique(ids, return_inverse=True)
        real = used[used < len(feats.hashes)]
        rows = np.concatenate([np.arange(feats.bounds[k], feats.bounds[k + 1]) for k in real]) if len(real) else np.zeros(0, np.int64)
        spans = feats.bounds[real + 1] - feats.bounds[real]
        index, scale = feats.index[rows], feats.weight[real]
        vectors = np.zeros((len(used), DIM), np.float32)
        if len(real):
            vectors[: len(real)] = np.add.reduceat(p["table"][index], np.concatenate(([0], np.cumsum(spans)[:-1])), axis=0) * scale[:, None]
        x = vectors[flat.reshape(ids.shape)]
        kept: dict[str, list] = {"f": [], "b": []}
        ahead = self._run("f", x @ p["xf"] + p["kf"], mask, kept["f"])
        back = self._run("b", x[::-1] @ p["xb"] + p["kb"], mask[::-1], kept["b"])[::-1]
        states = np.concatenate((ahead, back), axis=2)
        look, share, pooled = self._attend(states, mask)
        logit = pooled @ p["w"] + p["b"][0]
        d_logit = (weight * (_sigmoid(logit) - y) / weight.sum()).astype(np.float32)
        g = {"w": pooled.T @ d_logit, "b": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["w"]
        d_states = share[:, :, None] * d_pooled
        d_share = (states * d_pooled).sum(axis=2)
        d_score = share * (d_share - (share * d_share).sum(axis=0))
        g["va"] = np.einsum("tn,tnl->l", d_score, look)
        d_look = d_score[:, :, None] * p["va"] * (1 - look * look)
        g["wa"], g["ba"] = np.einsum("tnh,tnl->hl", states, d_look), d_look.sum(axis=(0, 1))
        d_states = d_states + d_look @ p["wa"].T
        d_x = np.zeros_like(x)
        for d, part in (("f", d_states[:, :, :HIDDEN]), ("b", d_states[::-1, :, HIDDEN:])):
            order = x if d == "f" else x[::-1]
            d_in = self._back(d, part, mask if d == "f" else mask[::-1], kept[d], g)
            g[f"x{d}"], g[f"k{d}"] = np.einsum("tnd,tnk->dk", order, d_in), d_in.sum(axis=(0, 1))
            back_x = d_in @ p[f"x{d}"].T
            d_x += back_x if d == "f" else back_x[::-1]
        d_vectors = np.zeros((len(used), DIM), np.float32)
        np.add.at(d_vectors, flat.reshape(-1), d_x.reshape(-1, DIM))
        g["table"] = np.zeros_like(p["table"])
        if len(real):
            np.add.at(g["table"], index, np.repeat(d_vectors[: len(real)] * scale[:, None], spans, axis=0))
        return g

    def _back(self, d: str, d_out: np.ndarray, mask: np.ndarray, kept: list, g: dict) -> np.ndarray:
        u, h2 = self.p[f"u{d}"], 2 * HIDDEN
        d_in = np.empty((*d_out.shape[:2], 3 * HIDDEN), np.float32)
        d_u, carry = np.zeros_like(u), np.zeros_like(d_out[0])
        for t in range(len(kept) - 1, -1, -1):
            h, z, r, c = kept[t]
            dh = d_out[t] + carry
            step = dh * mask[t][:, None]
            d_c = step * z * (1 - c * c)
            d_rh = d_c @ u[:, h2:].T
            d_gates = np.concatenate((step * (c - h) * z * (1 - z), d_rh * h * r * (1 - r)), axis=1)
            carry = dh - step * z + d_rh * r + d_gates @ u[:, :h2].T
            d_u[:, :h2] += h.T @ d_gates
            d_u[:, h2:] += (r * h).T @ d_c
            d_in[t, :, :h2], d_in[t, :, h2:] = d_gates, d_c
        g[f"u{d}"] = d_u
        return d_in

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """One score from 0 to 1 for each text: its highest window's, calibrated."""
        out = np.empty(len(texts))
        done = 0
        for _, some in pieces((None, t) for t in texts):
            feats = Features(some)
            bounds = feats.windows()[2]
            out[done : done + len(some)] = np.maximum.reduceat(self.logits(feats), bounds[:-1])
            done += len(some)
        return _sigmoid(self.scale * out + self.shift).astype(np.float64)


def train(texts: list[str | None], labels: np.ndarray, epochs: int = 12, batch: int = 192, rate: float = 0.01, share: float = 0.1, seed: int = 1) -> Model:
    """Fit a model; ``share`` is the expected rate of toxic texts, for calibration."""
    rng = np.random.default_rng(seed)
    model, y = Model(seed), np.asarray(labels, np.float32)
    if not (0 < y.sum() < len(y)):
        model.scale, model.shift = 0.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        return model
    feats = Features(texts)
    bounds = feats.windows()[2]
    _prime(model, feats, y)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    step, prior = 0, _first_guess(model, feats)
    epochs = max(epochs, min(5 * epochs, STEPS // (1 + 2 * len(y) // batch)))  # few texts: go over them more often
    for epoch in range(epochs):
        logit = prior if epoch < 2 else model.logits(feats)
        top = np.array([a + int(np.argmax(logit[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        clean = np.flatnonzero(y == 0)
        extra = rng.integers(bounds[clean], bounds[clean + 1])
        some = np.concatenate((top, extra))
        target = np.concatenate((y, np.zeros(len(extra), np.float32)))
        weight = np.where(target > 0, (target == 0).sum() / max(1, (target > 0).sum()), 1).astype(np.float32)
        order = rng.permutation(len(some))
        for a in range(0, len(order), batch):
            k = order[a : a + batch]
            g = model.gradients(feats, some[k], target[k], weight[k])
            step += 1
            pace = rate * min(1, step / 20) * (1 - 0.9 * epoch / epochs)
            for name, v in model.p.items():
                m[name] += 0.1 * (g[name] - m[name])
                s[name] += 0.01 * (g[name] ** 2 - s[name])
                v -= pace * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.99**step)) + 1e-6)
    _calibrate(model, np.maximum.reduceat(model.logits(feats), bounds[:-1]), y, share)
    return model


def _prime(model: Model, feats: Features, y: np.ndarray) -> None:
    """Begin the first coordinate of every vector at its smoothed log odds by text."""
    hit, miss = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    for k in range(len(y)):
        words = np.unique(feats.tokens[feats.at[k] : feats.at[k + 1]])
        spans = (feats.bounds[words + 1] - feats.bounds[words]).astype(np.int64)
        rows = np.repeat(feats.bounds[words] - np.concatenate(([0], np.cumsum(spans)))[:-1], spans) + np.arange(spans.sum())
        (hit if y[k] > 0 else miss)[np.unique(feats.index[rows])] += 1
    toxic = float(y.sum())
    clean = len(y) - toxic
    odds = np.log((hit + toxic / len(y)) / toxic) - np.log((miss + clean / len(y)) / clean)  # 0 where nothing is known
    model.p["table"][:, 0] = np.clip(odds, -3, 3).astype(np.float32)


def _first_guess(model: Model, feats: Features) -> np.ndarray:
    """Windows by their two likeliest words, before anything is learned."""
    value = np.append(np.maximum(0, feats.embed(model.p["table"][:, :1])[:, 0]), 0.0)
    first, size, _ = feats.windows()
    out = np.empty(len(first), np.float32)
    for a in range(0, len(first), 8192):
        ids, _ = Model._ids(feats, first[a : a + 8192], size[a : a + 8192], len(feats.hashes))
        out[a : a + 8192] = np.sort(value[ids], axis=0)[-2:].sum(axis=0)
    return out


def _calibrate(model: Model, top: np.ndarray, y: np.ndarray, share: float) -> None:
    """Logistic fit of whole texts' highest logits, weighed to the expected rate."""
    weight = np.where(y > 0, share / max(y.mean(), 1e-6), (1 - share) / max(1 - y.mean(), 1e-6))
    a, b = 1.0, 0.0
    x = np.stack([top, np.ones_like(top)])
    for _ in range(50):
        q = _sigmoid(a * top + b)
        grad = (x * (weight * (q - y))).sum(axis=1) + np.array([0.5 * (a - 1), 0.05 * b])
        h = (x[:, None] * x[None] * (weight * q * (1 - q))).sum(axis=2) + np.diag([0.5, 0.05])
        change = np.clip(np.linalg.solve(h, grad), -1, 1)
        a, b = a - change[0], b - change[1]
    model.scale, model.shift = float(max(a, 0.05)), float(b)
