"""Toxicity of texts by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as a learned vector of its hash and the final states of a bidirectional recurrent network
over its characters.  A second bidirectional network runs over windows of 8 consecutive words, attention pools its
states, and a logistic unit scores the window.  Every window of a text is scored, one for each word that has 7 more
behind it; a logistic fit of the largest window logit and of the mean window probability gives the score of the
text, so that one chance hit in a long text weighs less than many.

The network is fitted on the driver on a bounded sample of labelled rows: at most ``sample_rows`` documents
of each class, the smallest by a hash of their id, and at most ``sample_passages`` evenly spaced passages of 32 words of each.  Every
fifth of them is kept from the fit and calibrates the text score over all its windows.  What a word contributes is
computed once for each distinct word of a worker and kept in a table of bounded size; words are told apart by a
64-bit hash there.

A word is a run of ASCII letters, digits and characters outside ASCII, A-Z as a-z; one of more than 48 bytes counts as
consecutive words of 48, so that nothing is cut off.  Null and empty texts have one window without words, and texts of
fewer than 8 words one shorter window.  Without labelled rows of both classes every score is the share of toxic
labels (0.5 without any label).  Of an id with several labels the toxic one counts, of a repeated document id one
text is learned from.  Repeated rows and null ids are scored like any other.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.textunits import bounded_batches, id_type, text_rows
from factorloom.llm.wordhash import Block, word_blocks
from factorloom.plans.shipping import ship_package
from factorloom.plans.staging import stage

WINDOW = 8
#: Windows of the first steps of a fit, and their share of all steps.
FIRST_WINDOW, FIRST_SHARE = 32, 0.4
WORD_ROWS, WORD_DIM = 1 << 16, 8
CHAR_ROWS, CHAR_DIM, CHAR_HIDDEN = 256, 6, 8
HIDDEN, ATTENTION = 8, 4
LONGEST_WORD = 48
TABLE_WORDS = 300_000
CHUNK_WORDS, CHUNK_WINDOWS = 1 << 16, 4096


def short_words(block: Block) -> Block:
    """The block with very long words in consecutive parts."""
    size = block.end - block.start
    if not len(size) or size.max() <= LONGEST_WORD:
        return block
    parts = -(-size // LONGEST_WORD)
    at = np.repeat(np.arange(len(size)), parts)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = block.start[at] + nth * LONGEST_WORD
    end = np.minimum(start + LONGEST_WORD, block.end[at])
    out = Block(block.first, block.rows, block.raw, block.row[at], start, end, block.hash[at].copy())
    for k in np.flatnonzero(parts[at] > 1).tolist():
        part = out.word(k)
        out.hash[k] = zlib.crc32(part) << 32 | zlib.adler32(part)
    return out


def decoded(block: Block, picked) -> list[str]:
    return [w.decode("utf-8", "replace") for w in block.words(picked)]


def char_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character rows (position, word) and mask; rarer characters share rows by their code."""
    longest = max(1, *map(len, words)) if words else 1
    codes, mask = np.zeros((longest, len(words)), np.int64), np.zeros((longest, len(words)), np.float32)
    for k, word in enumerate(words):
        codes[: len(word), k] = [ord(c) % CHAR_ROWS for c in word]
        mask[: len(word), k] = 1
    return codes, mask


def word_rows(words: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_ROWS for w in words], dtype=np.int64)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def both_ways(rows: np.ndarray) -> np.ndarray:
    """(direction, position, ...): the rows as they are and in reverse."""
    return np.stack([rows, rows[::-1]])


def gru(x, mask, w, u, b, keep: bool = True):
    """States (direction, position, row, hidden) of gated recurrent layers; masked positions carry the state on."""
    _, steps, rows, _ = x.shape
    hidden = u.shape[1]
    given = x @ w[:, None] + b[:, None, None]
    h = np.zeros((2, rows, hidden), np.float32)
    states, saved = np.empty((2, steps, rows, hidden), np.float32), []
    for t in range(steps):
        own = h @ u
        gates = _sigmoid(given[:, t, :, : 2 * hidden] + own[..., : 2 * hidden])
        z, r = gates[..., :hidden], gates[..., hidden:]
        new = np.tanh(given[:, t, :, 2 * hidden:] + r * own[..., 2 * hidden:])
        m = mask[:, t, :, None]
        if keep:
            saved.append((h, gates, new, own[..., 2 * hidden:], m))
        h = h + m * (1 - z) * (new - h)
        states[:, t] = h
    return states, saved


def gru_gradients(d_states, saved, x, w, u):
    """Gradients of x, w, u and b from those of the states."""
    steps, hidden = len(saved), u.shape[1]
    rows = x.shape[2]
    d_given, d_own = np.empty((2, steps, rows, 3 * hidden), np.float32), np.empty((2, rows, 3 * hidden), np.float32)
    d_u, d_h, u_t = np.zeros_like(u), np.zeros((2, rows, hidden), np.float32), u.transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        h, gates, new, own, m = saved[t]
        z, r = gates[..., :hidden], gates[..., hidden:]
        d = d_h + d_states[:, t]
        through = d * m
        d_new = through * (1 - z) * (1 - new * new)
        slope = gates * (1 - gates)
        d_own[..., :hidden] = through * (h - new) * slope[..., :hidden]
        d_own[..., hidden: 2 * hidden] = d_new * own * slope[..., hidden:]
        d_own[..., 2 * hidden:] = d_new * r
        d_given[:, t, :, : 2 * hidden] = d_own[..., : 2 * hidden]
        d_given[:, t, :, 2 * hidden:] = d_new
        d_u += h.transpose(0, 2, 1) @ d_own
        d_h = d - through + through * z + d_own @ u_t
    flat = d_given.reshape(2, -1, 3 * hidden)
    return d_given @ w.transpose(0, 2, 1)[:, None], x.reshape(2, -1, x.shape[3]).transpose(0, 2, 1) @ flat, d_u, flat.sum(1)


@dataclass
class Network:
    """Weights of the network and of its calibration."""

    weights: dict[str, np.ndarray]
    blend: tuple[float, float, float] = (1.0, 0.0, 0.0)
    constant: float | None = None
    _cache: dict = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int) -> "Network":
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        weights = {"word": 0.3 * rng.standard_normal((WORD_ROWS, WORD_DIM)).astype(np.float32),
                   "char": 0.5 * rng.standard_normal((CHAR_ROWS, CHAR_DIM)).astype(np.float32)}
        wide = WORD_DIM + 2 * CHAR_HIDDEN
        pair = lambda *shape: np.stack([draw(*shape), draw(*shape)])
        weights |= {"cw": pair(CHAR_DIM, 3 * CHAR_HIDDEN), "cu": pair(CHAR_HIDDEN, 3 * CHAR_HIDDEN),
                    "cb": np.zeros((2, 3 * CHAR_HIDDEN), np.float32), "ww": pair(wide, 3 * HIDDEN),
                    "wu": pair(HIDDEN, 3 * HIDDEN), "wb": np.zeros((2, 3 * HIDDEN), np.float32)}
        weights |= {"att": draw(2 * HIDDEN, ATTENTION), "att_v": draw(ATTENTION), "out": draw(2 * HIDDEN), "out_b": np.zeros(1, np.float32)}
        return cls(weights)

    def encode_words(self, words: list[str], keep: bool = False):
        """Vectors of distinct words: hash vector and character states."""
        p = self.weights
        codes, mask = char_codes(words)
        x = both_ways(p["char"][codes])
        states, saved = gru(x, both_ways(mask), p["cw"], p["cu"], p["cb"], keep)
        vectors = np.concatenate([p["word"][word_rows(words)], states[0, -1], states[1, -1]], axis=1)
        return vectors, (codes, x, saved)

    def pool(self, states, mask):
        """Attention weights (position, row) and pooled states; a row without words pools to zero."""
        p = self.weights
        inner = np.tanh(states @ p["att"])
        score = np.where(mask > 0, inner @ p["att_v"], -1e9)
        share = np.exp(score - score.max(0)) * mask
        share /= np.maximum(share.sum(0), 1e-9)
        return inner, share, np.einsum("tb,tbh->bh", share, states)

    def step(self, words: list[str], index, mask, labels, drop, rates) -> None:
        """One training step on windows (position, row) of indexes into the distinct words."""
        p = self.weights
        vectors, (codes, chars, saved) = self.encode_words(words, True)
        vectors[:, :WORD_DIM] *= drop[:, None]
        x = both_ways(vectors[index])
        ways, kept = gru(x, both_ways(mask), p["ww"], p["wu"], p["wb"])
        states = np.concatenate([ways[0], ways[1, ::-1]], axis=2)
        inner, share, pooled = self.pool(states, mask)
        d_logit = ((_sigmoid(pooled @ p["out"] + p["out_b"]) - labels) / len(labels)).astype(np.float32)
        grads = {"out": pooled.T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_states = share[:, :, None] * d_pooled[None]
        d_share = np.einsum("bh,tbh->tb", d_pooled, states)
        d_score = share * (d_share - (share * d_share).sum(0))
        d_inner = d_score[:, :, None] * p["att_v"] * (1 - inner * inner)
        grads["att_v"] = np.einsum("tb,tba->a", d_score, inner)
        grads["att"] = states.reshape(-1, 2 * HIDDEN).T @ d_inner.reshape(-1, ATTENTION)
        d_states = (d_states + d_inner @ p["att"].T).astype(np.float32)
        d_ways = np.stack([d_states[:, :, :HIDDEN], d_states[::-1, :, HIDDEN:]])
        d_x, grads["ww"], grads["wu"], grads["wb"] = gru_gradients(d_ways, kept, x, p["ww"], p["wu"])
        d_vectors = np.zeros_like(vectors)
        np.add.at(d_vectors, index.ravel(), (d_x[0] + d_x[1, ::-1]).reshape(-1, vectors.shape[1]))
        last = np.zeros((2, len(saved), len(words), CHAR_HIDDEN), np.float32)
        last[0, -1] = d_vectors[:, WORD_DIM: WORD_DIM + CHAR_HIDDEN]
        last[1, -1] = d_vectors[:, WORD_DIM + CHAR_HIDDEN:]
        d_chars, grads["cw"], grads["cu"], grads["cb"] = gru_gradients(last, saved, chars, p["cw"], p["cu"])
        grads["char"] = np.zeros_like(p["char"])
        np.add.at(grads["char"], codes.ravel(), (d_chars[0] + d_chars[1, ::-1]).reshape(-1, CHAR_DIM))
        rows, places = np.unique(word_rows(words), return_inverse=True)
        d_rows = np.zeros((len(rows), WORD_DIM), np.float32)
        np.add.at(d_rows, places, d_vectors[:, :WORD_DIM] * drop[:, None])
        rates.update(p, grads, rows, d_rows)

    def projections(self, words: list[str]) -> np.ndarray:
        """What each word adds to the gates of both directions: (word, direction, 3 hidden)."""
        p = self.weights
        vectors, _ = self.encode_words(words)
        return np.stack([vectors @ p["ww"][k] + p["wb"][k] for k in (0, 1)], axis=1).astype(np.float32)

    def window_logits(self, table: np.ndarray, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Logits of windows (row, position) of rows of a projection table."""
        p = self.weights
        rows, steps = index.shape
        if "u" not in self._cache:
            half = np.concatenate([np.full(2 * HIDDEN, 0.5), np.ones(HIDDEN)]).astype(np.float32)
            self._cache["half"] = half
            self._cache["u"] = p["wu"] * half  # gates by tanh of the half
        half, u = self._cache["half"], self._cache["u"]
        full = bool(mask.all())
        h = np.zeros((2, rows, HIDDEN), np.float32)
        states = np.empty((steps, rows, 2 * HIDDEN), np.float32)
        for t in range(steps):
            given = np.stack([table[index[:, t], 0], table[index[:, steps - 1 - t], 1]]) * half
            own = h @ u
            gates = np.tanh(given[..., : 2 * HIDDEN] + own[..., : 2 * HIDDEN])
            new = np.tanh(given[..., 2 * HIDDEN:] + (0.5 + 0.5 * gates[..., HIDDEN:]) * own[..., 2 * HIDDEN:])
            change = (0.5 - 0.5 * gates[..., :HIDDEN]) * (new - h)
            if not full:
                change = change * np.stack([mask[:, t], mask[:, steps - 1 - t]])[:, :, None]
            h = h + change
            states[t, :, :HIDDEN], states[steps - 1 - t, :, HIDDEN:] = h[0], h[1]
        _, _, pooled = self.pool(states, mask.T)
        return pooled @ p["out"] + p["out_b"]

    def sliding_logits(self, given: np.ndarray) -> np.ndarray:
        """Logits of all windows of a run of words, from their projections (word, direction, 3 hidden)."""
        p = self.weights
        if "slide" not in self._cache:
            by_gate = p["wu"].reshape(2, HIDDEN, 3, HIDDEN).transpose(2, 0, 1, 3)
            self._cache["slide"] = np.ascontiguousarray(by_gate[:2] * np.float32(0.5)), np.ascontiguousarray(by_gate[2]), np.column_stack([p["att"], p["out"]])
        u_gates, u_new, heads = self._cache["slide"]
        count = len(given) - WINDOW + 1
        given = np.ascontiguousarray(given.reshape(-1, 2, 3, HIDDEN).transpose(2, 1, 0, 3))
        given[:2] *= 0.5  # gates by tanh of the half
        h, new = np.zeros((2, count, HIDDEN), np.float32), np.empty((2, count, HIDDEN), np.float32)
        gates, states = np.empty((2, 2, count, HIDDEN), np.float32), np.empty((WINDOW, count, 2 * HIDDEN), np.float32)
        keep, reset = gates
        for t in range(WINDOW):
            back = WINDOW - 1 - t
            np.matmul(h, u_gates, out=gates)
            gates[:, 0] += given[:2, 0, t: t + count]
            gates[:, 1] += given[:2, 1, back: back + count]
            np.tanh(gates, out=gates)
            np.matmul(h, u_new, out=new)
            reset += 1
            reset *= 0.5
            new *= reset
            new[0] += given[2, 0, t: t + count]
            new[1] += given[2, 1, back: back + count]
            np.tanh(new, out=new)
            new -= h
            keep -= 1
            keep *= -0.5
            new *= keep
            h += new
            states[t, :, :HIDDEN], states[back, :, HIDDEN:] = h[0], h[1]
        found = states.reshape(-1, 2 * HIDDEN) @ heads
        pull = np.exp(np.tanh(found[:, :-1]) @ p["att_v"]).reshape(WINDOW, count)
        value = found[:, -1].reshape(WINDOW, count)
        return (pull * value).sum(0) / pull.sum(0) + p["out_b"]

    def score(self, features: np.ndarray) -> np.ndarray:
        """Scores of texts from their features (row, 2)."""
        if self.constant is not None:
            return np.full(len(features), self.constant)
        return _sigmoid(features @ np.array(self.blend[:2]) + self.blend[2])


def text_features(highest: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Largest window logit and log-odds of the mean window probability."""
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.stack([np.clip(highest, -12, 12), np.log(mean / (1 - mean))], axis=1).astype(np.float64)


class Rates:
    """Adaptive moments for the dense weights, adaptive row rates for the word vectors."""

    def __init__(self, rate: float = 0.01):
        self.rate, self.t, self.first, self.second, self.rows = rate, 0, {}, {}, np.full(WORD_ROWS, 1e-8, np.float32)

    def update(self, weights, grads, rows, d_rows) -> None:
        self.t += 1
        for name, g in grads.items():
            norm = float(np.sqrt((g * g).sum()))
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m = self.first[name] = 0.9 * self.first.get(name, 0) + 0.1 * g
            v = self.second[name] = 0.999 * self.second.get(name, 0) + 0.001 * g * g
            weights[name] -= (self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-7)).astype(np.float32)
        self.rows[rows] += (d_rows * d_rows).mean(1)
        weights["word"][rows] -= 4 * self.rate * d_rows / np.sqrt(self.rows[rows])[:, None]


class Sampled:
    """The sampled words of each document as numbers of distinct words, passage after passage."""

    def __init__(self, samples: list[tuple]):
        self.labels = [y for _, y, _ in samples]
        number: dict[str, int] = {"": 0}
        self.rows = []
        for _, _, passages in samples:
            words = [w for passage in passages for w in passage.split()]
            self.rows.append(np.array([number.setdefault(w, len(number)) for w in words] or [0], np.int64))
        self.words = list(number)

    def highest(self, net: Network) -> list[np.ndarray]:
        """The window of highest logit of each document."""
        table = np.empty((len(self.words), 2, 3 * HIDDEN), np.float32)
        by_length = np.argsort([len(w) for w in self.words], kind="stable")
        for at in range(0, len(self.words), 2048):
            some = by_length[at: at + 2048]
            table[some] = net.projections([self.words[i] for i in some])
        net._cache.clear()  # made from weights that move on
        found = []
        for row in self.rows:
            if len(row) <= WINDOW:
                found.append(row)
                continue
            at = int(net.sliding_logits(table[row]).argmax())
            found.append(row[at: at + WINDOW])
        net._cache.clear()
        return found


def fit(samples: list[tuple], toxic_share: float, steps: int = 500, batch: int = 64, seed: int = 7) -> Network:
    """Fit on rows (document, label, passages of joined words).

    Half of each batch are windows of toxic documents.  At first they are long windows at random, of which many hold
    something toxic.  Later a toxic document is represented by its highest window, since only some of its
    windows need be toxic, and half of the others are the highest windows of clean documents; the highest are
    chosen anew again and again.
    """
    net, rng, rates = Network.fresh(seed), np.random.default_rng(seed), Rates()
    held = Sampled(samples)
    sides = [[k for k, label in enumerate(held.labels) if label == y] for y in (0, 1)]
    if not all(sides):
        net.constant = toxic_share
        return net
    tops, half = [], batch // 2

    def passage(k: int, size: int) -> np.ndarray:
        row = held.rows[k]
        at = rng.integers(0, max(1, len(row) - size + 1))
        return row[at: at + size]

    first, again = int(steps * FIRST_SHARE), max(1, steps // 5)
    for number in range(steps):
        rates.rate = 0.012 * (1 - number / steps)  # falls to nothing, so that the last steps settle the weights
        if number >= first and (number - first) % again == 0:
            tops = held.highest(net)
        clean, toxic = (rng.choice(side, half) for side in sides)
        if tops:
            picked = [tops[k] if i % 2 else passage(k, WINDOW) for i, k in enumerate(clean)] + [tops[k] for k in toxic]
        else:
            picked = [passage(k, FIRST_WINDOW) for k in (*clean, *toxic)]
        used, places = np.unique(np.concatenate(picked), return_inverse=True)
        words = [held.words[i] for i in used.tolist()]
        longest = max(map(len, picked))
        index, mask = np.zeros((longest, 2 * half), np.int64), np.zeros((longest, 2 * half), np.float32)
        at = 0
        for k, window in enumerate(picked):
            index[: len(window), k], mask[: len(window), k] = places[at: at + len(window)], 1
            at += len(window)
        labels = np.repeat([0.0, 1.0], half).astype(np.float32)
        net.step(words, index, mask, labels, (rng.random(len(words)) > 0.5).astype(np.float32), rates)
    net._cache.clear()
    return net


def logistic_fit(features: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Weights of two features and shift, by Newton steps with a small ridge."""
    middle, spread = features.mean(0), features.std(0) + 1e-9
    x = np.column_stack([(features - middle) / spread, np.ones(len(labels))])
    w, ridge = np.zeros(3), np.array([0.1, 0.1, 1e-6])
    for _ in range(50):
        q = _sigmoid(x @ w)
        gradient = x.T @ (weight * (q - labels)) + ridge * w
        curvature = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(ridge + 1e-9)
        w -= np.clip(np.linalg.solve(curvature, gradient), -2, 2)
    a = w[:2] / spread
    return float(a[0]), float(a[1]), float(w[2] - a @ middle)


class Scorer:
    """Scores texts with a bounded table of word projections."""

    def __init__(self, net: Network):
        self.net = net
        self._reset()

    def _reset(self) -> None:
        self._known, self._at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._table = self.net.projections([""])

    def _reset_if_full(self) -> None:
        """Between chunks only, so that the rows of a chunk stay where they are."""
        if len(self._known) > TABLE_WORDS:
            self._reset()

    def _places(self, block: Block, part: slice) -> np.ndarray:
        """Row of the table of each word of a part of the block."""
        hashes = block.hash[part]
        at = np.searchsorted(self._known, hashes)
        fresh = np.flatnonzero(np.append(self._known, np.uint64(0))[at] != hashes)
        fresh = np.union1d(fresh, np.flatnonzero(at == len(self._known)))
        if len(fresh):
            values, first = np.unique(hashes[fresh], return_index=True)
            words = decoded(block, fresh[first] + part.start)
            added = np.empty((len(words), 2, 3 * HIDDEN), np.float32)
            by_length = np.argsort([len(w) for w in words], kind="stable")  # little padding in a chunk
            for k in range(0, len(words), 2048):
                some = by_length[k: k + 2048]
                added[some] = self.net.projections([words[i] for i in some])
            numbers = len(self._table) + np.arange(len(words))
            self._table = np.concatenate([self._table, added])
            known, places = np.concatenate([self._known, values]), np.concatenate([self._at, numbers])
            order = np.argsort(known, kind="stable")  # two sorted runs
            self._known, self._at = known[order], places[order]
            at = np.searchsorted(self._known, hashes)
        return self._at[at]

    def features(self, column: pa.Array) -> np.ndarray:
        """Features of each text over all its windows."""
        best, total = np.full(len(column), -np.inf), np.zeros(len(column))
        count = np.ones(len(column))
        for block in map(short_words, word_blocks(column)):
            sizes = np.bincount(block.row, minlength=block.rows)
            rows = slice(block.first, block.first + block.rows)
            count[rows] = np.maximum(1, sizes - WINDOW + 1)
            self._short(block, sizes, best[rows], total[rows])
            for at in range(0, len(block.row) - WINDOW + 1, CHUNK_WORDS):
                self._reset_if_full()
                part = slice(at, min(at + CHUNK_WORDS + WINDOW - 1, len(block.row)))
                self._run(self._places(block, part), block.row[part] + block.first, best, total)
        return text_features(best, total / count)

    def _run(self, places: np.ndarray, owners: np.ndarray, best: np.ndarray, total: np.ndarray) -> None:
        """All windows of a run of words; those over the border of two texts do not count."""
        for at in range(0, len(places) - WINDOW + 1, CHUNK_WINDOWS):
            end = at + CHUNK_WINDOWS + WINDOW - 1
            owner = owners[at:end]
            inside = owner[: len(owner) - WINDOW + 1] == owner[WINDOW - 1:]
            if inside.any():
                logits, owner = self.net.sliding_logits(self._table[places[at:end]])[inside], owner[: len(inside)][inside]
                np.maximum.at(best, owner, logits)
                np.add.at(total, owner, _sigmoid(logits))

    def _short(self, block: Block, sizes: np.ndarray, best: np.ndarray, total: np.ndarray) -> None:
        """Texts of fewer words than a window."""
        few = np.flatnonzero(sizes < WINDOW)
        firsts = np.cumsum(sizes) - sizes
        for at in range(0, len(few), CHUNK_WINDOWS):
            self._reset_if_full()
            part = few[at: at + CHUNK_WINDOWS]
            index, mask = np.zeros((len(part), WINDOW), np.int64), np.zeros((len(part), WINDOW), np.float32)
            for i, k in enumerate(part.tolist()):
                if sizes[k]:
                    index[i, : sizes[k]] = self._places(block, slice(int(firsts[k]), int(firsts[k] + sizes[k])))
                    mask[i, : sizes[k]] = 1
            best[part] = self.net.window_logits(self._table, index, mask)
            total[part] = _sigmoid(best[part])


def held_out(id_column: Column) -> Column:
    """Rows whose labels are never learned from: checksum of the id as text, remainder 2 by 4."""
    return F.crc32(id_column.cast("string").cast("binary")) % 4 == 2


def training_sample(
    docs: DataFrame, labels: DataFrame, sample_rows: int, id_col: str, text_col: str, label_col: str
) -> tuple[DataFrame | None, float]:
    """Rows (id, label, text) of the labelled documents to learn from, and the share of toxic labels; held-out rows are left out."""
    usable = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    usable = usable.filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    usable = usable.groupBy("id").agg(F.max("label").alias("label"))
    total, toxic = usable.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not total:
        return None, 0.5
    picked = None
    for side in (0, 1):
        part = usable.filter(F.col("label") == side).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
        picked = part if picked is None else picked.unionByName(part)
    texts = text_rows(docs, id_col, text_col).withColumnsRenamed({id_col: "id", text_col: "text"})
    joined = texts.join(stage(picked, "toxicity-picked"), "id")
    one = joined.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    return stage(one, "toxicity-sample"), toxic / total


def sampled_passages(sample: DataFrame, most: int) -> list[tuple]:
    """Rows (id, label, passages of joined words), ordered: at most ``most`` evenly spaced passages of each text."""

    def cut(batches):
        for batch in batches:
            windows = [[""]] * batch.num_rows
            for block in map(short_words, word_blocks(batch.column(2))):
                firsts = np.searchsorted(block.row, np.arange(block.rows + 1))
                for k in range(block.rows):
                    words = decoded(block, slice(int(firsts[k]), int(firsts[k + 1])))
                    parts = -(-len(words) // FIRST_WINDOW)
                    chosen = range(parts) if parts <= most else [i * parts // most for i in range(most)]
                    windows[block.first + k] = [" ".join(words[c * FIRST_WINDOW: (c + 1) * FIRST_WINDOW]) for c in chosen]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(windows, pa.list_(pa.string()))], ["id", "label", "windows"])

    rows = sample.select("id", "label", "text").mapInArrow(cut, f"id {id_type(sample, 'id')}, label int, windows array<string>")
    return sorted((r["id"], r["label"], r["windows"]) for r in rows.collect())  # at most two classes of sample_rows


def calibrate(net: Network, sample: DataFrame, share: float, checked: list) -> None:
    """Fits the blend of the text features on the checked documents, over all their windows."""
    score_features = _shared_scorer(sample, net)
    wanted = sample.filter(F.col("id").isin(checked)) if checked else sample

    def run(batches):
        for batch in batches:
            found = score_features(batch.column(1), True)
            yield pa.record_batch([batch.column(0), pa.array(found[:, 0]), pa.array(found[:, 1])], ["label", "highest", "mean"])

    rows = wanted.select("label", "text").mapInArrow(run, "label int, highest double, mean double").collect()
    labels, features = np.array([r["label"] for r in rows], float), np.array([(r["highest"], r["mean"]) for r in rows])
    order = np.lexsort((features[:, 1], features[:, 0]))
    labels, features = labels[order], features[order]
    net.blend = logistic_fit(features, labels, np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean())))


def train(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 2000, sample_passages: int = 48, steps: int = 500,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Network:
    """Network fitted on at most ``sample_rows`` labelled documents of each class."""
    ship_package(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    sample, share = training_sample(docs, labels, sample_rows, id_col, text_col, label_col)
    samples = sampled_passages(sample, sample_passages) if sample is not None else []
    checked = samples[4::5]
    if min(sum(y == side for _, y, _ in checked) for side in (0, 1)) < 5:
        checked = []  # a class is too small to keep a part of it from the fit
    kept = {id for id, _, _ in checked}
    net = fit([s for s in samples if s[0] not in kept], share, steps)
    if net.constant is None:
        calibrate(net, sample, share, sorted(kept))
    return net


_scorers: dict[int, Scorer] = {}


def _shared_scorer(docs: DataFrame, net: Network):
    """Function from a column of texts to scores, or features, for use in tasks; the weights are broadcast, their size is fixed."""
    shared = docs.sparkSession.sparkContext.broadcast(Network(net.weights, net.blend, net.constant))

    def scores(texts: pa.Array, features_only: bool = False) -> np.ndarray:
        key = id(shared.value)  # a broadcast value is one object in a worker
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(shared.value)
        found = _scorers[key].features(texts)
        return found if features_only else shared.value.score(found)

    return scores


def keep_below(docs: DataFrame, net: Network, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns."""
    ship_package(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    scorer, at = _shared_scorer(docs, net), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            kept = batch.filter(pa.array(scorer(batch.column(at)) < threshold))
            if kept.num_rows:
                yield kept

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, net: Network, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, held_out, score, predicted): every whole text scored over all its windows."""
    ship_package(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    scorer = _shared_scorer(docs, net)

    def run(batches):
        for batch in batches:
            scores = scorer(batch.column(2))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())],
                [id_col, "held_out", "score", "predicted"],
            )

    rows = text_rows(docs, id_col, text_col).select(
        F.col(f"`{id_col}`"), F.coalesce(held_out(F.col(f"`{id_col}`")), F.lit(False)).alias("held_out"), F.col(f"`{text_col}`")
    )
    return rows.mapInArrow(run, f"`{id_col}` {id_type(docs, id_col)}, held_out boolean, score double, predicted int")
