"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A token's input is its word's vector beside the scaled sum of its character n-grams' vectors. All overlapping windows of a text
are scored and the highest decides. Labels are of whole texts, so training is by multiple instances: of each text
the window that scores highest counts. Everything is numpy; a window's input gates depend on the word alone and are kept for each word.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadmosaic.llm.common import in_fold, per_text, sample_ids, sample_texts, table

WINDOW, STRIDE = 48, 24
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
#: Bounds of training: documents with and without the label, bytes of their texts, words of the vocabulary. Character n-grams share hashed rows.
TOXIC, CLEAN, SAMPLE_BYTES, MAX_WORDS, GRAM_ROWS = 1500, 3000, 32 << 20, 20000, 1 << 16
#: HIDE is the share of words that a training step sees by their characters alone.
EPOCHS, BATCH, RATE, VECTOR_RATE, HIDE, SEED = 10, 128, 0.01, 0.01, 0.5, 5
CACHE_WORDS = 1 << 17
PAD = 0

TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def gram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed rows of the words' n-grams of 3 to 6 bytes, word after word, and how many each word has. ``<`` and ``>`` stand at a word's ends."""
    raw = [f"<{w}>".encode() for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    letters = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(letters))  # bytes to the word's end
    rows, owners, value = [], [], np.zeros(len(letters), np.uint64)
    for n in range(1, 7):
        value = value[: len(letters) - n + 1] * np.uint64(257) + letters[n - 1 :] + np.uint64(1)
        if n >= 3:
            inside = left[: len(value)] >= n
            rows.append(((value[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 16)).astype(np.int64))
            owners.append(owner[: len(value)][inside])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(rows)[order], np.bincount(owners, minlength=len(raw))


def windows(n: int) -> list[tuple[int, int]]:
    """(first, end) of overlapping windows that cover ``n`` tokens."""
    return [(a, min(a + WINDOW, n)) for a in range(0, max(n - WINDOW + STRIDE, 1), STRIDE)] if n else []


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters by name, a forward pass over word ids for training and scoring, and the backward pass."""

    def __init__(self, words: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.words = {w: i + 1 for i, w in enumerate(words)}  # 0 stands for all others
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {"word": normal(0.02, len(words) + 1, WORD_DIM), "char": normal(0.02, GRAM_ROWS, CHAR_DIM)}
        self.p["word"][0] = 0
        for side in "fb":
            self.p |= {f"w{side}": normal(d**-0.5, d, 3 * h), f"u{side}": normal(h**-0.5, h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}
        self.p |= {"a": normal((2 * h) ** -0.5, 2 * h, ATTENTION), "a0": np.zeros(ATTENTION, np.float32), "v": normal(ATTENTION**-0.5, ATTENTION), "o": normal((2 * h) ** -0.5, 2 * h), "o0": np.full(1, -1.0, np.float32)}

    def vectors(self, words: list[str]) -> np.ndarray:
        return self.joined(np.array([self.words.get(w, 0) for w in words]), *gram_rows(words))

    def joined(self, rows: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Word vectors beside the sums of n-gram vectors, scaled by the root of their number. Every word has an n-gram."""
        chars = np.add.reduceat(self.p["char"][flat], np.cumsum(lengths) - lengths, axis=0) / np.sqrt(lengths)[:, None]
        return np.concatenate([self.p["word"][rows], chars.astype(np.float32)], axis=1)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Input parts of the gates, both directions side by side."""
        return np.concatenate([x @ self.p["wf"] + self.p["cf"], x @ self.p["wb"] + self.p["cb"]], axis=-1)

    def run(self, gates: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows; ``gates`` is (time, window, 6 HIDDEN), ``mask`` (time, window). ``keep`` gets what the backward pass needs."""
        t_all, b, h = gates.shape[0], gates.shape[1], HIDDEN
        states = np.empty((t_all, b, 2 * h), np.float32)
        steps: dict[str, list] = {"f": [None] * t_all, "b": [None] * t_all}
        for side, at, order in (("f", 0, range(t_all)), ("b", h, range(t_all - 1, -1, -1))):
            u, state = self.p[f"u{side}"], np.zeros((b, h), np.float32)
            for t in order:
                x = gates[t, :, 3 * at : 3 * at + 3 * h]
                hu = state @ u
                zr = _sigmoid(x[:, : 2 * h] + hu[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                n = np.tanh(x[:, 2 * h :] + r * hu[:, 2 * h :])
                m = mask[t][:, None]
                new = state + m * (1 - z) * (n - state)
                if keep is not None:
                    steps[side][t] = (state, z, r, n, hu[:, 2 * h :], m)
                state = new
                states[t, :, at : at + h] = state
        k = np.tanh(states @ self.p["a"] + self.p["a0"])
        e = np.where(mask > 0, k @ self.p["v"], -1e9)
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", alpha, states)
        if keep is not None:
            keep += [states, steps, k, alpha, pooled]
        return pooled @ self.p["o"] + self.p["o0"][0]

    def backward(self, x: np.ndarray, kept: list, slope: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients by name, and of the token vectors ``x`` (time, window, dim), from the slope at each logit."""
        states, steps, k, alpha, pooled = kept
        h, p = HIDDEN, self.p
        g = {"o": pooled.T @ slope, "o0": slope.sum(keepdims=True)}
        d_pool = slope[:, None] * p["o"]
        d_states = alpha[:, :, None] * d_pool
        d_alpha = np.einsum("bh,tbh->tb", d_pool, states)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        d_k = d_e[:, :, None] * p["v"] * (1 - k * k)
        g |= {"v": np.einsum("tb,tba->a", d_e, k), "a": np.einsum("tbh,tba->ha", states, d_k), "a0": d_k.sum(axis=(0, 1))}
        d_states = d_states + d_k @ p["a"].T
        d_x = np.zeros_like(x)
        for side, at, order in (("f", 0, range(len(x) - 1, -1, -1)), ("b", h, range(len(x)))):
            u, d_u = p[f"u{side}"], np.zeros_like(p[f"u{side}"])
            d_gates, d_next = np.zeros((*x.shape[:2], 3 * h), np.float32), np.zeros((x.shape[1], h), np.float32)
            for t in order:
                state, z, r, n, hn, m = steps[side][t]
                d_new = d_states[t, :, at : at + h] + d_next
                d_n = m * d_new * (1 - z) * (1 - n * n)
                d_z = -m * d_new * (n - state) * z * (1 - z)
                d_r = d_n * hn * r * (1 - r)
                d_gates[t] = np.concatenate([d_z, d_r, d_n], axis=1)
                d_hu = np.concatenate([d_z, d_r, d_n * r], axis=1)
                d_u += state.T @ d_hu
                d_next = d_new * (1 - m * (1 - z)) + d_hu @ u.T
            g |= {f"u{side}": d_u, f"w{side}": np.einsum("tbd,tbg->dg", x, d_gates), f"c{side}": d_gates.sum(axis=(0, 1))}
            d_x += d_gates @ p[f"w{side}"].T
        return g, d_x


class _Sample:
    """Training texts as word numbers, with each word's n-gram rows."""

    def __init__(self, texts: list[str | None], labels: list[int]):
        at: dict[str, int] = {}
        self.ids, y = [], []
        for text, label in zip(texts, labels):
            if words := tokens(text):
                self.ids.append(np.array([at.setdefault(w, len(at)) for w in words], np.int32))
                y.append(label)
        self.y, self.words = np.array(y, int), list(at)
        self.flat, self.lengths = gram_rows(self.words) if at else (np.zeros(0, int), np.zeros(0, int))
        self.flat = self.flat.astype(np.uint16 if GRAM_ROWS <= 1 << 16 else np.int32)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def grams(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-gram rows of some words, word after word, and how many each has."""
        n = self.lengths[words]
        return self.flat[np.repeat(self.starts[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n

    def vocabulary(self) -> list[str]:
        times = np.zeros(len(self.words), int)
        for x in self.ids:
            times[np.unique(x)] += 1
        return sorted((self.words[i] for i in np.argsort(-times, kind="stable")[:MAX_WORDS] if times[i] >= 3))

    def odds(self) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of the label given each n-gram row and each word, from numbers of texts, drawn to 0 as if each had been seen five times more at the usual rate."""
        grams, words, n = np.zeros((2, GRAM_ROWS)), np.zeros((2, len(self.words))), np.bincount(self.y, minlength=2)
        for x, label in zip(self.ids, self.y):
            own = np.unique(x)
            words[label, own] += 1
            grams[label, np.unique(self.grams(own)[0])] += 1
        rate = 5 / n.sum()
        return tuple(np.log(c[1] / n[1] + rate) - np.log(c[0] / n[0] + rate) for c in (grams, words))

    def first_scores(self, odds: np.ndarray) -> list[np.ndarray]:
        """For each text, each window's best word by its n-grams' three highest odds: where training starts."""
        best = np.array([np.sort(odds[self.flat[a : a + k]])[-3:].mean() for a, k in zip(self.starts, self.lengths)])
        return [np.array([best[x[a:z]].max() for a, z in windows(len(x))]) for x in self.ids]

    def scores(self, net: Network, rows: np.ndarray) -> list[np.ndarray]:
        """For each text, each window's logit. ``rows`` are the words' rows in the network's vocabulary."""
        scorer = Scorer(net, 1)
        parts = np.array_split(np.arange(len(self.words)), len(self.words) // 20000 + 1)
        scorer.table = np.concatenate([net.gates(net.joined(rows[p], *self.grams(p))) for p in parts])
        out = []
        for a in range(0, len(self.ids), 100):
            spans = [[x[s:z] for s, z in windows(len(x))] for x in self.ids[a : a + 100]]
            logits = scorer.logits([x for s in spans for x in s])
            out += np.split(logits, np.cumsum([len(s) for s in spans])[:-1])
        return out


def train(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network from labelled texts; texts without a token don't count."""
    sample = _Sample(texts, labels)
    y, ids = sample.y, sample.ids
    net = Network(sample.vocabulary(), seed)
    if not len(y) or y.min() == y.max():
        net.p["o"][:] = 0
        net.p["o0"][:] = -4.0 if not y.sum() else 4.0
        return net
    rng = np.random.default_rng(seed)
    in_vocabulary = np.array([net.words.get(w, 0) for w in sample.words])
    gram_odds, word_odds = sample.odds()
    net.p["char"][:, 0], net.p["word"][in_vocabulary, 0] = gram_odds, word_odds  # where the vectors start from
    net.p["word"][0] = 0
    scores = sample.first_scores(gram_odds)
    m, v, step = {}, {}, 0
    for epoch in range(epochs):
        if epoch >= 6 and epoch % 3 == 0:  # choose again by the network itself
            scores = sample.scores(net, in_vocabulary)
        picks = []
        for i, s in enumerate(scores):
            spans = windows(len(ids[i]))
            picks.append((i, *spans[int(s.argmax())]))
            if not y[i]:
                picks.append((i, *spans[int(rng.integers(len(spans)))]))
        rng.shuffle(picks)
        weight = np.array([1.0, max(1.0, 0.5 * len(picks) / max(y.sum(), 1) - 0.5)])
        weight[1] = min(weight[1], 4.0)
        for b in range(0, len(picks), BATCH):
            part = picks[b : b + BATCH]
            t_all = max(z - a for _, a, z in part)
            mask = np.zeros((t_all, len(part)), np.float32)
            word = np.zeros((t_all, len(part)), np.int64)
            for j, (i, a, z) in enumerate(part):
                mask[: z - a, j], word[: z - a, j] = 1, ids[i][a:z]
            used, back = np.unique(word, return_inverse=True)
            back = back.reshape(word.shape)
            # words are hidden now and then, so that characters must carry them too
            hide = rng.random(len(used)) < HIDE
            rows = np.where(hide, 0, in_vocabulary[used])
            flat, lengths = sample.grams(used)
            vectors = net.joined(rows, flat, lengths)
            x = vectors[back]
            kept_states: list = []
            logits = net.run(net.gates(x), mask, kept_states)
            target = np.array([y[i] for i, _, _ in part], np.float32)
            slope = ((_sigmoid(logits) - target) * weight[target.astype(int)] / len(part)).astype(np.float32)
            grads, d_x = net.backward(x, kept_states, slope)
            d_vec = np.zeros_like(vectors)
            np.add.at(d_vec, back.ravel(), d_x.reshape(-1, x.shape[2]))
            grads["word"] = np.zeros_like(net.p["word"])
            np.add.at(grads["word"], rows, d_vec[:, :WORD_DIM])
            grads["word"][0] = 0
            grads["char"] = np.zeros_like(net.p["char"])
            np.add.at(grads["char"], flat, np.repeat(d_vec[:, WORD_DIM:] / np.sqrt(lengths)[:, None], lengths, axis=0))
            step += 1
            norm = np.sqrt(sum(float((q * q).sum()) for q in grads.values()))
            for name, grad in grads.items():
                grad = grad / max(1.0, norm) + (1e-5 * net.p[name] if name in ("word", "char") else 0)
                m[name] = 0.9 * m.get(name, 0) + 0.1 * grad
                v[name] = 0.999 * v.get(name, 0) + 0.001 * grad * grad
                rate, size = RATE, v[name]
                if name in ("word", "char"):  # one scale for all rows: what few windows show must not move as fast as what many do
                    rate, size = VECTOR_RATE, size.max()
                net.p[name] = (net.p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(size / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


class Scorer:
    """Scores texts in batches; keeps the input gates of words it has seen, up to a bound."""

    def __init__(self, net: Network, cache_words: int = CACHE_WORDS, batch: int = 1024):
        self.net, self.batch, self.cache_words = net, batch, cache_words
        self.places: dict[str, int] = {}
        self.table = np.zeros((cache_words, 6 * HIDDEN), np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        get = self.places.get
        out = [get(w, -1) for w in words]
        if -1 in out:
            new = list(dict.fromkeys(w for w, i in zip(words, out) if i < 0))
            first = len(self.places)
            self.table[first : first + len(new)] = self.net.gates(self.net.vectors(new))
            self.places.update(zip(new, range(first, first + len(new))))
            out = [self.places[w] for w in words]
        return np.array(out)

    def logits(self, ids: list[np.ndarray]) -> np.ndarray:
        """Logits of windows given by their ids, longest first so that batches hold windows of like length."""
        sizes = np.array([len(x) for x in ids])
        out = np.empty(len(ids), np.float32)
        order = np.argsort(-sizes, kind="stable")
        for a in range(0, len(order), self.batch):
            part = order[a : a + self.batch]
            t_all = sizes[part[0]]
            word, mask = np.zeros((t_all, len(part)), np.int64), np.zeros((t_all, len(part)), np.float32)
            for j, i in enumerate(part):
                word[: sizes[i], j], mask[: sizes[i], j] = ids[i], 1
            out[part] = self.net.run(self.table[word], mask)
        return out

    def __call__(self, texts: list) -> list:
        """The highest window's score of each text; 0 for a text without a token."""
        out = np.zeros(len(texts))
        held, owner = [], []

        def flush() -> None:
            if held:
                np.maximum.at(out, owner, _sigmoid(self.logits(held).astype(np.float64)))
                held.clear()
                owner.clear()

        for i, text in enumerate(texts):
            words = tokens(text)
            for at in range(0, max(len(words) - WINDOW + STRIDE, 1) if words else 0, 2048 * STRIDE):  # very long texts, some windows at a time
                part = words[at : at + 2047 * STRIDE + WINDOW]
                if len(self.places) + len(part) > self.cache_words:
                    flush()
                    self.places.clear()
                ids = self.ids(part)
                spans = windows(len(part))
                held += [ids[a:z] for a, z in spans]
                owner += [i] * len(spans)
                if len(held) >= 4 * self.batch:
                    flush()
        flush()
        return [out]


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN, most_bytes: int = SAMPLE_BYTES) -> Network:
    """A network from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, toxic``). The sample is bounded by the parameters, in texts and in bytes; of repeated ids one row counts, rows with nulls don't."""
    chosen = sample_ids(labels.where("toxic = 1"), "toxic", toxic).unionAll(sample_ids(labels.where("toxic = 0"), "toxic", clean))
    rows = sample_texts(docs, chosen, most_bytes).orderBy("doc_id", "toxic").collect()
    return train([r.text for r in rows], [int(r.toxic) for r in rows])


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, score``: one for each row of ``docs``, over all windows of the whole text; very long texts go some windows at a time.

    Texts without a token, null or empty ones too, score 0. Null ids stay, repeated rows get the same score, the first of equal windows decides; an empty table gives no rows. Other columns are not read.
    """
    return per_text(docs, lambda: Scorer(net), "score double", id_col, text_col)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs, table(spark, sf_dir, "labels").where(~in_fold(F.col("doc_id"), 5, 0)))
    rows = score(docs, net)
    return rows.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
