"""Toxicity from a bidirectional gated recurrent network with attention pooling.

A word enters as two vectors: its own (frequent training words; all others share
one) and the mean of its hashed character trigrams, so unseen spellings still
carry signal.  All windows of ``WINDOW`` words, one from every word on,
run through a forward and a backward GRU; attention pools their states, a
logistic unit scores the pool, and a document's score is that of its most toxic
window.  Neighbouring windows advance side by side, so that step t of all of
them reads one stretch of the text.  Everything is numpy; gradients are written out below.

Training uses a bounded sample of labelled documents (``TRAIN_ROWS`` per class,
the least by hash of their ids).  Labels are of documents, so windows are mined:
first those with the word of the largest log-odds, then, round by round, those
that the network itself finds most toxic.

Defined results: null or empty texts are one window of one padding word;
repeated rows are scored each; with labels of one kind or none every score is
that kind, or 0; label rows with null values are not learnt from; empty
tables give no rows; labels, language, source and id are no inputs.
"""

from __future__ import annotations

import math
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import held_out, slices, texts_of
from noteloom.llm.quality_crf import Adam, labelled_sample

#: Labelled documents of each class that the network is fitted on, at most.
TRAIN_ROWS = 2000
WINDOW = 8
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 6, 6, 6, 6
#: Words with vectors of their own, and buckets of character trigrams.
VOCABULARY, TRIGRAMS = 20_000, 1 << 15
ROUNDS, EPOCHS, BATCH, RATE, SEED = 4, 3, 256, 0.02, 11
#: Windows that run through the network at a time, so that their states stay in a core's cache.
CHUNK = 4096

_KEEP = bytes((b + 32 if 65 <= b <= 90 else b) if chr(b).isalnum() and b < 128 or b >= 128 or b in b"@$!*" else 32 for b in range(256))


_bare = bytes.strip


def words(text: str) -> list[bytes]:
    """A-Z lower-cased; letters, digits, non-ASCII characters and, inside words, the signs that stand in for letters."""
    raw = text.encode("utf-8", "surrogatepass").translate(_KEEP)
    return [w for w in map(_bare, raw.split(), repeat(b"@$!*")) if w]


def trigrams(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram of each word with its edges marked, first trigram of each word)."""
    raw = np.frombuffer(b"".join(b"<" + w + b">" for w in names), dtype=np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, names), dtype=np.int64, count=len(names)) + 2
    first = np.cumsum(size) - size
    code = raw[:-2] * np.uint32(65536) + raw[1:-1] * np.uint32(256) + raw[2:]
    own = np.ones(len(raw), dtype=bool)
    own[first + size - 1] = False
    own[first + size - 2] = False
    bucket = (code[own[:-2]] * np.uint32(2654435761)) >> np.uint32(32 - 15)
    n = size - 2
    return bucket.astype(np.int64), np.cumsum(n) - n


def windows(n: int) -> int:
    """Number of windows of a text of n words: one from every word on that has WINDOW words left, or one of all words."""
    return max(1, n - WINDOW + 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, vocabulary: list[bytes], odds: np.ndarray, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.place = {w: i + 1 for i, w in enumerate(vocabulary)}
        d = WORD_DIM + CHAR_DIM
        g = lambda *s: (r.standard_normal(s) / math.sqrt(s[0])).astype(np.float32)
        word = 0.1 * r.standard_normal((len(vocabulary) + 1, WORD_DIM))
        word[1:, 0] += np.clip(odds, -3, 3)
        self.p = {"word": word.astype(np.float32), "char": (0.1 * r.standard_normal((TRIGRAMS, CHAR_DIM))).astype(np.float32), "A": g(2 * HIDDEN, ATTEND), "a": np.zeros(ATTEND, np.float32), "v": g(ATTEND), "w": g(2 * HIDDEN), "b": np.zeros(1, np.float32)}
        for k in "fb":
            self.p |= {f"W{k}": g(d, 3 * HIDDEN), f"U{k}": g(HIDDEN, 3 * HIDDEN), f"c{k}": np.zeros(3 * HIDDEN, np.float32)}

    def lookup(self, names: list[bytes]):
        """Inputs of distinct words: own row, trigram buckets and their first."""
        own = np.fromiter((self.place.get(w, 0) for w in names), dtype=np.int64, count=len(names))
        return (own, *trigrams(names))

    def embed(self, looked) -> np.ndarray:
        own, bucket, first = looked
        n = np.diff(np.append(first, len(bucket)))
        return np.hstack([self.p["word"][own], np.add.reduceat(self.p["char"][bucket], first) / n[:, None].astype(np.float32)])

    def _run(self, gates: np.ndarray, at: np.ndarray, mask: np.ndarray, k: str, keep: list | None):
        """States of one direction; gates: input part per distinct word, at: words per window."""
        u, h = self.p[f"U{k}"], np.zeros((len(at), HIDDEN), np.float32)
        uzr, uc = u[:, : 2 * HIDDEN], u[:, 2 * HIDDEN :]
        out = np.empty((at.shape[1], len(at), HIDDEN), np.float32)
        steps = range(at.shape[1]) if k == "f" else range(at.shape[1] - 1, -1, -1)
        for t in steps:
            x = gates[at[:, t]]
            zr = _sigmoid(x[:, : 2 * HIDDEN] + h @ uzr)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ uc)
            z = z * mask[:, t : t + 1]  # a padded word leaves the state as it is
            if keep is not None:
                keep.append((t, h, z, r, c))
            h = h + z * (c - h)
            out[t] = h
        return out

    def forward(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Logit of each window; x: vectors of distinct words, at: their numbers per window, mask: 1 for words."""
        kept = {k: [] if tape is not None else None for k in "fb"}
        h = np.concatenate([self._run(x @ self.p[f"W{k}"] + self.p[f"c{k}"], at, mask, k, kept[k]) for k in "fb"], axis=2)
        s = np.tanh(h @ self.p["A"] + self.p["a"])
        e = np.where(mask.T > 0, s @ self.p["v"], -1e9)
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pool = (alpha[:, :, None] * h).sum(axis=0)
        if tape is not None:
            tape |= {"kept": kept, "h": h, "s": s, "alpha": alpha, "pool": pool}
        return pool @ self.p["w"] + self.p["b"][0]

    def gradients(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, d_logit: np.ndarray, tape: dict):
        """Gradients of the dense parameters, and of x."""
        p, g = self.p, {}
        h, s, alpha, pool = tape["h"], tape["s"], tape["alpha"], tape["pool"]
        g["w"], g["b"] = pool.T @ d_logit, np.array([d_logit.sum()], np.float32)
        d_pool = d_logit[:, None] * p["w"]
        d_h = alpha[:, :, None] * d_pool
        d_alpha = (h * d_pool).sum(axis=2)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        d_s = d_e[:, :, None] * p["v"] * (1 - s * s)
        g["v"] = (s * d_e[:, :, None]).sum(axis=(0, 1))
        g["A"], g["a"] = np.einsum("tni,tnj->ij", h, d_s), d_s.sum(axis=(0, 1))
        d_h = d_h + d_s @ p["A"].T
        d_x = np.zeros_like(x)
        for k, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            u = p[f"U{k}"]
            d_u, d_gates = np.zeros_like(u), np.zeros((len(x), 3 * HIDDEN), np.float32)
            down = np.zeros((len(at), HIDDEN), np.float32)
            for t, before, z, r, c in reversed(tape["kept"][k]):
                d = d_h[t, :, part] + down
                d_z = d * (c - before) * z * (1 - z) * mask[:, t : t + 1]
                d_c = d * z * (1 - c * c)
                d_rh = d_c @ u[:, 2 * HIDDEN :].T
                d_r = d_rh * before * r * (1 - r)
                d_zr = np.hstack([d_z, d_r])
                down = d * (1 - z) + d_rh * r + d_zr @ u[:, : 2 * HIDDEN].T
                d_u[:, : 2 * HIDDEN] += before.T @ d_zr
                d_u[:, 2 * HIDDEN :] += (r * before).T @ d_c
                np.add.at(d_gates, at[:, t], np.hstack([d_zr, d_c]))
            g[f"U{k}"], g[f"W{k}"], g[f"c{k}"] = d_u, x.T @ d_gates, d_gates.sum(axis=0)
            d_x += d_gates @ p[f"W{k}"].T
        return g, d_x

    def sliding(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Logit of the window from every place of ``ids`` (numbers of words, WINDOW at least); what ``forward`` gives for each.

        States stand feature by feature; the gates' sigmoid is a tangent of half
        the input, so the halves are taken of the weights once.
        """
        half = np.concatenate([np.full(2 * HIDDEN, 0.5), np.ones(HIDDEN)]).astype(np.float32)
        gates = {k: np.ascontiguousarray(((x @ self.p[f"W{k}"] + self.p[f"c{k}"]) * half).T) for k in "fb"}
        own = {k: np.ascontiguousarray((self.p[f"U{k}"] * half).T) for k in "fb"}
        attend, a, v, w = np.ascontiguousarray(self.p["A"].T), self.p["a"][:, None], self.p["v"], self.p["w"]
        out = np.empty(len(ids) - WINDOW + 1, np.float32)
        for begin in range(0, len(out), CHUNK):
            m = min(CHUNK, len(out) - begin)
            part = ids[begin : begin + m + WINDOW - 1]
            states = np.empty((WINDOW, 2 * HIDDEN, m), np.float32)
            for k, row, steps in (("f", 0, range(WINDOW)), ("b", HIDDEN, range(WINDOW - 1, -1, -1))):
                g, u, h = gates[k][:, part], own[k], np.zeros((HIDDEN, m), np.float32)
                for t in steps:
                    zr = np.tanh(g[: 2 * HIDDEN, t : t + m] + u[: 2 * HIDDEN] @ h)
                    zr = 0.5 * zr + np.float32(0.5)
                    c = np.tanh(g[2 * HIDDEN :, t : t + m] + u[2 * HIDDEN :] @ (zr[HIDDEN:] * h))
                    h = h + zr[:HIDDEN] * (c - h)
                    states[t, row : row + HIDDEN] = h
            e = np.stack([v @ np.tanh(attend @ s + a) for s in states])
            e = np.exp(e - e.max(axis=0))
            out[begin : begin + m] = (e * np.stack([w @ s for s in states])).sum(axis=0) / e.sum(axis=0) + self.p["b"][0]
        return out

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(logit of every window, first window of each text) over whole texts."""
        number: dict[bytes, int] = {}
        held = [[number.setdefault(x, len(number)) for x in words(t) or [b" "]] for t in texts]
        x = self.embed(self.lookup(list(number)))
        size = np.fromiter(map(len, held), dtype=np.int64, count=len(held))
        many = np.maximum(1, size - WINDOW + 1)
        first = np.cumsum(many) - many
        out = np.empty(int(many.sum()), np.float32)
        long = np.flatnonzero(size >= WINDOW)
        if len(long):
            every = self.sliding(x, np.fromiter(chain.from_iterable(held[k] for k in long), dtype=np.int64))
            # windows that run from one text into the next are left out
            begin = np.cumsum(size[long]) - size[long]
            of = np.repeat(np.arange(len(long)), many[long])
            step = np.arange(len(of)) - np.repeat(np.cumsum(many[long]) - many[long], many[long])
            out[first[long][of] + step] = every[begin[of] + step]
        short = np.flatnonzero(size < WINDOW)
        for i in range(0, len(short), CHUNK):
            part = short[i : i + CHUNK]
            at, mask = np.zeros((len(part), WINDOW), np.int64), (np.arange(WINDOW) < size[part, None]).astype(np.float32)
            at[mask > 0] = np.concatenate([held[k] for k in part])
            out[first[part]] = self.forward(x, at, mask)
        return out, first

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of each text's most toxic window."""
        logit, first = self.logits(texts)
        return 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(logit, first).astype(float), -40, 40)))


def train(texts: list[str], labels: np.ndarray, rounds: int = ROUNDS, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network fitted to documents labelled 1 (toxic) or 0."""
    number: dict[bytes, int] = {}
    flat = [np.fromiter((number.setdefault(x, len(number)) for x in words(t) or [b" "]), dtype=np.int32) for t in texts]
    names = list(number)
    seen = [np.zeros(len(names)), np.zeros(len(names))]
    for ids, y in zip(flat, labels):
        seen[y][np.unique(ids)] += 1
    n = np.array([(labels == 0).sum(), (labels == 1).sum()])
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    common = sorted(np.flatnonzero(seen[0] + seen[1] >= 3).tolist(), key=lambda i: (-(seen[0][i] + seen[1][i]), names[i]))[:VOCABULARY]
    net = Network([names[i] for i in common], odds[common], seed)
    hint = np.zeros(len(names))
    hint[common] = odds[common]
    r = np.random.default_rng(seed)
    adam = {k: Adam(v, RATE) for k, v in net.p.items()}
    for turn in range(rounds):
        picked, target = [], []
        for i in range(0, len(texts), 100):
            logit, first = net.logits(texts[i : i + 100]) if turn else (np.empty(0), np.zeros(len(texts[i : i + 100]), int))
            for ids, value, y in zip(flat[i : i + 100], np.split(logit, first[1:]), labels[i : i + 100]):
                wide = min(WINDOW, len(ids))
                v = value if turn else np.lib.stride_tricks.sliding_window_view(hint[ids], wide).max(axis=1)
                order = np.argsort(-v, kind="stable")
                for k in order[:1] if y else {*order[:2].tolist(), int(r.integers(windows(len(ids))))}:
                    picked.append(ids[k : k + wide])
                    target.append(y)
        target = np.array(target, dtype=np.float32)
        weight = np.where(target == 1, 0.5 / target.mean(), 0.5 / (1 - target.mean())).astype(np.float32)
        batch = min(BATCH, max(32, len(picked) // 24))  # few windows still make a few hundred steps
        for _ in range(epochs):
            order = r.permutation(len(picked))
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                own, at = np.unique(np.concatenate([picked[j] for j in part]), return_inverse=True)
                size = np.array([len(picked[j]) for j in part])
                mask = (np.arange(WINDOW) < size[:, None]).astype(np.float32)
                place = np.zeros((len(part), WINDOW), dtype=np.int64)
                place[mask > 0] = at
                _step(net, adam, [names[j] for j in own], place, mask, target[part], weight[part])
    return net


def _step(net: Network, adam: dict, names: list[bytes], at: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
    """One batch of windows: forward, back, update."""
    looked = net.lookup(names)
    x, tape = net.embed(looked), {}
    d = (_sigmoid(net.forward(x, at, mask, tape)) - target) * weight / len(at)
    g, d_x = net.gradients(x, at, mask, d.astype(np.float32), tape)
    own, bucket, first = looked
    m = np.diff(np.append(first, len(bucket)))
    g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
    np.add.at(g["word"], own, d_x[:, :WORD_DIM])
    np.add.at(g["char"], bucket, np.repeat(d_x[:, WORD_DIM:] / m[:, None], m, axis=0))
    for k, v in g.items():
        net.p[k] -= adam[k].step(v + 1e-5 * net.p[k]).astype(np.float32)


def _scorer(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, train_rows: int):
    """Broadcast (network or None, score without one)."""
    texts, y = labelled_sample(docs, labels, "toxic", train_rows, id_col, text_col)
    both = 0 < y.sum() < len(y)
    return docs.sparkSession.sparkContext.broadcast((train(texts, y) if both else None, float(y.mean()) if len(y) else 0.0))


def _scores(model, flat: float, texts: list[str]) -> np.ndarray:
    return model.score(texts) if model else np.full(len(texts), flat)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    sent = _scorer(docs, labels, id_col, text_col, train_rows)
    rows = texts_of(docs, id_col, text_col)

    def run(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_scores(*sent.value, part.column("text").to_pylist()))], ["doc_id", "score"])

    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, with all their columns."""
    sent = _scorer(docs, labels, id_col, text_col, train_rows)

    def run(batches):
        for part in slices(batches, text_col):
            score = _scores(*sent.value, [t or "" for t in part.column(text_col).to_pylist()])
            yield part.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
