"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  A line's features are its own shape (lengths, shares
of character classes, distinct words, repeats within the document) and the same
of the lines before and after it.  The chain is trained in numpy on a bounded
sample of labelled documents (``TRAIN_ROWS`` per class, the least by hash of
their ids), each line carrying its document's label first and then, in bad
documents, what the chain itself makes of it.  A document's raw score is the
mean of its lines' forward-backward marginals of being good, weighted by length;
a logistic curve fitted on the sample turns it into the score.

Defined results: a null or empty text is one empty line; repeated rows are
scored each; with labels of one kind or none every score is the share of that
kind or 0.5; label rows with null values are not learnt from, of repeated ones
the larger counts; empty tables give no rows; labels, language, source and id
are no inputs; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import held_out, slices, texts_of

#: Labelled documents of each class that the chain is fitted on, at most.
TRAIN_ROWS = 1500
STEPS, RATE, RIDGE = 80, 0.08, 1e-3

_CLASS = np.zeros(256, dtype=np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"|", b"#$%&*@~^_=+", b"!?", b".,;:'\"-", b"<>{}[]()\\/"), start=1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 1
CLASSES = 10


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features per line, byte length per line, first line of each text with an end)."""
    lines: list[str] = []
    first = [0]
    own = []
    for t in texts:
        part = t.split("\n")
        seen: set[str] = set()
        for x in part:
            w = x.split()
            own.append((len(w), len(set(w)), x in seen))
            seen.add(x)
        lines += part
        first.append(len(lines))
    raw = np.frombuffer(("\n".join(lines) + "\n").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    end = np.flatnonzero(raw == 10)
    begin = np.append(0, end[:-1] + 1)
    size = end - begin
    kind = _CLASS[raw]
    n = np.maximum(size, 1)
    share = np.empty((len(lines), CLASSES))
    for k in range(CLASSES):
        share[:, k] = np.add.reduceat((kind == k).astype(np.int32), begin)
    share[:, 0] -= 1  # the line's own end
    letters = np.maximum(share[:, 1] + share[:, 2], 1)
    upper = share[:, 2] / letters
    share /= n[:, None]
    words, distinct, again = (np.array(x, dtype=float) for x in zip(*own))
    unlike = distinct / np.maximum(words, 1)
    special = share[:, 5]
    at = np.asarray(first)
    place = np.zeros(len(lines))
    place[at[:-1]] = 1
    f = np.column_stack(
        [
            np.log1p(size), np.log1p(words), size / np.maximum(words, 1) / 10, share[:, 1:], upper, upper > 0.5, share[:, 4] > 0.02, special > 0.02, special > 0.08,
            share[:, 6] > 0.03, share[:, 6] > 0.12, unlike, unlike < 0.8, unlike < 0.5, again, size == 0, place, share[:, 3] > 0.2,
        ]
    )
    return f, size, at


def with_neighbours(f: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the lines before and after it in its text (zero outside)."""
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.hstack([f, before, after])


def marginals(score: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) per line, expected transitions 2 x 2) by scaled forward-backward.

    ``score``: log-odds of good per line before neighbours speak; ``trans``: log weights [from, to], 0 bad, 1 good.
    Chains are walked together, longest first, so that the running ones are a prefix.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    running = np.searchsorted(-size, -np.arange(longest), side="left")
    e = np.exp(np.clip(score, -30, 30))
    m = np.exp(trans)
    ahead = np.empty((len(score), 2))
    scale = np.empty(len(score))
    good = np.empty(len(score))
    for t in range(longest):
        at = start[: running[t]] + t
        if t:
            a = ahead[at - 1]
            bad, ok = a[:, 0] * m[0, 0] + a[:, 1] * m[1, 0], (a[:, 0] * m[0, 1] + a[:, 1] * m[1, 1]) * e[at]
        else:
            bad, ok = np.full(len(at), 0.5), 0.5 * e[at]
        s = bad + ok
        ahead[at, 0], ahead[at, 1], scale[at] = bad / s, ok / s, s
    moved = np.zeros((2, 2))
    back0, back1 = np.ones(len(start)), np.ones(len(start))
    for t in range(longest - 1, -1, -1):
        k = running[t]
        at = start[:k] + t
        good[at] = ahead[at, 1] * back1[:k] / (ahead[at, 0] * back0[:k] + ahead[at, 1] * back1[:k])
        if t:
            a = ahead[at - 1]
            b0, b1 = back0[:k] / scale[at], back1[:k] * e[at] / scale[at]
            moved += m * np.array([[a[:, 0] @ b0, a[:, 0] @ b1], [a[:, 1] @ b0, a[:, 1] @ b1]])
            back0[:k], back1[:k] = m[0, 0] * b0 + m[0, 1] * b1, m[1, 0] * b0 + m[1, 1] * b1
    return good, moved


@dataclass
class Chain:
    """Feature centre and scale, weights, transition log weights, and the curve from mean marginal to score."""

    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    trans: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(P(good), byte length) per line and the first line of each text."""
        f, size, first = line_features(texts)
        x = (with_neighbours(f, first) - self.centre) / self.scale
        return marginals(x @ self.weight + self.bias, first, self.trans)[0], size, first

    def raw(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean of the lines' marginals."""
        good, size, first = self.lines(texts)
        w = size + 1.0
        return np.add.reduceat(good * w, first[:-1]) / np.add.reduceat(w, first[:-1])

    def score(self, texts: list[str]) -> np.ndarray:
        r = np.clip(self.raw(texts), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(r / (1 - r)) + self.shift, -40, 40)))


class Adam:
    def __init__(self, like: np.ndarray, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros_like(like), np.zeros_like(like), 0, rate

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.99 * self.v + 0.01 * g * g
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def _fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, first: np.ndarray, weight: np.ndarray, bias: float, trans: np.ndarray, steps: int):
    """Ascend the labelled chains' log-likelihood."""
    p = np.concatenate([weight, [bias], trans.ravel()])
    adam, n, d = Adam(p, RATE), len(y), x.shape[1]
    inner = np.ones(len(y), dtype=bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    seen = np.bincount(2 * y[at - 1].astype(int) + y[at].astype(int), minlength=4).reshape(2, 2)
    for _ in range(steps):
        good, moved = marginals(x @ p[:d] + p[d], first, p[d + 1 :].reshape(2, 2))
        gap = (y - good) * w
        g = np.concatenate([x.T @ gap / n - RIDGE * p[:d], [gap.sum() / n], ((seen - moved) / n - RIDGE * p[d + 1 :].reshape(2, 2)).ravel()])
        p = p + adam.step(g)
    return p[:d], float(p[d]), p[d + 1 :].reshape(2, 2)


def train(texts: list[str], labels: np.ndarray, steps: int = STEPS) -> Chain:
    """A chain fitted to documents labelled 1 (good) or 0."""
    f, size, first = line_features(texts)
    x = with_neighbours(f, first)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - centre) / scale
    of = np.repeat(np.arange(len(texts)), np.diff(first))
    y = labels[of].astype(float)
    balance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    w = balance[of]
    weight, bias, trans = _fit(x, y, w, first, np.zeros(x.shape[1]), 0.0, np.zeros((2, 2)), steps)
    good, _ = marginals(x @ weight + bias, first, trans)
    y = np.where((labels[of] == 0) & (good > 0.7), 1.0, y)  # ordinary lines in bad documents
    weight, bias, trans = _fit(x, y, w, first, weight, bias, trans, steps // 2)
    chain = Chain(centre, scale, weight, bias, trans)
    r = np.clip(chain.raw(texts), 1e-6, 1 - 1e-6)
    z = np.log(r / (1 - r))
    a, b = 1.0, 0.0
    for _ in range(200):  # Newton steps of the curve, damped
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        h = p * (1 - p) + 1e-6
        g = np.array([((labels - p) * z).sum() - 1e-2 * a, (labels - p).sum()])
        hess = np.array([[(h * z * z).sum() + 1e-2, (h * z).sum()], [(h * z).sum(), h.sum()]])
        a, b = np.array([a, b]) + 0.5 * np.linalg.solve(hess, g)
    chain.slope, chain.shift = max(float(a), 1e-3), float(b)
    return chain


#: Bytes of a text that a classifier may be fitted on.
TRAIN_BYTES = 1 << 16


def labelled_sample(docs: DataFrame, labels: DataFrame, name: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Whole texts and labels of at most ``per_class`` training rows of each class, the least by hash of the id.

    Training rows: crc32 of the id as text is not 0 modulo 5.  The ids are chosen
    from the narrow label table before any text is read.  Of rows that share an id
    the text with the least hash is taken, however the rows are dealt out.  Texts of
    more than TRAIN_BYTES are not learnt from (they are scored like all others), so
    what reaches the driver is bounded by 2 per_class TRAIN_BYTES.
    """
    marked = labels.select("doc_id", F.col(name).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(~held_out("doc_id", 5, 0)).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = None
    for y in (0, 1):
        part = marked.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = texts_of(docs, id_col, text_col).filter("doc_id is not null").filter(F.octet_length("text") <= TRAIN_BYTES).join(F.broadcast(chosen), "doc_id")
    rows = texts.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).orderBy("doc_id").toArrow()
    return rows.column("text").to_pylist(), rows.column("y").to_numpy().astype(int)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    texts, y = labelled_sample(docs, labels, "quality", train_rows, id_col, text_col)
    chain = train(texts, y) if 0 < y.sum() < len(y) else None
    flat = float(y.mean()) if len(y) else 0.5
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    rows = texts_of(docs, id_col, text_col)

    def run(batches):
        model = sent.value
        for part in slices(batches):
            t = part.column("text").to_pylist()
            s = model.score(t) if model else np.full(len(t), flat)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def line_marginals(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per line: doc_id, line (from 0), n_bytes, good (its marginal)."""
    texts, y = labelled_sample(docs, labels, "quality", train_rows, id_col, text_col)
    if not 0 < y.sum() < len(y):
        raise ValueError("labels of both kinds are needed to judge single lines")
    sent = docs.sparkSession.sparkContext.broadcast(train(texts, y))
    rows = texts_of(docs, id_col, text_col)

    def run(batches):
        for part in slices(batches):
            good, size, first = sent.value.lines(part.column("text").to_pylist())
            n = np.diff(first)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.arange(len(good)) - np.repeat(first[:-1], n)), pa.array(size), pa.array(good)], ["doc_id", "line", "n_bytes", "good"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, line long, n_bytes long, good double")
