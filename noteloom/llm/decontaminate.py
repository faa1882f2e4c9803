"""Benchmark decontamination with a positional inverted index over test terms.

The index is sharded by document: every task tokenises its own documents slice by
slice and stores, for the terms that the test set holds, lists of their positions
(postings, ascending by term and position).  A test window is looked up by the
list of its rarest term in that shard; the lists of its other terms are
intersected after subtracting their offsets, the next rarest first.  Since a match never crosses documents, the shards need no
exchange and the answer does not depend on how documents are dealt out.

The test set reaches the tasks in blocks of bounded size, each broadcast by
itself and searched against all documents; a task holds one block at a time
where there are several, so no limit on the total size is assumed.

Defined results: null or empty texts have no words and no matches; an item of
fewer words than the window is one window; an item without words never
matches; repeated documents or items each count; items with a null id are
named ''; empty tables give no matches.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from noteloom.llm.common import slices, texts_of

#: Consecutive words of a test window.
WINDOW = 10
#: UTF-8 bytes of test texts in one broadcast block.
BLOCK_BYTES = 8 << 20
#: Candidate positions that are intersected at a time.
STEP = 2_000_000

_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if (b + 32 if 65 <= b <= 90 else b) in _WORD else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) maximal runs of ASCII letters, digits and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class TestWindows:
    """Distinct windows of a block of test items, over a vocabulary of their terms."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        vocab: dict[bytes, int] = {}
        rows, owners, starts = [], [], []
        self.items = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            ids = [vocab.setdefault(w, len(vocab)) for w in words(text or "")]
            if not ids:
                continue
            for s in range(max(1, len(ids) - window + 1)):
                row = ids[s : s + window]
                rows.append(row + [-1] * (window - len(row)))
                owners.append(k)
                starts.append(s)
        self.vocab = list(vocab)
        self.lookup: dict[bytes, int] | None = None  # each task builds its own
        table = np.array(rows, dtype=np.int32).reshape(-1, window)
        self.terms, inverse = np.unique(table, axis=0, return_inverse=True)
        order = np.argsort(inverse.reshape(-1), kind="stable")
        self.owner = np.array(owners, dtype=np.int64)[order]
        self.start = np.array(starts, dtype=np.int64)[order]
        self.first = np.searchsorted(inverse.reshape(-1)[order], np.arange(len(self.terms) + 1))
        self.length = (self.terms >= 0).sum(axis=1)


class PositionalIndex:
    """Postings of the test terms over one shard of documents."""

    def __init__(self, texts: list[str]):
        flat: list[bytes] = []
        ends = np.zeros(len(texts) + 1, dtype=np.int64)
        for k, t in enumerate(texts):
            flat += words(t)
            ends[k + 1] = len(flat)
        self.ends, self.flat = ends, flat

    def use(self, tw: TestWindows) -> None:
        """Store the postings of this block's terms: positions by term, and both as one ascending key."""
        if tw.lookup is None:
            tw.lookup = {t: i for i, t in enumerate(tw.vocab)}
        ids = np.fromiter(map(tw.lookup.get, self.flat, repeat(-1)), dtype=np.int32, count=len(self.flat))
        known = np.flatnonzero(ids >= 0)
        term = ids[known]
        order = np.argsort(term, kind="stable")
        self.size = len(ids) + 1
        self.position = known[order]
        self.posting = term[order].astype(np.int64) * self.size + self.position
        self.freq = np.bincount(term, minlength=max(1, len(tw.vocab)))
        self.first = np.cumsum(self.freq) - self.freq

    def _rarest(self, tw: TestWindows):
        """Windows all of whose terms occur here, with their terms' offsets from the rarest on."""
        f = np.where(tw.terms >= 0, self.freq[tw.terms], np.iinfo(np.int64).max)
        alive = np.flatnonzero((f > 0).all(axis=1))
        return alive, np.argsort(f[alive], axis=1, kind="stable")

    def _candidates(self, tw: TestWindows, alive: np.ndarray, order: np.ndarray):
        """(row of alive, position) for each posting of each window's rarest term, in bounded steps."""
        rare = tw.terms[alive, order[:, 0]]
        count = self.freq[rare]
        total = np.cumsum(count)
        i = 0
        while i < len(rare):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + STEP, side="right")))
            c = count[i:j]
            within = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            yield np.repeat(np.arange(i, j), c), self.position[np.repeat(self.first[rare[i:j]], c) + within]
            i = j

    def _next(self, key: np.ndarray) -> np.ndarray:
        """The least posting that is not below each key; where there is none, one that is below every key."""
        at = np.searchsorted(self.posting, key)
        return np.append(self.posting, -1)[at]

    def phrases(self, tw: TestWindows) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every exact occurrence: lists less their terms' offsets, intersected from the rarest."""
        alive, order = self._rarest(tw)
        found_w, found_p = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for row, pos in self._candidates(tw, alive, order):
            start = pos - order[row, 0]
            w = alive[row]
            side = np.searchsorted(self.ends, pos, side="right")
            keep = np.flatnonzero((start >= self.ends[side - 1]) & (start + tw.length[w] <= self.ends[side]))
            row, start, w = row[keep], start[keep], w[keep]
            for k in range(1, tw.terms.shape[1]):
                want = tw.terms[w, order[row, k]].astype(np.int64)
                key = np.maximum(want, 0) * self.size + start + order[row, k]
                keep = np.flatnonzero((want < 0) | (self._next(key) == key))
                row, start, w = row[keep], start[keep], w[keep]
            found_w.append(w)
            found_p.append(start)
        return np.concatenate(found_w), np.concatenate(found_p)

    def near(self, tw: TestWindows, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its rarest term) where every term of the window is at most ``span`` words off."""
        alive, order = self._rarest(tw)
        found_w, found_p = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for row, pos in self._candidates(tw, alive, order):
            w = alive[row]
            side = np.searchsorted(self.ends, pos, side="right")
            lo, hi = np.maximum(pos - span, self.ends[side - 1]), np.minimum(pos + span, self.ends[side] - 1)
            for k in range(1, tw.terms.shape[1]):
                want = tw.terms[w, order[row, k]].astype(np.int64)
                got = self._next(np.maximum(want, 0) * self.size + lo)
                keep = np.flatnonzero((want < 0) | ((got >= 0) & (got <= want * self.size + hi)))
                row, pos, w, lo, hi = row[keep], pos[keep], w[keep], lo[keep], hi[keep]
            found_w.append(w)
            found_p.append(pos)
        return np.concatenate(found_w), np.concatenate(found_p)


def _blocks(spark: SparkSession, items: DataFrame, id_col: str, text_col: str, window: int):
    """Broadcasts of TestWindows, each over about BLOCK_BYTES of test texts."""
    out, block, size = [], [], 0
    for row in texts_of(items, id_col, text_col).toLocalIterator():
        block.append(("" if row.doc_id is None else str(row.doc_id), row.text))
        size += len(row.text.encode("utf-8", "surrogatepass"))
        if size >= BLOCK_BYTES:
            out.append(spark.sparkContext.broadcast(TestWindows(block, window)))
            block, size = [], 0
    if block:
        out.append(spark.sparkContext.broadcast(TestWindows(block, window)))
    return out


def _search(batches: Iterator[pa.RecordBatch], blocks) -> Iterator[tuple[pa.RecordBatch, PositionalIndex, Iterator]]:
    """Index each slice of documents once and hand out its test blocks one after another."""
    for part in slices(batches):
        index = PositionalIndex(part.column("text").to_pylist())
        yield part, index, _used(index, blocks)


def _used(index: PositionalIndex, blocks) -> Iterator[TestWindows]:
    """Each block in turn, with its terms' postings stored in ``index``."""
    for b in blocks:
        tw = b.value
        index.use(tw)
        yield tw
        if len(blocks) > 1:
            vars(b).pop("_value", None)  # read again from the executor's disk for the next documents


REPORT = "doc_id {id}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination_report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: words, words inside an occurrence of a test window, items hit and their digest."""
    rows = texts_of(docs, id_col, text_col)
    blocks = _blocks(docs.sparkSession, items, item_id, item_text, window)

    def run(batches):
        for part, index, each in _search(batches, blocks):
            n = part.num_rows
            cover = np.zeros(len(index.flat) + 1, dtype=np.int64)
            named: list[set[str]] = [set() for _ in range(n)]
            for tw in each:
                w, p = index.phrases(tw)
                np.add.at(cover, p, 1)
                np.add.at(cover, p + tw.length[w], -1)
                doc = np.searchsorted(index.ends, p, side="right") - 1
                for d, k in {*zip(doc.tolist(), w.tolist())}:
                    named[d].update(tw.items[o] for o in tw.owner[tw.first[k] : tw.first[k + 1]])
            hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
            n_hit = hit[index.ends[1:]] - hit[index.ends[:-1]]
            digest = [hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for s in named]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(index.ends)), pa.array(n_hit.astype(np.int64)), pa.array([len(s) for s in named], pa.int64()), pa.array(digest, pa.string()), pa.array(n_hit > 0)],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return rows.mapInArrow(run, REPORT.format(id=rows.schema["doc_id"].dataType.simpleString()))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, span: int | None = None) -> DataFrame:
    """Single matches: doc_id, item_id, item_pos, doc_pos (words before them).

    ``span`` None: exact phrases.  Otherwise proximity: every term of the window
    within ``span`` words of its rarest term, in any order; doc_pos is that term's.
    """
    rows = texts_of(docs, id_col, text_col)
    blocks = _blocks(docs.sparkSession, items, item_id, item_text, window)

    def run(batches):
        for part, index, each in _search(batches, blocks):
            ids = part.column("doc_id")
            for tw in each:
                w, p = index.phrases(tw) if span is None else index.near(tw, span)
                doc = np.searchsorted(index.ends, p, side="right") - 1
                many = tw.first[w + 1] - tw.first[w]
                at = np.repeat(tw.first[w], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.repeat(doc, many))), pa.array([tw.items[o] for o in tw.owner[at]], pa.string()), pa.array(tw.start[at]), pa.array(np.repeat(p - index.ends[doc], many))],
                    ["doc_id", "item_id", "item_pos", "doc_pos"],
                )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id string, item_pos long, doc_pos long")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any exact match, with all their columns; order and repeats stay.

    One pass over the partitions: rows are dropped where they lie.
    """
    blocks = _blocks(docs.sparkSession, items, "item_id", "text", window)

    def run(batches):
        for part in slices(batches, text_col):
            texts = [t or "" for t in part.column(text_col).to_pylist()]
            index = PositionalIndex(texts)
            bad = np.zeros(len(texts), dtype=bool)
            for tw in _used(index, blocks):
                _, p = index.phrases(tw)
                bad[np.searchsorted(index.ends, p, side="right") - 1] = True
            yield part.filter(pa.array(~bad))

    return docs.mapInArrow(run, docs.schema)
